"""Every operator over nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns with names that clash."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import boilerplate, capping, dedup, encoding, language, leakage, lines, mixing, quality, subjects

RNG = random.Random(11)
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ne") for b in ("ban", "der", "fil", "gon", "hus") for c in ("o", "u", "em", "is")]
BIG = 2**61 + 1  # doesn't survive a way through floating point

#: Names that the operators use for columns of their own.
CLASHES = ["key", "n", "k", "df", "rank", "part", "_part", "host", "site", "doc", "item", "token", "page", "tokens", "h", "uses", "swap", "gain", "share", "stat", "value", "words", "old", "cell", "gram", "line", "a", "b", "count"]


def prose(k):
    return ". ".join(" ".join(RNG.choice(WORDS) for _ in range(9)).capitalize() for _ in range(k)) + "."


LONG = "\n\n".join(prose(20) for _ in range(60))


def chunks(spark, extra=True):
    texts = [prose(12) for _ in range(12)]
    rows = [(BIG + k, 1 + k % 3, f"https://a.example/{k}", "en" if k % 2 else None, t + "\nThis very line stands on every page", 0.5) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, None, None, None, None, None), (None, 1, "https://a.example/x", "en", texts[0], 0.1), (BIG + 50, None, None, None, texts[1], None)]
    rows += [(BIG + 51, 2, "https://a.example/y", "en", "", None), (BIG + 52, 2, "no address", "und", " \n\t\n", 0.2), (BIG + 53, 3, "https://b.example/z", "en", LONG, 0.9), (BIG + 54, 3, "", "EN_us", LONG + " More.", 0.9)]
    df = spark.createDataFrame(rows, "id long, batch long, source_doc string, lang string, text string, quality double")
    for name in CLASHES if extra else []:
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(df):
    return df.where(F.lit(False))


def ids(df, name="id"):
    return [r[name] for r in df.select(name).collect()]


def test_statistics_and_scores(spark):
    df = chunks(spark)
    rows = quality.statistics(df).collect()
    assert len(rows) == df.where("id is not null").count() and next(r for r in rows if r.id == BIG + 51).words == 1
    assert not {None, BIG + 51, BIG + 52} & set(ids(quality.not_prose(df)))
    table = "\n".join(f"a{k} | {k} | ok |" for k in range(400))
    bad = spark.createDataFrame([(BIG + 90, "en", table), (BIG + 90, "en", table), (None, "en", table)], "id long, lang string, text string")
    many = spark.range(60).select("id", F.lit("en").alias("lang"), F.lit(prose(12)).alias("text"))
    assert ids(quality.not_prose(many.unionByName(bad))) == [BIG + 90] * 2
    assert ids(quality.not_prose(empty(df))) == []


def test_refused_texts(spark):
    df = chunks(spark)
    refused, table = dedup.admit(df)
    got = {r.id: r.repeats for r in refused.collect()}
    # a row without batch comes before all batches; long near copies are found; rows without id take no part
    assert got == {BIG + 1: BIG + 50, BIG + 54: BIG + 53}
    assert sorted(ids(table)) == sorted({*range(BIG, BIG + 12), BIG + 50, BIG + 53} - set(got))
    assert ids(dedup.admit(empty(df))[0]) == []
    # a batch taken again
    again, fresh = dedup.admit(df, table)
    assert {r.id: r.repeats for r in again.collect()} == got and fresh.count() == 0


def test_lines_outside_the_article(spark):
    df = chunks(spark)
    got = {(r.id, r.line_no) for r in boilerplate.boilerplate_lines(df).collect()}
    assert {i for i, _ in got} <= set(range(BIG, BIG + 55)) and {(BIG + k, 2) for k in range(12)} <= got
    assert boilerplate.boilerplate_lines(empty(df)).count() == 0


def test_wrong_encodings(spark):
    sound = "Le café d’été est déjà très naïf, voilà."
    wrong = sound.encode().decode("cp1252")
    df = chunks(spark).withColumn("source", F.col("source_doc"))
    some = df.limit(1).withColumn("id", F.lit(BIG + 60)).withColumn("text", F.lit(wrong))
    some = some.unionByName(some).unionByName(some.withColumn("id", F.lit(None).cast("long"))).unionByName(some.withColumn("id", F.lit(BIG + 61)).withColumn("source", F.lit(None).cast("string")))
    fine = spark.range(50).select("id", F.lit("s").alias("source"), F.lit(sound).alias("text"))
    docs = fine.unionByName(df.unionByName(some), allowMissingColumns=True)
    solved = encoding.solve(encoding.pieces(docs))
    assert sorted(ids(encoding.found_ids(solved))) == [BIG + 60, BIG + 61]
    assert {(r.id, r.text) for r in encoding.restore(docs, solved).collect()} == {(BIG + 60, sound), (BIG + 61, sound)}
    assert encoding.restore(empty(docs), encoding.solve(encoding.pieces(empty(docs)))).count() == 0


def test_repeated_lines(spark):
    df = chunks(spark)
    got = sorted((r.id, r.line_no) for r in lines.repeated_lines(df).collect())
    assert got == sorted([(BIG + k, 2) for k in range(12)] + [(BIG + 3, 2)] * 2)
    left = lines.without_lines(df, lines.repeated_lines(df))
    assert left.count() == df.count() and left.where("text like '%very line%'").count() == 0
    items = lines.line_items(df)
    assert lines.frequent_sequences(items, lines.site_support(df, 4, 0.1)).count() == 1
    assert lines.repeated_lines(empty(df)).count() == 0 and lines.frequent_sequences(empty(items), lines.site_support(empty(df), 4, 0.1)).count() == 0


def test_languages(spark):
    df = chunks(spark)
    models = language.train(df)
    rows = language.language_errors(df, models).collect()
    assert {(r.para_no, r.lang) for r in rows} == {(0, "en")}
    assert {r.id for r in rows} == {BIG + k for k in range(0, 12, 2)} | {BIG + 50}
    assert language.document_languages(language.segment_languages(df, models)).count() == 15
    for none in (empty(df), df.withColumn("lang", F.lit(None).cast("string"))):
        assert language.language_errors(none, language.train(none)).count() == 0


def test_capped_records(spark):
    df = chunks(spark).withColumn("where", F.lit("w"))
    got = capping.capped(df, group="batch", contributor="where", share=3)
    rows = {r.id: r.kept for r in got.collect()}
    assert len(rows) == df.where("id is not null").select("id").distinct().count() and sum(rows.values()) >= 4
    assert capping.capped(empty(df), group="batch", contributor="where", share=3).count() == 0


def test_leaks(spark):
    df = chunks(spark)
    passage = LONG[2000:4000]
    items = spark.createDataFrame([(1, passage, "x"), (1, passage, "x"), (2, None, "x"), (3, "", "x"), (None, passage, "x")], "id long, text string, gram string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(df, items).collect()}
    assert got == {(BIG + 53, 1), (BIG + 54, 1)}
    assert leakage.leaks(df, items).count() == 2  # each pair once
    for d, i in ((empty(df), items), (df, empty(items)), (empty(df), empty(items))):
        assert leakage.leaks(d, i).count() == 0


def test_alignment_of_a_passage_of_many_words():
    ws = np.arange(10, 10 + 5000, dtype=np.uint64)
    assert leakage.aligned([ws], [ws], [9]).tolist() == [5000]


@pytest.mark.skipif(not os.path.exists(mixing.TOKENIZER), reason="no tokenizer")
def test_mixture(spark):
    df = chunks(spark).withColumn("doc_id", F.col("id")).withColumn("source", F.when(F.col("id").isNotNull(), F.coalesce("lang", F.lit("none")))).drop("tokens")
    targets = spark.createDataFrame([("en", 0.5, 1, "c"), ("none", 0.5, None, "c"), (None, 0.0, 1, "c"), ("gone", None, 2, "c")], "source string, target_share double, max_repeats int, tokens string")
    used, report = mixing.mixture(df.withColumn("uses", F.lit(1)), targets)
    rows = {r.source: r for r in report.collect()}
    assert set(rows) == {"en", "none", None, "gone"} and rows["none"].short and not rows["gone"].short
    assert used.where("uses > 1").count() == 0
    assert mixing.mixture(empty(df), targets)[1].where("used_tokens > 0").count() == 0 and mixing.mixture(df, empty(targets))[1].count() == 0


def test_subjects(spark):
    df = chunks(spark).withColumn("doc_id", F.col("id")).withColumn("terms", F.lit(1)).withColumn("para", F.lit(1))
    labels = spark.createDataFrame([(BIG + 53, "s", 1), (None, "s", 1), (BIG + 54, None, 1), (BIG + 53, "s", 1)], "doc_id long, subject string, f int")
    got = subjects.document_subjects(df, labels)
    assert None not in ids(got, "doc_id") and got.count() == got.select("doc_id", "subject").distinct().count()
    for d, some in ((empty(df), labels), (df, empty(labels)), (empty(df), empty(labels))):
        assert subjects.document_subjects(d, some).count() == 0
