"""Problem 9: mixing sources to target shares of tokens, by hash-threshold histograms."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.session import cut, read

TOKENIZER = os.environ.get("QUERN_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Splits text into pieces before pairs are merged; fixed with the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BITS, LEVELS = 12, 4  # 48 bits of hash


@lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(spark: SparkSession, path: str = TOKENIZER):
    """A function of a text column: its tokens; a null text has none. The vocabulary file is sent to the executors."""
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoding(SparkFiles.get(name))
        for s in texts:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s], index=s.index)

    return count


def sized(docs: DataFrame, targets: DataFrame, *, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, h): documents of the listed sources, measured, with 48 bits of hash."""
    listed = docs.select("doc_id", "source", "text").join(targets.select("source"), "source", "left_semi")
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - BITS * LEVELS)
    return listed.select("doc_id", "source", token_count(docs.sparkSession, path)("text").alias("tokens"), h.alias("h"))


def histogram(docs: DataFrame, level: int = 0) -> DataFrame:
    """(source, bucket, tokens, docs): the sums by source and leading bits of the hash; at most 4096 rows a source at level 0."""
    return docs.groupBy("source", F.shiftright("h", BITS * (LEVELS - 1 - level)).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))


def budgets(first: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each source: its tokens, how often all are used, and the tokens still wanted from one more use of a part.

    All sums are those of the first histogram. The whole is the tokens of all listed sources, each used once. A source
    falls short if its tokens times max_repeats are fewer than its share of the whole.
    """
    have = first.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs"))
    t = targets.select("source", "target_share", F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"))
    t = t.join(have, "source", "left").fillna(0, ["tokens", "docs", "target_share"])
    t = t.withColumn("wanted", F.col("target_share") * F.sum("tokens").over(Window.partitionBy(F.lit(0))))  # a row per source
    full = F.least(F.when(F.col("tokens") > 0, F.floor(F.col("wanted") / F.col("tokens"))).otherwise(0), F.col("max_repeats")).cast("long")
    t = t.withColumn("full", full).withColumn("short", F.col("tokens") * F.col("max_repeats") < F.col("wanted"))
    return t.withColumn("rest", F.when(F.col("full") < F.col("max_repeats"), F.col("wanted") - F.col("full") * F.col("tokens")).otherwise(0.0))


def thresholds(docs: DataFrame, plan: DataFrame, first: DataFrame) -> DataFrame:
    """(source, threshold): documents with h below it hold as many tokens as wanted, or less by at most one document.

    Level by level, tokens are summed by source and bucket of hash inside the one bucket where the budget ends, so no
    documents are sorted and each level's result is at most 4096 rows a source. first: the histogram of level 0.
    """
    at = plan.select("source", F.lit(0).cast("long").alias("prefix"), F.col("rest").alias("left"))
    for level in range(LEVELS):
        if level == 0:
            buckets = first
        else:
            inside = docs.join(at.select("source", "prefix"), "source").where(F.shiftright("h", BITS * (LEVELS - level)) == F.col("prefix"))
            buckets = histogram(inside, level)
        running = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
        over = (
            buckets.withColumn("running", running)
            .join(at.select("source", "left"), "source")
            .groupBy("source")
            .agg(F.min(F.when(F.col("running") > F.col("left"), F.col("bucket"))).alias("edge"), F.max(F.when(F.col("running") <= F.col("left"), F.col("running"))).alias("used"))
        )
        last = ((F.col("prefix") + 1) * 2**BITS) - 1
        at = cut(at.join(over, "source", "left").select("source", F.coalesce("edge", last).alias("prefix"), (F.col("left") - F.coalesce("used", F.lit(0))).alias("left")))
    return at.select("source", F.col("prefix").alias("threshold"))


def mixture(docs: DataFrame, targets: DataFrame, *, path: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents with uses, report by source).

    documents: (doc_id, source, tokens, uses); report: (source, target_share, max_repeats, docs, tokens, wanted, short,
    used_tokens, actual_share). No document is used more than max_repeats times. A listed source without documents
    is reported (short, unless its share is 0); documents of unlisted or null sources take no part; null texts
    have no tokens. Hot sources need no care: all is partial sums and filters.
    """
    measured = cut(sized(docs, targets, path=path))
    first = cut(histogram(measured))
    plan = cut(budgets(first, targets))
    cuts = thresholds(measured, plan, first)
    part = plan.select("source", "full", "max_repeats", "rest").join(cuts, "source")
    used = measured.join(part, "source").select("doc_id", "source", "tokens", (F.col("full") + F.when((F.col("rest") > 0) & (F.col("h") < F.col("threshold")), 1).otherwise(0)).alias("uses"))
    spent = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"))
    report = plan.join(spent, "source", "left").fillna(0, ["used_tokens"])
    report = report.withColumn("actual_share", F.col("used_tokens") / F.sum("used_tokens").over(Window.partitionBy(F.lit(0))))
    return used, report.select("source", "target_share", "max_repeats", "docs", "tokens", "wanted", "short", "used_tokens", "actual_share")


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, d, "documents"), read(spark, d, "mix_targets")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture(*_inputs(spark, d))[1].where("short").select("source")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture(*_inputs(spark, d))[1]


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture(*_inputs(spark, d))[0].where("uses > 0")


QUERIES = {"p9_found": p9_found, "p9_report": p9_report, "p9_mix": p9_mix}
SQL: dict[str, str] = {}
