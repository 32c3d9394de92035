"""Problem 8: evaluation passages inside training documents, by window seeds and local alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.tokens import WordHash, grams, is_ideographic, words
from quern.session import cut, read

#: Test windows up to this number are sent to all tasks, to count them where the documents are read; beyond it, all are joined.
MOST_SENT = 4_000_000
SEED = T.StructType([T.StructField("id", T.LongType()), T.StructField("gram", T.LongType())])
WINDOWS = T.StructType([*SEED.fields, T.StructField("n", T.LongType())])
PAIR = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType())])
#: Two thirds of a piece's words must agree: texts made from one pattern with other names and numbers don't align.
MATCH, MISMATCH, GAP = 1, -2, -2
#: What a further piece of the same passage costs, in score: more than runs of common phrases reach.
PIECE, PIECE_IDEOGRAPHS = 9, 14


def _item_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = WordHash()
    for df in batches:
        rows = []
        for i, text in zip(df["id"], df["text"], strict=True):
            ws = words(text)
            g, n = np.unique(grams(hashed(ws), 6 if is_ideographic(ws) else 3), return_counts=True)
            rows += zip([i] * len(g), g.view(np.int64).tolist(), n.tolist())
        yield pd.DataFrame(rows, columns=WINDOWS.names).astype("int64")


def _doc_windows(hashed: WordHash, text: str | None) -> np.ndarray:
    h = hashed(words(text))
    # a text may mix both kinds of writing
    return np.unique(np.concatenate([grams(h, 3), grams(h, 6)]))


def _seeds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashed = WordHash()
    for df in batches:
        found = [_doc_windows(hashed, text) for text in df["text"]]
        yield pd.DataFrame({"id": np.repeat(df["id"].to_numpy(dtype=np.int64), [len(g) for g in found]), "gram": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)})


def _met(wanted: pd.DataFrame):
    """The pairs of a document and an item of wanted(id, gram, n, need), counted where the document is read."""
    wanted = wanted.assign(gram=wanted["gram"].to_numpy(dtype=np.int64).view(np.uint64)).sort_values("gram")
    windows, first = np.unique(wanted["gram"].to_numpy(), return_index=True)
    first = np.append(first, len(wanted))
    item, ids = pd.factorize(wanted["id"])
    item, times = item.astype(np.int32), wanted["n"].to_numpy(dtype=np.int32)
    need = np.zeros(len(ids), dtype=np.int64)
    need[item] = wanted["need"]
    ids = ids.to_numpy(dtype=np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashed = WordHash()
        for df in batches:
            docs, found = [], []
            for i, text in zip(df["id"], df["text"], strict=True):
                g = _doc_windows(hashed, text)
                at = np.searchsorted(windows, g)
                at = at[windows[np.minimum(at, len(windows) - 1)] == g]
                if not len(at):
                    continue
                many = first[at + 1] - first[at]
                rows = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
                some, place = np.unique(item[rows], return_inverse=True)
                some = some[np.bincount(place, times[rows]) >= need[some]]
                docs.append(np.full(len(some), i, dtype=np.int64))
                found.append(ids[some])
            if docs:
                yield pd.DataFrame({"doc_id": np.concatenate(docs), "item_id": np.concatenate(found)})

    return run


def candidates(docs: DataFrame, items: DataFrame, *, least: int = 2, least_share: float = 0.18, most_sent: int = MOST_SENT) -> DataFrame:
    """(doc_id, item_id) of documents that hold at least least, and the share least_share, of an item's windows.

    docs(id, text), items(id, text). All windows of an item are seeds, each as often as the item has it, so how many
    documents hold an excerpt doesn't matter. Two fifths of a passage have two fifths of its windows, less two (five of
    ideographs) at the end of a piece and three (six) at each replaced word; at one replaced word in six, 20 % are left.
    """
    each = items.select("id", "text").mapInPandas(_item_windows, WINDOWS).groupBy("id", "gram").agg(F.sum("n").alias("n"))
    of = F.sum("n").over(Window.partitionBy("id"))
    wanted = cut(each.withColumn("need", F.least(of, F.greatest(F.lit(least), F.ceil(of * least_share)))))
    if (n := wanted.count()) == 0:
        return docs.select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("item_id")).limit(0)
    if n <= most_sent:
        return docs.select("id", "text").mapInPandas(_met(wanted.toPandas()), PAIR).distinct()
    hits = docs.select("id", "text").distinct().mapInPandas(_seeds, SEED)
    met = hits.join(wanted.withColumnRenamed("id", "item_id"), "gram").groupBy(F.col("id").alias("doc_id"), "item_id", "need").agg(F.sum("n").alias("met"))
    return met.where("met >= need").select("doc_id", "item_id")


def aligned(docs: list[np.ndarray], items: list[np.ndarray], piece: list[int]) -> np.ndarray:
    """How many words of each item its document holds in order, by local alignment (Smith and Waterman) in several pieces.

    All pairs are aligned at once, a document's word at a time. A cell holds its score times unit plus its matches.
    A new piece may start after the best cell above and to the left of it, for a fixed cost.
    """
    n, m = max(map(len, docs)), max(map(len, items))
    unit = 1 << max(12, m.bit_length())
    d = np.full((len(docs), n), 1, dtype=np.uint64)
    t = np.full((len(items), m), 2, dtype=np.uint64)
    for k, (x, y) in enumerate(zip(docs, items, strict=True)):
        d[k, : len(x)], t[k, : len(y)] = x, y
    cost = np.array(piece, dtype=np.int64)[:, None] * unit
    row = np.zeros((len(docs), m + 1), dtype=np.int64)
    best = np.zeros_like(row)
    slope = np.arange(m + 1, dtype=np.int64) * (-GAP * unit)
    for i in range(n):
        same = d[:, i : i + 1] == t
        step = np.where(same, MATCH * unit + 1, MISMATCH * unit)
        start = np.maximum(row[:, :-1], best[:, :-1] - cost)
        new = np.zeros_like(row)
        np.maximum(start + step, row[:, 1:] + GAP * unit, out=new[:, 1:])
        np.maximum(new, 0, out=new)
        row = np.maximum.accumulate(new + slope, axis=1) - slope
        np.maximum(best, np.maximum.accumulate(row, axis=1), out=best)
    return best[:, -1] & (unit - 1)


@F.pandas_udf(T.DoubleType())
def _held(docs: pd.Series, items: pd.Series) -> pd.Series:
    """The share of the item's words that the document holds in order."""
    hashed = WordHash()
    out = np.zeros(len(docs))
    pairs = [(k, words(a), words(b)) for k, (a, b) in enumerate(zip(docs, items, strict=True))]
    pairs = sorted((x for x in pairs if x[1] and x[2]), key=lambda x: len(x[1]))
    s = 0
    while s < len(pairs):  # pairs of like length together, fewer where they are very long
        some = pairs[s : s + 64]
        some = [x for k, x in enumerate(some) if k == 0 or (k + 1) * len(x[1]) <= 1 << 22]
        s += len(some)
        got = aligned([hashed(a) for _, a, _ in some], [hashed(b) for _, _, b in some], [PIECE_IDEOGRAPHS if is_ideographic(b) else PIECE for _, _, b in some])
        for (k, _, b), n in zip(some, got, strict=True):
            out[k] = n / len(b)
    return pd.Series(out)


def leaks(docs: DataFrame, items: DataFrame, *, share: float = 0.4) -> DataFrame:
    """(doc_id, item_id, held): documents that hold at least share of an item's words in the item's order.

    docs(id, text), items(id, text). Case, punctuation, spacing and markup don't count. Null and empty texts hold
    nothing; rows without id take no part; repeated ids count as one.
    """
    docs, items = (x.select("id", "text").where("id is not null") for x in (docs, items))
    pairs = cut(candidates(docs, items))
    texts = docs.join(pairs.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    both = pairs.join(texts.select(F.col("id").alias("doc_id"), F.col("text").alias("td")), "doc_id").join(items.select(F.col("id").alias("item_id"), F.col("text").alias("ti")), "item_id")
    return both.select("doc_id", "item_id", _held("td", "ti").alias("held")).where(F.col("held") >= share).groupBy("doc_id", "item_id").agg(F.max("held").alias("held"))


def _inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return (
        read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"),
        read(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("passage").alias("text")),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(*_inputs(spark, d)).select("doc_id", "item_id")


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Of each leaked item, the number of documents and the greatest share held."""
    return leaks(*_inputs(spark, d)).groupBy("item_id").agg(F.count("*").alias("docs"), F.round(F.max("held"), 6).alias("most_held"))


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
