"""Exact nearest neighbours by cosine distance, in blocks; and a hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import terms
from quern.operators.best import Best

#: Numbers in a block of query vectors, which is sent to all tasks: 32 MB.
BLOCK = 4_000_000


#: Terms whose hashes a task keeps.
MOST_HASHES = 200_000
#: Products of vectors that are held at once.
PRODUCTS = 4_000_000


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """q @ d.T. Small whole numbers, as of hashed embeddings, are multiplied in single precision, which is exact for them."""
    if len(d) and np.abs(q).sum(axis=1).max() * np.abs(d).max() < 2**24 and (q == np.rint(q)).all() and (d == np.rint(d)).all():
        return q.astype(np.float32) @ d.astype(np.float32).T
    return q @ d.T


def _vectors(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _add_nearest(best: Best, q: np.ndarray, nq: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
    """Cosine distances, rounded so that equal ones tie; only those that can be among a query's best are worked out."""
    nd = np.linalg.norm(d, axis=1)
    d, ids, nd = d[nd > 0], ids[nd > 0], nd[nd > 0]
    if not len(d):
        return
    dot = _products(q, d)
    like = dot / nd.astype(dot.dtype)
    least = (1 - best.limit - 1e-5) * nq
    some = np.nonzero(np.isinf(least))[0]
    if len(some):
        far = max(len(d) - best.k, 0)
        least[some] = np.partition(like[some], far, axis=1)[:, far] - 1e-5 * nq[some]
    i, j = np.nonzero(like >= least.astype(dot.dtype)[:, None])
    best.add(i, np.round(1 - dot[i, j].astype(np.float64) / (nq[i] * nd[j]), 6) + 0.0, ids[j])  # no negative zero


def _nearest(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q = shared.value
        nq, best, step = np.linalg.norm(q, axis=1), Best(len(q), k), max(64, PRODUCTS // len(q))
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at in range(0, len(ids), step):
                _add_nearest(best, q, nq, _vectors(batch.column("vec").slice(at, step)), ids[at : at + step])
        for rows in best.rows(qids, "distance"):
            yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

    return run


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, *, block: int = BLOCK) -> DataFrame:
    """(qid, doc_id, distance, rank): the k nearest vectors of each query, rank from 0; ties by doc_id.

    queries(qid, vec), corpus(doc_id, vec), vectors of one length. The corpus stays where it is: each of its tasks meets
    a block of queries as a matrix product and hands on at most k neighbours a query. A block has at most so many numbers, whatever
    the number of queries; with more queries the corpus is read once for each block. A query's own vector is
    among its neighbours. Null and zero vectors have none.
    """
    spark = queries.sparkSession
    good = lambda df: df.where(F.col("vec").isNotNull() & (F.size("vec") > 0))
    asked, docs = good(queries).select("qid", "vec"), good(corpus).select("doc_id", "vec")
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *corpus.schema)}
    schema = f"qid {kinds['qid']}, doc_id {kinds['doc_id']}, distance double"
    size = asked.agg(F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()[0]
    n_blocks = -(-size // block)
    found = spark.createDataFrame([], schema)
    for b in range(n_blocks):
        some = asked.where(F.pmod(F.xxhash64("qid"), F.lit(n_blocks)) == b).toPandas()  # about BLOCK numbers
        q = np.vstack(some["vec"]).astype(np.float64) if len(some) else np.zeros((0, 1))
        good_q = np.linalg.norm(q, axis=1) > 0
        if good_q.any():
            shared = spark.sparkContext.broadcast((some["qid"].to_numpy()[good_q], q[good_q]))
            found = found.unionByName(docs.mapInArrow(_nearest(shared, k), schema))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("distance", "doc_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select("qid", "doc_id", "distance", (F.col("place") - 1).cast("long").alias("rank"))


def collapse_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(qid, parent_id, distance, rank) of hits(qid, doc_id, distance, rank): each parent stands at its best child's place.

    parents(doc_id, parent_id) is the child table; children without a parent are dropped. Ranks close up.
    """
    first = hits.join(parents.where("parent_id is not null"), "doc_id").groupBy("qid", "parent_id").agg(F.min(F.struct("rank", "distance")).alias("m"))
    place = F.row_number().over(Window.partitionBy("qid").orderBy("m.rank"))
    return first.select("qid", "parent_id", F.col("m.distance").alias("distance"), (place - 1).cast("long").alias("rank"))


def _folded(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, len(whole), 1000)):
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            different = coded.dictionary.to_pylist()
            if len(known) + len(different) > MOST_HASHES:
                known.clear()
            for w in different:
                if w not in known:
                    known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            h = np.array([known[w] for w in different], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]
            cell = np.repeat(np.arange(len(batch)), pc.list_value_length(words).to_numpy(zero_copy_only=False)) * size + h % size
            vec = np.bincount(cell, np.where(h // size % 2 == 0, 1.0, -1.0), minlength=len(batch) * size).reshape(len(batch), size)
            good = np.nonzero(vec.any(axis=1))[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(good) + 1, dtype=np.int32) * size), pa.array(vec[good].astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(good)), lists], ["doc_id", "vec"])

    return run


def hash_embedding(docs: DataFrame, *, size: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, vec): signed feature hashing of the text's terms, in whole numbers; texts whose terms cancel out or are none have no vector.

    A term counts by the first 32 bits of its MD5, which are worked out once for all its places in a batch.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), terms(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    kind = T.StructType([words.schema["doc_id"], T.StructField("vec", T.ArrayType(T.FloatType()))])
    return words.mapInArrow(_folded(size), kind)
