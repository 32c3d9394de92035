"""Weighted reciprocal rank fusion over routes, with damping of what the original route already found."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.weights import RRF_K


def positions(candidates: DataFrame, *, dedup: bool = True) -> DataFrame:
    """candidates(qid, route, doc_id, rank, weight) with pos, the 0-based place in the route.

    With dedup, a document counts at its first place in a route, and places close up; without, rank is the place and
    each occurrence counts.
    """
    if not dedup:
        return candidates.withColumn("pos", F.row_number().over(Window.partitionBy("qid", "route").orderBy("rank", "doc_id")) - 1)
    first = candidates.groupBy("qid", "route", "doc_id", "weight").agg(F.min("rank").alias("rank"))
    return first.withColumn("pos", F.row_number().over(Window.partitionBy("qid", "route").orderBy("rank", "doc_id")) - 1)


def fuse_positions(placed: DataFrame, *, k: int = RRF_K, dampen: float = 1.0) -> DataFrame:
    """(qid, doc_id, score, n_routes) of rows (qid, route, doc_id, pos, weight).

    The terms are added in the order of routes and places, so that equal inputs give bit-equal scores whatever the
    partitioning. Routes above 0 are damped for documents that route 0 has. Null documents are dropped.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    if not 0 <= dampen <= 1:
        raise ValueError("dampen must lie in 0..1")
    terms = placed.where(F.col("doc_id").isNotNull()).groupBy("qid", "doc_id").agg(F.array_sort(F.collect_list(F.struct("route", "pos", "weight"))).alias("terms"))
    original = F.exists("terms", lambda t: t["route"] == 0)
    each = lambda t: t["weight"] / (k + t["pos"]) * F.when((t["route"] > 0) & original, F.lit(float(dampen))).otherwise(F.lit(1.0))
    score = F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + each(t))
    return terms.select("qid", "doc_id", score.alias("score"), F.size("terms").cast("long").alias("n_routes"))


def rrf_fuse(candidates: DataFrame, *, k: int = RRF_K, dampen: float = 1.0, dedup: bool = False) -> DataFrame:
    return fuse_positions(positions(candidates, dedup=dedup), k=k, dampen=dampen)


def top_k(scored: DataFrame, k: int, *, by: str = "qid", score: str = "score", tie: str = "doc_id") -> DataFrame:
    """The k best of each query with their 1-based place; ties go to the smaller id. k <= 0 gives nothing."""
    place = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scored.withColumn("place", F.row_number().over(place).cast("long")).where(F.col("place") <= k)


def provenance(candidates: DataFrame) -> DataFrame:
    """(qid, doc_id, route, raw_rank, pos): where each route had a document; the raw rank is from before the removal of repeats."""
    return positions(candidates).select("qid", "doc_id", "route", F.col("rank").alias("raw_rank"), "pos")
