"""Why a document ranked where it did, or why it was missed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.weights import REWRITE_DAMPEN, RRF_K, contribution, route_label
from quern.operators.fusion import fuse_positions, provenance
from quern.operators.lexical import numbered
from quern.operators.search import fused_hits, near_texts, readable, route_depth, route_hits, routes, vector_routes
from quern.operators.vectors import collapse_parents
from quern.session import cut


def contributions(scans: DataFrame) -> DataFrame:
    """Scan rows with what each adds to its document's score by its raw rank, undamped, and its similarity."""
    return scans.withColumn("contribution", F.round(contribution(F.col("weight"), F.col("rank")), 9)).withColumn("similarity", F.round(1 - F.col("distance"), 6))


def existing_only(scans: DataFrame, parents: DataFrame) -> DataFrame:
    """Scan rows whose document is among parents(doc_id); ranks keep the gaps."""
    return scans.join(parents.select("doc_id").distinct(), "doc_id", "left_semi")


def first_by_route(scans: DataFrame, targets: DataFrame) -> DataFrame:
    """(qid, route, rank, distance, doc_id) of the first target document in each route; targets(qid, doc_id)."""
    hit = scans.join(targets.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi")
    return hit.groupBy("qid", "route").agg(F.min(F.struct("rank", "doc_id", "distance", "weight")).alias("m")).select("qid", "route", "m.rank", "m.distance", "m.doc_id", "m.weight")


def attach_distance(hits: DataFrame, scans: DataFrame) -> DataFrame:
    """hits(qid, route, doc_id, ...) with the scan's least distance, null where the scan lacks the document."""
    least = scans.groupBy("qid", "route", "doc_id").agg(F.min("distance").alias("distance"))
    return hits.join(least, ["qid", "route", "doc_id"], "left")


def diagnose(scans: DataFrame, targets: DataFrame, *, k: int = 5, dampen: float = 0.35, rrf_k: int = RRF_K, asked: DataFrame | None = None) -> DataFrame:
    """(qid, hit_routes, missed_routes, fused_score, fused_rank, verdict) of each query's target, which may be several documents.

    asked(qid): the queries that have a target, where targets has only those documents of it that the scans have.

    The fused score adds each route's first target, damped where route 0 has any target; the fused rank is the best
    place of a single target in the fused order of all scans.
    """
    all_routes = scans.groupBy("qid").agg(F.array_sort(F.collect_set("route")).alias("routes"))
    first = first_by_route(scans, targets)
    per = first.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("route", "rank", "weight"))).alias("hits"))
    damp = lambda h: F.when((h["route"] > 0) & F.exists("hits", lambda x: x["route"] == 0), F.lit(float(dampen))).otherwise(F.lit(1.0))
    score = F.aggregate("hits", F.lit(0.0), lambda acc, h: acc + h["weight"] / (rrf_k + h["rank"]) * damp(h))
    fused = fuse_positions(scans.withColumn("pos", F.col("rank")), k=rrf_k, dampen=dampen).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")).cast("long"))
    best = fused.join(targets.select("qid", "doc_id").distinct(), ["qid", "doc_id"], "left_semi").groupBy("qid").agg(F.min("place").alias("fused_rank"))
    asked = (targets if asked is None else asked).select("qid").distinct()
    d = asked.join(all_routes, "qid").join(per, "qid", "left").join(best, "qid", "left")
    hit = F.coalesce(F.transform("hits", lambda h: h["route"]), F.array().cast("array<int>"))
    verdict = (
        F.when(F.size(hit) == 0, "not recalled by any route")
        .when((F.size(hit) == 1) & (F.get(hit, F.lit(0)) == 0), "recalled by the original query only")
        .when(~F.array_contains(hit, 0), "recalled by rewrites only")
        .when(F.col("fused_rank") > k, "recalled but below the top k")
        .otherwise("in the top k")
    )
    return d.select("qid", hit.alias("hit_routes"), F.array_except("routes", hit).alias("missed_routes"), F.round(F.coalesce(score, F.lit(0.0)), 9).alias("fused_score"), "fused_rank", verdict.alias("verdict"))


def scan_depth(k: int, scan_k: int | None = None) -> int:
    return scan_k if scan_k and scan_k > 0 else max(10 * k, 100)


def scan_routes(queries: DataFrame, docs: DataFrame, *, k: int = 5, scan_k: int | None = None, parents: DataFrame | None = None, **weighing: object) -> DataFrame:
    """(qid, route, doc_id, rank, distance, weight): each route's nearest documents, far deeper than search goes.

    parents(doc_id, parent_id), if given, tells that docs are parts: each parent then stands at its best part's place, ranks close up.
    """
    r = routes(queries, **weighing)
    near = vector_routes(r, docs, scan_depth(k, scan_k))
    if parents is not None:
        keyed = near.select(F.struct("qid", "route").alias("qid"), "doc_id", "distance", "rank")
        near = collapse_parents(keyed, parents).select("qid.qid", "qid.route", F.col("parent_id").alias("doc_id"), "rank", "distance")
    return near.join(r.select("qid", "route", "weight"), ["qid", "route"])


def traced(queries: DataFrame, docs: DataFrame, *, k: int = 5, scan_k: int | None = None, per_route: int | None = None, collection: str | None = None, acl: list[str] | None = None, **weighing: object) -> tuple[DataFrame, DataFrame]:
    """(scans, found): what scan_routes and route_hits give for a search, from one pass over the documents' vectors; both are kept."""
    docs = readable(docs, collection, acl)
    r = routes(queries, **weighing)
    texts = numbered(r)
    near = cut(near_texts(texts, docs, max(scan_depth(k, scan_k), route_depth(k, per_route))))
    asked = r.select("qid", "route", "query", "weight").join(texts, "query")
    scans = asked.join(near.where(F.col("rank") < scan_depth(k, scan_k)), "text_id").select("qid", "route", "doc_id", "rank", "distance", "weight")
    return cut(scans), cut(route_hits(queries, docs, k=k, per_route=per_route, near=(texts, near), **weighing))


def explained(queries: DataFrame, docs: DataFrame, targets: DataFrame | None = None, *, k: int = 5, dampen: float = REWRITE_DAMPEN, **how: object) -> tuple[DataFrame, DataFrame | None]:
    """(hits, target): a search with all that led to its hits, and what became of the targets(qid, doc_id).

    hits: (qid, place, doc_id, rrf, route, label, rank, ann_dist, contribution), a row for each hit and route that found
    it; target: diagnose's row for each query that has targets. how: what traced takes.
    """
    scans, found = traced(queries, docs, k=k, **how)
    best = fused_hits(found, k, dampen=dampen)
    where = provenance(found).join(found.select("qid", "route", "weight").distinct(), ["qid", "route"])
    detail = best.select("qid", "doc_id", "place", F.col("score").alias("rrf")).join(where, ["qid", "doc_id"]).withColumn("rank", F.col("pos"))
    rows = attach_distance(detail, scans).select(
        "qid", "place", "doc_id", "rrf", "route", route_label(F.col("route")).alias("label"), F.col("rank").cast("long").alias("rank"), F.col("distance").alias("ann_dist"), F.round(contribution(F.col("weight"), F.col("rank")), 9).alias("contribution")
    )
    return rows, None if targets is None else diagnose(scans, targets, k=k, dampen=dampen)


def explain_json(hits: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """(qid, json): an object a query, with its hits in order, the routes of each, and the target's fate if there is one."""
    each = hits.groupBy("qid", "place", "doc_id", "rrf").agg(F.array_sort(F.collect_list(F.struct("route", "label", "rank", "ann_dist", "contribution"))).alias("route_detail"))
    per = each.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("rank"), "doc_id", "rrf", "route_detail"))).alias("hits"))
    if target is None:
        return per.select("qid", F.to_json(F.struct("qid", "hits")).alias("json"))
    fate = target.select("qid", F.struct(*[c for c in target.columns if c != "qid"]).alias("target"))
    return per.join(fate, "qid", "full").select("qid", F.to_json(F.struct("qid", "hits", "target")).alias("json"))
