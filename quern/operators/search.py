"""Batch search over several routes a query, fused; and query rewriting with a cache."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import has_cjk, strip
from quern.functions.weights import MAX_REWRITES, REWRITE_DAMPEN, route_weight
from quern.operators.fusion import rrf_fuse, top_k
from quern.operators.lexical import best_matches, numbered
from quern.operators.vectors import cosine_topk, hash_embedding


def needs_rewrite(query: Column) -> Column:
    return F.coalesce((strip(query) != "") & has_cjk(query), F.lit(False))


def parse_variants(raw: Column) -> Column:
    """A model's answer as at most five terms: split at commas, semicolons and line ends; 2 to 60 characters, no ideographs."""
    parts = F.transform(F.split(raw, "[,，\n;；]"), lambda x: F.btrim(x, F.lit(' -•\t"\'')))
    return F.slice(F.filter(parts, lambda x: (F.length(x) >= 2) & (F.length(x) <= 60) & ~has_cjk(x) & (F.lower(x) != "thinking")), 1, 5)


def cache_key(query: Column, base: str, model: Column) -> Column:
    return F.sha1(F.concat_ws("\u0000", F.lower(strip(query)), F.lit(base), model))


def cached_variants(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """queries(qid, query, key) with variants from the cache(qhash, variants); a miss or an empty entry gives none."""
    hit = cache.select(F.col("qhash").alias("key"), F.col("variants").alias("_variants")).where(F.size("_variants") > 0)
    return queries.join(hit, "key", "left").withColumn("variants", F.coalesce("_variants", F.array().cast("array<string>"))).drop("_variants")


def upsert_cache(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh entries in place of older ones of the same key; empty results aren't stored."""
    new = fresh.where(F.size("variants") > 0)
    return cache.join(new, "qhash", "left_anti").unionByName(new.select(*cache.columns))


def rewritten(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """queries(qid, query, key) with the variants that a rewriter's cache has: only for queries that need rewriting, split and checked.

    cache(qhash, variants). A miss leaves a query as it is: search goes on without rewrites.
    """
    found = cached_variants(queries, cache)
    parsed = parse_variants(F.array_join("variants", ";"))
    return found.withColumn("variants", F.when(needs_rewrite(F.col("query")), parsed).otherwise(F.array().cast("array<string>")))


def routes(queries: DataFrame, *, most: int = MAX_REWRITES, **weighing: object) -> DataFrame:
    """(qid, route, query, weight): the query itself, then at most four rewrites. Empty queries have no routes; weighing: as in route_weight."""
    clean = F.slice(F.filter(F.coalesce("variants", F.array().cast("array<string>")), lambda v: v.isNotNull() & (strip(v) != "")), 1, most)
    q = queries.select("qid", strip(F.col("query")).alias("query"), clean.alias("variants")).where("query <> ''")
    all_routes = q.select("qid", F.size("variants").alias("n"), F.posexplode(F.concat(F.array("query"), "variants")).alias("route", "query"))
    return all_routes.select("qid", "route", "query", route_weight(F.col("route"), F.col("n"), **weighing).alias("weight"))


def readable(docs: DataFrame, collection: str | None, acl: list[str] | None) -> DataFrame:
    """docs of the collection that share an entry with acl, where these are given."""
    if collection is not None:
        docs = docs.where(F.col("collection") == collection)
    if acl is not None:
        docs = docs.where(F.coalesce(F.arrays_overlap("acl", F.array(*map(F.lit, acl))), F.lit(False)))
    return docs


def near_texts(texts: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """(text_id, doc_id, rank, distance): the nearest documents of each of texts(text_id, query) by hashed embeddings."""
    vectors = hash_embedding(texts, id_col="text_id", text_col="query").withColumnRenamed("doc_id", "qid")
    return cosine_topk(vectors, hash_embedding(docs), depth).withColumnRenamed("qid", "text_id").select("text_id", "doc_id", "rank", "distance")


def vector_routes(asked: DataFrame, docs: DataFrame, depth: int) -> DataFrame:
    """(qid, route, doc_id, rank, distance): each route's nearest documents by hashed embeddings; equal wordings are looked for once."""
    texts = numbered(asked)
    return asked.select("qid", "route", "query").join(texts, "query").join(near_texts(texts, docs, depth), "text_id").select("qid", "route", "doc_id", "rank", "distance")


def recall(asked: DataFrame, docs: DataFrame, depth: int, *, lexical: bool = True, vector: bool = True, rerank: Callable[[DataFrame], DataFrame] | None = None, near: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(qid, route, doc_id, rank): each route's documents in order, those of BM25 and of the nearest vectors fused as equals.

    asked(qid, route, query), docs(doc_id, text). Each different wording is looked for once. rerank: gets (qid, route, query, doc_id,
    text, rank) and returns (qid, route, doc_id, rank) in its own order. near: the numbered wordings and what near_texts gave
    for them, at least as deep, if that is known already.
    """
    docs = docs.select("doc_id", "text")
    texts, known = near or (numbered(asked), None)
    lists = []
    if lexical:
        lists.append(best_matches(texts, docs, depth).select("text_id", "doc_id", "rank", F.lit(0).alias("list")))
    if vector:
        found = near_texts(texts, docs, depth) if known is None else known.where(F.col("rank") < depth)
        lists.append(found.select("text_id", "doc_id", "rank", F.lit(1).alias("list")))
    if len(lists) == 1:
        order = lists[0].select("text_id", "doc_id", "rank")
    else:
        both = lists[0].unionByName(lists[1]).select(F.col("text_id").alias("qid"), F.col("list").alias("route"), "doc_id", "rank", F.lit(1.0).alias("weight"))
        fused = rrf_fuse(both, dedup=True).withColumn("score", F.round("score", 9))
        order = top_k(fused, depth).select(F.col("qid").alias("text_id"), "doc_id", (F.col("place") - 1).alias("rank"))
    routed = asked.select("qid", "route", "query").join(texts, "query").join(order, "text_id").drop("text_id")
    if rerank is None:
        return routed.select("qid", "route", "doc_id", "rank")
    return rerank(routed.join(docs, "doc_id")).select("qid", "route", "doc_id", "rank")


def route_depth(k: int, per_route: int | None = None) -> int:
    return per_route if per_route and per_route > 0 else max(2 * k, 10)


def route_hits(queries: DataFrame, docs: DataFrame, *, k: int = 5, per_route: int | None = None, collection: str | None = None, acl: list[str] | None = None, lexical: bool = True, vector: bool = True, rerank: Callable[[DataFrame], DataFrame] | None = None, near: tuple[DataFrame, DataFrame] | None = None, **weighing: object) -> DataFrame:
    """(qid, route, doc_id, rank, weight): what each route of queries(qid, query, variants) finds, before fusion."""
    r = routes(queries, **weighing)
    found = recall(r, readable(docs, collection, acl), route_depth(k, per_route), lexical=lexical, vector=vector, rerank=rerank, near=near)
    return found.join(r.select("qid", "route", "weight"), ["qid", "route"])


def fused_hits(hits: DataFrame, k: int, *, dampen: float = REWRITE_DAMPEN) -> DataFrame:
    """(qid, doc_id, score, n_routes, place): the k best of each query over its routes."""
    return top_k(rrf_fuse(hits, dampen=dampen, dedup=True).withColumn("score", F.round("score", 9)), k)


def search(queries: DataFrame, docs: DataFrame, *, k: int = 5, dampen: float = REWRITE_DAMPEN, **how: object) -> DataFrame:
    """(qid, doc_id, score, n_routes, place) of queries(qid, query, variants) over docs(doc_id, text, and collection, acl if asked for).

    how: what route_hits takes (per_route, collection, acl, lexical, vector, rerank, weights, original, rewrite, share_budget,
    budget). Empty queries, and k <= 0, have no hits. The payload of the hits is to be joined afterwards, by their ids alone.
    """
    return fused_hits(route_hits(queries if k > 0 else queries.limit(0), docs, k=k, **how), k, dampen=dampen)


def hits_json(hits: DataFrame) -> DataFrame:
    """(qid, json): an object a query with its hits in order, each with the columns that hits has."""
    rest = [c for c in hits.columns if c not in ("qid", "place")]
    return hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", *rest))).alias("hits")).select("qid", F.to_json(F.struct("qid", "hits")).alias("json"))
