"""Recall, MRR, NDCG and retention of ranked results; samples of documents for an evaluation set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import has_cjk, squeeze, strip, url_host
from quern.functions.weights import REWRITE_DAMPEN
from quern.operators.search import fused_hits, route_hits, search
from quern.session import cut

#: Titles that make poor evaluation documents (fixed values).
NOISE_TITLE = (
    "(?i)(sponsored|advertisement|weekly\\s+(issue|roundup)|roundup|newsletter|monthly\\s+update|links?\\s+for\\s+the\\s+week|this week in|digest|"
    "we(’|')?re hiring|job posting|announcing\\s+our\\s+pricing|released|release notes|award|seminar|partnership|office hours|video|alumni|resume|prison program)"
)


def by_source(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, source_doc, place): ranked hits(qid, doc_id, place) with each source at its first place, places closed up."""
    first = hits.join(docs.select("doc_id", "source_doc"), "doc_id").groupBy("qid", "source_doc").agg(F.min("place").alias("p"))
    return first.select("qid", "source_doc", F.row_number().over(Window.partitionBy("qid").orderBy("p", "source_doc")).cast("long").alias("place"))


def relevant_rank(ranked: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(qid, rank): the place of each query's relevant source among the first k, or null; truth(qid, source_doc)."""
    hit = ranked.where(F.col("place") <= k).join(truth, ["qid", "source_doc"]).groupBy("qid").agg(F.min("place").alias("rank"))
    return truth.select("qid").distinct().join(hit, "qid", "left")


def metrics(ranks: DataFrame) -> DataFrame:
    """(n, recall, mrr, ndcg) of (qid, rank); with one relevant source a query, its gain is 1 / log2(rank + 1)."""
    r = F.col("rank")
    one = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 6)
    return ranks.agg(F.count("*").alias("n"), one(F.when(r.isNotNull(), 1.0)).alias("recall"), one(1 / r).alias("mrr"), one(1 / F.log2(r + 1)).alias("ndcg"))


def evaluate(queries: DataFrame, truth: DataFrame, docs: DataFrame, *, k: int = 10, **how: object) -> DataFrame:
    """(n, recall, mrr, ndcg) of a search of queries(qid, query, variants) over docs(doc_id, text, source_doc); truth(qid, source_doc).

    A source counts at its first hit. how: what search takes.
    """
    hits = search(queries, docs, k=k, **how)
    return metrics(relevant_rank(by_source(hits, docs), truth, k))


def search_retention(queries: DataFrame, docs: DataFrame, *, k: int = 5, dampen: float = REWRITE_DAMPEN, **how: object) -> DataFrame:
    """retention of a search with rewrites beside the same without them: route 0 alone is that search."""
    found = cut(route_hits(queries, docs, k=k, **how))
    return retention(fused_hits(found.where("route = 0"), k), fused_hits(found, k, dampen=dampen), found, k)


def retention(base: DataFrame, full: DataFrame, routes: DataFrame, k: int) -> DataFrame:
    """(n, top_retention, original_only_retention, original_only_slots, rewrite_only_per_query).

    base, full: the first k of each query without and with rewrites (qid, doc_id); routes: the routes that found a
    document (qid, doc_id, route). Of base's documents that no rewrite found, the second ratio tells how many stayed; it
    is 1 if there are none. One grouping by query and document gives all counts.
    """
    mark = lambda df, name: df.select("qid", "doc_id", *[F.lit(n == name).alias(n) for n in ("base", "full", "own", "other")])
    seen = routes.select("qid", "doc_id", F.lit(False).alias("base"), F.lit(False).alias("full"), (F.col("route") == 0).alias("own"), (F.col("route") > 0).alias("other"))
    each = mark(base, "base").unionByName(mark(full, "full")).unionByName(seen).groupBy("qid", "doc_id").agg(*[F.max(n).alias(n) for n in ("base", "full", "own", "other")])
    n = lambda condition, name: F.count_if(F.expr(condition)).alias(name)
    per_query = each.groupBy("qid").agg(F.max(F.expr("base or full")).alias("asked"), n("base and full", "kept"), n("base and not other", "slots"), n("base and not other and full", "stayed"), n("full and not own", "fresh"))
    one_row = per_query.agg(n("asked", "n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("kept", "slots", "stayed", "fresh")])
    return one_row.select(
        "n",
        F.round(F.col("kept") / (F.col("n") * k), 6).alias("top_retention"),
        F.when(F.col("slots") > 0, F.round(F.col("stayed") / F.col("slots"), 6)).otherwise(1.0).alias("original_only_retention"),
        F.col("slots").alias("original_only_slots"),
        F.round(F.col("fresh") / F.col("n"), 6).alias("rewrite_only_per_query"),
    )


def clean_answer(raw: Column) -> Column:
    """The query in a generator's answer: its first line, without quotes around it."""
    bare = strip(F.regexp_replace(strip(raw), "^[\"'「『]|[\"'」』]$", ""))
    return strip(F.regexp_extract(bare, "^[^\\r\\n]*", 0))


def build_set(docs: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, source_doc, title, chars): sampled docs(source_doc, title, chars) with the query that answers(source_doc, raw) has for them.

    Answers without ideographs, or of fewer than 4 or more than 30 characters, are dropped; titles are cut at 120 characters.
    """
    asked = answers.select("source_doc", clean_answer(F.col("raw")).alias("query")).where(F.length("query").between(4, 30) & has_cjk(F.col("query")))
    return docs.join(asked, "source_doc").select("query", "source_doc", F.substring("title", 1, 120).alias("title"), "chars")


def sample_documents(chunks: DataFrame, limit: int = 18, *, per_host: int = 2, least_chars: int = 1500, lead_chars: int = 800, least_lead: int = 200) -> DataFrame:
    """(source_doc, title, chars, lead): long documents with a sound title, at most per_host of a host, the longest first.

    chunks(source_doc, chunk_index, id, section, text). The lead takes whole chunks while fewer than lead_chars have been taken;
    the title is the first section that isn't empty.
    """
    place = Window.partitionBy("source_doc").orderBy("chunk_index", "id")
    text = squeeze(F.col("text"))
    before = F.coalesce(F.sum(F.length(text)).over(place.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = chunks.where("source_doc is not null").withColumn("clean", text).withColumn("before", before)
    lead = F.array_sort(F.collect_list(F.when(F.col("before") < lead_chars, F.struct("chunk_index", "id", "clean"))))
    docs = rows.groupBy("source_doc").agg(
        F.sum(F.length("text")).alias("chars"),
        F.min(F.when(F.coalesce(F.col("section"), F.lit("")) != "", F.struct("chunk_index", "id", "section")))["section"].alias("title"),
        F.array_join(F.transform(lead, lambda x: x["clean"]), " ").alias("lead"),
    )
    good = docs.where((F.col("chars") >= least_chars) & (F.length("lead") >= least_lead) & ~F.coalesce(F.col("title").rlike(NOISE_TITLE), F.lit(False)))
    ranked = good.withColumn("host", url_host(F.col("source_doc"))).withColumn("nth", F.row_number().over(Window.partitionBy("host").orderBy(F.desc("chars"), "source_doc")))
    return ranked.where(F.col("nth") <= per_host).orderBy(F.desc("chars"), "source_doc").limit(limit).select("source_doc", "title", "chars", "lead")
