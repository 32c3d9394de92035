"""The queries of the core library over the given tables, and their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.dates import date_from_url, effective_date, norm_date
from quern.operators import evaluation, explain, fusion, ingest, lexical, search, vectors
from quern.session import cut, read
from quern.sources import feeds, html, tables

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


_TERMS = """list_concat(list_filter(string_split_regex(lower(regexp_replace({c}, '[一-鿿]', ' ', 'g')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''),
 flatten(list_transform(list_filter(string_split_regex({c}, '[^一-鿿]+'), lambda r: length(r) > 1), lambda r: list_transform(range(1, length(r)), lambda i: substring(r, i, 2)))))"""
_TF = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format(c='text')}) AS term FROM documents) GROUP BY doc_id, term"


# ---- text


@query(_TF)
def tokenize_term_freq(spark: SparkSession, d: str) -> DataFrame:
    return lexical.term_frequencies(read(spark, d, "documents"))


@query(f"SELECT term, count(*) AS df FROM ({_TF}) GROUP BY term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return lexical.document_frequencies(lexical.term_frequencies(read(spark, d, "documents")))


@query("SELECT id, sha256(text) AS sha256 FROM chunks")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select("id", tx.content_hash(F.col("text")).alias("sha256"))


@query("SELECT id, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS snippet FROM chunks")
def snippet(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select("id", tx.snippet(F.col("text")).alias("snippet"))


@query("SELECT id, CASE WHEN source_doc LIKE '%//%' THEN split_part(source_doc, '/', 3) ELSE source_doc END AS host FROM chunks")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select("id", tx.url_host(F.col("source_doc")).alias("host"))


@query("SELECT doc_id, CASE WHEN starts_with(text, '#') THEN text ELSE '# ' || title || chr(10) || chr(10) || text END AS body FROM documents")
def markdown_title_prefix(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", ingest.prefixed(F.col("title"), F.col("text")).alias("body"))


@query("SELECT id, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) >= 600 AS long_enough FROM chunks WHERE is_parent")
def min_length_gate(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent").select("id", (F.length(tx.strip(F.col("text"))) >= ingest.LEAST_CHARS).alias("long_enough"))


_NORM = """CASE WHEN regexp_matches({c}, '[0-9]{{4}}[-/][0-9]{{1,2}}[-/][0-9]{{1,2}}') THEN
 regexp_extract({c}, '([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})', 1) || '-' || lpad(regexp_extract({c}, '([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})', 2), 2, '0') || '-' || lpad(regexp_extract({c}, '([0-9]{{4}})[-/]([0-9]{{1,2}})[-/]([0-9]{{1,2}})', 3), 2, '0')
 WHEN list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract({c}, '([0-9]{{1,2}})\\s+([A-Za-z]{{3}})[A-Za-z]*\\s+([0-9]{{4}})', 2))) > 0 THEN
 regexp_extract({c}, '([0-9]{{1,2}})\\s+([A-Za-z]{{3}})[A-Za-z]*\\s+([0-9]{{4}})', 3) || '-' || lpad(CAST(list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract({c}, '([0-9]{{1,2}})\\s+([A-Za-z]{{3}})[A-Za-z]*\\s+([0-9]{{4}})', 2))) AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({c}, '([0-9]{{1,2}})\\s+([A-Za-z]{{3}})[A-Za-z]*\\s+([0-9]{{4}})', 1), 2, '0')
 ELSE '' END"""
_SLASH, _DASH = "/(20[0-9]{2})/([0-9]{1,2})/([0-9]{1,2})(?:/|$)", "/(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})"
_URLDATE = f"""CASE WHEN regexp_matches({{c}}, '{_SLASH.replace("{", "{{").replace("}", "}}")}') THEN regexp_extract({{c}}, '{_SLASH.replace("{", "{{").replace("}", "}}")}', 1) || '-' || lpad(regexp_extract({{c}}, '{_SLASH.replace("{", "{{").replace("}", "}}")}', 2), 2, '0') || '-' || lpad(regexp_extract({{c}}, '{_SLASH.replace("{", "{{").replace("}", "}}")}', 3), 2, '0')
 WHEN regexp_matches({{c}}, '{_DASH.replace("{", "{{").replace("}", "}}")}') THEN regexp_extract({{c}}, '{_DASH.replace("{", "{{").replace("}", "}}")}', 1) || '-' || lpad(regexp_extract({{c}}, '{_DASH.replace("{", "{{").replace("}", "}}")}', 2), 2, '0') || '-' || lpad(regexp_extract({{c}}, '{_DASH.replace("{", "{{").replace("}", "}}")}', 3), 2, '0') ELSE '' END"""


@query(f"SELECT url, date, {_NORM.format(c='date')} AS day FROM feed_items")
def date_normalised(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "feed_items").select("url", "date", norm_date(F.col("date")).alias("day"))


@query(f"SELECT id, {_URLDATE.format(c='source_doc')} AS day FROM chunks")
def date_of_url(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select("id", date_from_url(F.col("source_doc")).alias("day"))


@query(
    f"""WITH x AS (SELECT url, title, try_strptime({_NORM.format(c='date')}, '%Y-%m-%d') AS own, {_URLDATE.format(c='url')} AS path FROM feed_items)
SELECT url, title, CASE WHEN own IS NOT NULL THEN CAST(own AS DATE) WHEN path <> '' THEN CAST(try_strptime(path, '%Y-%m-%d') AS DATE) ELSE DATE '2026-01-01' END AS day FROM x"""
)
def item_effective_date(spark: SparkSession, d: str) -> DataFrame:
    items = read(spark, d, "feed_items")
    return items.select("url", "title", effective_date(norm_date(F.col("date")), F.col("url"), F.lit("2026-01-01").cast("date")).alias("day"))


@query()
def summary_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The summaries without markup: block texts, their kinds and link characters."""
    items = read(spark, d, "feed_items").where("summary is not null").select("url", "title", F.explode(html.html_blocks(F.col("summary"))).alias("b"))
    return items.select("url", "title", "b.kind", "b.text", "b.in_main", "b.link_chars")


@query()
def article_from_html(spark: SparkSession, d: str) -> DataFrame:
    """Documents set as pages, with menu and footer around them, and taken out again."""
    page = F.concat(F.lit("<nav><a href='/'>Home</a></nav><article><h1>"), F.coalesce("title", F.lit("Untitled")), F.lit("</h1><p>"), F.regexp_replace("text", "\n\n", "</p><p>"), F.lit("</p></article><footer>About</footer>"))
    used = html.used_blocks(F.col("blocks"))
    blocks = read(spark, d, "documents").select("doc_id", html.html_blocks(page).alias("blocks"))
    return blocks.select("doc_id", html.article_title(used).alias("title"), html.article_body(used).alias("body"))


# ---- sources, feeds and ingest


@query("SELECT cat, count(*) AS sources FROM sources GROUP BY cat")
def sources_by_category(spark: SparkSession, d: str) -> DataFrame:
    return tables.sources_of(read(spark, d, "sources"), "all").groupBy("cat").agg(F.count("*").alias("sources"))


@query("""SELECT source, url, title, epoch_us(fetched_at) AS fetched_us FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, url NULLS FIRST, title NULLS FIRST, api_id NULLS FIRST) AS n FROM feed_items) WHERE n <= 40""")
def latest_items(spark: SparkSession, d: str) -> DataFrame:
    items = feeds.first_items(read(spark, d, "feed_items"), 40, F.desc("fetched_at"), F.col("url"), F.col("title"), F.col("api_id"))
    return items.select("source", "url", "title", F.unix_micros("fetched_at").alias("fetched_us"))


@query("""SELECT source, title, url, substring(date, 1, 10) AS date, substring(summary, 1, 2000) AS summary, 'en' AS lang, author, api_id FROM feed_items WHERE coalesce(url, '') <> ''""")
def api_list_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Items written as the lists of an article API, a list a source, and read back."""
    as_api = F.struct("title", "url", F.col("date").alias("published_at"), F.substring("summary", 1, 2000).alias("description"), F.col("api_id").alias("id"), F.col("tags").alias("tag_list"), F.struct(F.col("author").alias("name")).alias("user"))
    lists = read(spark, d, "feed_items").select("source", F.to_json(F.array(as_api)).alias("json"))
    return feeds.api_items(lists).select("source", "title", "url", "date", "summary", "lang", "author", "api_id")


_ITEMS = """items AS (SELECT f.source, trim(f.url) AS url, f.title, b.body FROM feed_items f LEFT JOIN
 (SELECT source_doc, arg_min(text, id) AS body FROM chunks WHERE is_parent GROUP BY source_doc) b ON trim(f.url) = b.source_doc),
conflicts AS (SELECT DISTINCT source_doc FROM chunks WHERE collection <> 'techblog'),
known AS (SELECT source_doc, m.sha256 AS old_sha, m.chunks AS old_chunks FROM (SELECT source_doc, max(struct_pack(stored_at := stored_at, sha256 := sha256, chunks := chunks)) AS m FROM manifest GROUP BY source_doc)),
status AS (SELECT i.source, i.url, i.title, length(t.full_text) AS chars, coalesce(k.old_chunks, 0) AS old_chunks, CASE WHEN coalesce(i.url, '') = '' THEN 'no address' ELSE 'no body' END AS reason, CASE WHEN coalesce(i.url, '') = '' THEN 'fail' WHEN c.source_doc IS NOT NULL THEN 'skip' WHEN i.body IS NULL THEN 'fail'
 WHEN length(regexp_replace(i.body, '^\\s+|\\s+$', '', 'g')) < 600 THEN 'skip' WHEN coalesce(sha256(t.full_text) = k.old_sha AND coalesce(k.old_chunks, 0) > 0, false) THEN 'unchanged' ELSE 'ok' END AS status
 FROM items i, LATERAL (SELECT CASE WHEN starts_with(i.body, '#') THEN i.body ELSE '# ' || i.title || chr(10) || chr(10) || i.body END AS full_text) t
 LEFT JOIN conflicts c ON i.url = c.source_doc LEFT JOIN known k ON i.url = k.source_doc)"""


def _status(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "chunks")
    bodies = chunks.where("is_parent and source_doc is not null").groupBy("source_doc").agg(F.min_by("text", "id").alias("body"))
    items = read(spark, d, "feed_items").withColumn("url", F.trim("url")).join(bodies, F.col("url") == F.col("source_doc"), "left").select("source", "url", "title", "body")
    conflicts = ingest.foreign_conflicts(items, chunks, "techblog")
    return ingest.crawl_status(items, read(spark, d, "manifest"), conflicts)


@query(f"WITH {_ITEMS} SELECT source, url, title, status FROM status")
def crawl_status(spark: SparkSession, d: str) -> DataFrame:
    return _status(spark, d).select("source", "url", "title", "status")


_STATS = """CAST(count_if(status = 'ok') AS BIGINT) AS ok, CAST(count_if(status = 'skip') AS BIGINT) AS skip, CAST(count_if(status = 'fail') AS BIGINT) AS fail, CAST(count_if(status = 'unchanged') AS BIGINT) AS unchanged, CAST(coalesce(sum(CASE WHEN status = 'ok' THEN chars END), 0) AS BIGINT) AS words"""


@query(f"""WITH {_ITEMS}, s AS (SELECT source, {_STATS}, CAST(coalesce(sum(CASE WHEN status = 'unchanged' THEN old_chunks END), 0) AS BIGINT) AS saved_chunks,
 coalesce(string_agg(DISTINCT CASE WHEN status = 'fail' THEN reason END, '; ' ORDER BY CASE WHEN status = 'fail' THEN reason END), '') AS fail_reasons FROM status GROUP BY source) SELECT *, CASE WHEN ok > 0 THEN words // ok ELSE 0 END AS avg_words FROM s""")
def crawl_source_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.source_stats(_status(spark, d)).drop("chunks").withColumn("fail_reasons", F.array_join("fail_reasons", "; "))


@query(f"WITH {_ITEMS} SELECT source, {_STATS} FROM status GROUP BY ROLLUP (source)")
def crawl_totals(spark: SparkSession, d: str) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return _status(spark, d).rollup("source").agg(n("ok"), n("skip"), n("fail"), n("unchanged"), F.coalesce(F.sum(F.when(F.col("status") == "ok", F.col("chars"))), F.lit(0)).alias("words"))


@query("""SELECT f.source, f.url, f.title FROM feed_items f WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.collection <> 'techblog' AND c.source_doc = f.url)""")
def conflict_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return ingest.without_conflicts(read(spark, d, "feed_items"), read(spark, d, "chunks"), "techblog").select("source", "url", "title")


@query("SELECT DISTINCT collection FROM chunks")
def distinct_collections(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select("collection").distinct()


@query("SELECT collection, count(*) AS total, CAST(count_if(is_parent) AS BIGINT) AS parents, CAST(count_if(NOT is_parent) AS BIGINT) AS children FROM chunks GROUP BY collection")
def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_counts(read(spark, d, "chunks"))


_LATEST = "SELECT source_doc, arg_max(text, struct_pack(a := crawled_at, b := id)) AS text, max(crawled_at) AS crawled_at FROM chunks WHERE is_parent AND source_doc IS NOT NULL GROUP BY source_doc"


def _latest(spark: SparkSession, d: str) -> DataFrame:
    parents = read(spark, d, "chunks").where("is_parent and source_doc is not null")
    return parents.groupBy("source_doc").agg(F.max_by("text", F.struct("crawled_at", "id")).alias("text"), F.max("crawled_at").alias("crawled_at"))


@query(f"""WITH p AS ({_LATEST}), k AS (SELECT source_doc, max(struct_pack(stored_at := stored_at, sha256 := sha256, chunks := chunks)) AS m FROM manifest GROUP BY source_doc)
SELECT source_doc, CASE WHEN k.source_doc IS NULL THEN 'new' WHEN m.sha256 = sha256(text) AND coalesce(m.chunks, 0) > 0 THEN 'unchanged' ELSE 'changed' END AS state FROM p LEFT JOIN k USING (source_doc)""")
def manifest_incremental(spark: SparkSession, d: str) -> DataFrame:
    known = read(spark, d, "manifest").groupBy("source_doc").agg(F.max(F.struct("stored_at", "sha256", "chunks")).alias("m"))
    same = (F.col("m.sha256") == tx.content_hash(F.col("text"))) & (F.coalesce("m.chunks", F.lit(0)) > 0)
    return _latest(spark, d).join(known, "source_doc", "left").select("source_doc", F.when(F.col("m").isNull(), "new").when(same, "unchanged").otherwise("changed").alias("state"))


@query(f"""WITH p AS ({_LATEST}), k AS (SELECT source_doc, max(struct_pack(stored_at := stored_at, chars := chars, chunks := chunks, sha256 := sha256)) AS m FROM manifest GROUP BY source_doc)
SELECT coalesce(p.source_doc, k.source_doc) AS source_doc, CASE WHEN p.source_doc IS NOT NULL THEN sha256(text) ELSE m.sha256 END AS sha256 FROM p FULL JOIN k ON p.source_doc = k.source_doc""")
def manifest_upsert(spark: SparkSession, d: str) -> DataFrame:
    old = read(spark, d, "manifest").select("source_doc", "stored_at", "chars", "chunks", "sha256")
    fresh = _latest(spark, d).select("source_doc", F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ss").alias("stored_at"), F.length("text").alias("chars"), F.lit(1).alias("chunks"), tx.content_hash(F.col("text")).alias("sha256"))
    return ingest.merge_manifest(old, fresh).select("source_doc", "sha256")


@query("""WITH s AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(text, '(?m)^(#{1,6} )', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> '')) AS s,
 generate_subscripts(list_filter(string_split(regexp_replace(text, '(?m)^(#{1,6} )', chr(1) || '\\1', 'g'), chr(1)), lambda x: x <> ''), 1) - 1 AS section_no FROM documents),
p AS (SELECT doc_id, section_no, unnest(range(0, greatest(1, length(s)), 2000)) AS o, s, trim(regexp_extract(s, '^#{1,6} ([^\\r\\n]*)', 1)) AS section FROM s),
q AS (SELECT doc_id, section_no, section, o // 2000 AS parent_no, substring(s, o + 1, 2000) AS p FROM p),
c AS (SELECT doc_id, section_no, section, parent_no, unnest(range(0, greatest(1, length(p) - 60), 340)) AS o, p FROM q)
SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, CAST(parent_no AS INTEGER) AS parent_no, CAST(o // 340 AS INTEGER) AS child_no, section, md5(p) AS parent_md5, md5(substring(p, o + 1, 400)) AS text_md5, CAST(length(substring(p, o + 1, 400)) AS INTEGER) AS chars FROM c""")
def chunk_two_level(spark: SparkSession, d: str) -> DataFrame:
    parts = ingest.two_level_chunks(read(spark, d, "documents"))
    return parts.select("doc_id", "section_no", "parent_no", "child_no", "section", F.md5("parent_text").alias("parent_md5"), F.md5("text").alias("text_md5"), "chars")


@query("SELECT id, source_doc FROM chunks WHERE collection = 'techblog' AND list_has_any(acl, ['public', 'guest'])")
def acl_collection_filter(spark: SparkSession, d: str) -> DataFrame:
    return tables.visible(read(spark, d, "chunks"), "techblog", ["public", "guest"]).select("id", "source_doc")


@query("SELECT id AS doc_id FROM chunks WHERE collection = 'techblog' AND is_parent AND (source_doc LIKE '%posts_example%' OR CAST(id AS VARCHAR) = 'posts_example')")
def target_pattern(spark: SparkSession, d: str) -> DataFrame:
    return tables.matching_parents(read(spark, d, "chunks"), "techblog", "posts_example")


@query("SELECT c.id, p.source_doc, p.section FROM chunks c JOIN chunks p ON c.parent_id = p.id WHERE NOT c.is_parent AND p.is_parent")
def child_to_parent(spark: SparkSession, d: str) -> DataFrame:
    chunks = read(spark, d, "chunks")
    parents = chunks.where("is_parent").select(F.col("id").alias("pid"), "source_doc", "section")
    return chunks.where("not is_parent and parent_id is not null").select("id", "parent_id").join(parents, F.col("parent_id") == F.col("pid")).select("id", "source_doc", "section")


# ---- rewriting


@query("SELECT item_id, query, coalesce(regexp_replace(query, '^\\s+|\\s+$', '', 'g') <> '' AND regexp_matches(query, '[一-鿿]'), false) AS rewrite FROM eval_items")
def needs_rewrite(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "eval_items").select("item_id", "query", search.needs_rewrite(F.col("query")).alias("rewrite"))


_PARSED = """list_filter(list_transform(string_split_regex(array_to_string(variants, ' ; '), '[,，\\n;；]'), lambda x: trim(x, ' -•' || chr(9) || '"''')), lambda x: length(x) >= 2 AND length(x) <= 60 AND NOT regexp_matches(x, '[一-鿿]') AND lower(x) <> 'thinking')[1:5]"""


@query(f"SELECT qid, coalesce(array_to_string({_PARSED}, '|'), '') AS variants FROM rewrites")
def rewrite_variant_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.array_join("variants", " ; ")
    return read(spark, d, "rewrites").select("qid", F.coalesce(F.array_join(search.parse_variants(raw), "|"), F.lit("")).alias("variants"))


@query("SELECT qid, sha1(lower(regexp_replace(query, '^\\s+|\\s+$', '', 'g')) || chr(0) || 'local' || chr(0) || model) AS key FROM rewrites WHERE model IS NOT NULL")
def rewrite_cache_key(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "rewrites").where("model is not null").select("qid", search.cache_key(F.col("query"), "local", F.col("model")).alias("key"))


@query("SELECT r.qid, CAST(coalesce(len(CASE WHEN len(c.variants) > 0 THEN c.variants END), 0) AS INTEGER) AS n FROM rewrites r LEFT JOIN rewrites c ON c.qhash = r.qhash")
def rewrite_cache_join(spark: SparkSession, d: str) -> DataFrame:
    rewrites = read(spark, d, "rewrites")
    asked = rewrites.select("qid", "query", F.col("qhash").alias("key"))
    return search.cached_variants(asked, rewrites).select("qid", F.size("variants").alias("n"))


_ROUTES = """q AS (SELECT qid, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, list_filter(coalesce(variants, []), lambda v: v IS NOT NULL AND regexp_replace(v, '^\\s+|\\s+$', '', 'g') <> '')[1:4] AS v FROM rewrites),
routes AS (SELECT qid, CAST(r - 1 AS INTEGER) AS route, (list_concat([query], v))[r] AS query, CASE WHEN r = 1 THEN 1.0 ELSE 0.6 / len(v) END AS weight FROM (SELECT *, unnest(range(1, len(v) + 2)) AS r FROM q WHERE query <> ''))"""


@query(f"WITH {_ROUTES} SELECT qid, route, query, round(weight, 9) AS weight FROM routes")
def route_weights(spark: SparkSession, d: str) -> DataFrame:
    return search.routes(read(spark, d, "rewrites")).select("qid", "route", "query", F.round("weight", 9).alias("weight"))


# ---- retrieval


def _bm25_sql(k: int) -> str:
    return f"""{_ROUTES}, tf AS ({_TF}), dl AS (SELECT doc_id, coalesce(len({_TERMS.format(c='text')}), 0) AS dl FROM documents), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT qid, route, unnest(list_distinct({_TERMS.format(c='query')})) AS term FROM routes),
s AS (SELECT qid, route, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY qid, route, doc_id),
bm AS (SELECT *, row_number() OVER (PARTITION BY qid, route ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < {k})"""


@query(f"WITH {_bm25_sql(10)} SELECT qid, route, doc_id, score, rank FROM bm")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    r = search.routes(read(spark, d, "rewrites"))
    return lexical.bm25_topk(r.select("qid", "route", "query"), read(spark, d, "documents"), 10)


def _nearest(spark: SparkSession, d: str, k: int) -> DataFrame:
    e = read(spark, d, "embeddings")
    return vectors.cosine_topk(e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec")), e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec")), k)


_NEAREST = """nearest AS (SELECT q.vec_id AS qid, c.vec_id AS doc_id, round(list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS distance,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6), c.vec_id) - 1 AS rank
 FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0 QUALIFY rank < {k})"""


@query(f"WITH {_NEAREST.format(k=10)} SELECT qid, doc_id, distance, rank FROM nearest")
def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d, 10)


@query(f"""WITH {_NEAREST.format(k=100)}, p AS (SELECT qid, doc_id // 5 AS parent_id, min(rank) AS rank, arg_min(distance, rank) AS distance FROM nearest GROUP BY 1, 2)
SELECT qid, parent_id, distance, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS rank FROM p""")
def parent_collapse(spark: SparkSession, d: str) -> DataFrame:
    family = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.floor(F.col("vec_id") / 5).alias("parent_id"))
    return vectors.collapse_parents(_nearest(spark, d, 100), family)


def _scans(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "scans")


def _fused(score: str, dedup: bool, damp: float = 1.0) -> str:
    source = "SELECT qid, route, doc_id, weight, min(rank) AS rank FROM scans GROUP BY qid, route, doc_id, weight" if dedup else "SELECT * FROM scans"
    return f"""WITH c AS ({source}), p AS (SELECT *, row_number() OVER (PARTITION BY qid, route ORDER BY rank, doc_id) - 1 AS pos FROM c),
o AS (SELECT *, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, doc_id) AS orig FROM p WHERE doc_id IS NOT NULL),
fused AS (SELECT qid, doc_id, round(sum({score} / (60 + pos) * CASE WHEN route > 0 AND orig = 1 THEN {damp} ELSE 1 END), 9) AS score, count(*) AS n_routes FROM o GROUP BY qid, doc_id)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 9))


@query(_fused("1.0", True) + " SELECT * FROM fused")
def rrf_classic(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.rrf_fuse(_scans(spark, d).withColumn("weight", F.lit(1.0)), dedup=True))


@query(_fused("weight", True) + " SELECT * FROM fused")
def rrf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.rrf_fuse(_scans(spark, d), dedup=True))


@query(_fused("weight", True, 0.35) + " SELECT * FROM fused")
def rrf_damped(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.rrf_fuse(_scans(spark, d), dampen=0.35, dedup=True))


@query(_fused("weight", False) + " SELECT * FROM fused")
def rrf_no_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(fusion.rrf_fuse(_scans(spark, d)))


@query(_fused("weight", True, 0.35) + " SELECT qid, doc_id, score, n_routes, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM fused QUALIFY place <= 5")
def fused_top_k(spark: SparkSession, d: str) -> DataFrame:
    return fusion.top_k(_rounded(fusion.rrf_fuse(_scans(spark, d), dampen=0.35, dedup=True)), 5)


@query("""WITH c AS (SELECT qid, route, doc_id, weight, min(rank) AS rank FROM scans GROUP BY qid, route, doc_id, weight)
SELECT qid, doc_id, route, rank AS raw_rank, CAST(row_number() OVER (PARTITION BY qid, route ORDER BY rank, doc_id) - 1 AS INTEGER) AS pos FROM c""")
def route_provenance(spark: SparkSession, d: str) -> DataFrame:
    return fusion.provenance(_scans(spark, d))


_DOCUMENTS = "corpus AS (SELECT doc_id, text FROM documents)"


def _recall_sql(depth: int, scan: int = 0) -> str:
    """recalled: BM25 and nearest vectors of every route over corpus(doc_id, text), fused; scanned: the nearest vectors as far as scan."""
    tf = f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS.format(c='text')}) AS term FROM corpus) GROUP BY doc_id, term"
    cells = "SELECT {key}, h % 256 AS cell, sum(CASE WHEN h // 256 % 2 = 0 THEN 1 ELSE -1 END * n) AS v FROM (SELECT {key}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) AS h, n FROM {source}) GROUP BY {key}, cell"
    return f"""tf AS ({tf}), dl AS (SELECT doc_id, coalesce(len({_TERMS.format(c='text')}), 0) AS dl FROM corpus), tot AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), qa AS (SELECT qid, route, unnest({_TERMS.format(c='query')}) AS term FROM routes), qt AS (SELECT DISTINCT * FROM qa),
s AS (SELECT qid, route, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id), tot GROUP BY qid, route, doc_id),
bm AS (SELECT qid, route, doc_id, row_number() OVER (PARTITION BY qid, route ORDER BY score DESC, doc_id) - 1 AS rank FROM s QUALIFY rank < {depth}),
dc AS ({cells.format(key='doc_id', source='(SELECT doc_id, term, tf AS n FROM tf)')}), qc AS ({cells.format(key='qid, route', source='(SELECT qid, route, term, 1 AS n FROM qa)')}),
dn AS (SELECT doc_id, sqrt(sum(v * v)) AS nd FROM dc GROUP BY doc_id HAVING sum(v * v) > 0), qn AS (SELECT qid, route, sqrt(sum(v * v)) AS nq FROM qc GROUP BY qid, route HAVING sum(v * v) > 0),
dots AS (SELECT qid, route, doc_id, sum(dc.v * qc.v) AS dot FROM dc JOIN qc USING (cell) GROUP BY qid, route, doc_id),
near AS (SELECT qid, route, doc_id, round(1 - CAST(coalesce(dot, 0) AS DOUBLE) / (nq * nd), 6) AS distance FROM qn CROSS JOIN dn LEFT JOIN dots USING (qid, route, doc_id)),
scanned AS (SELECT *, row_number() OVER (PARTITION BY qid, route ORDER BY distance, doc_id) - 1 AS rank FROM near QUALIFY rank < {max(scan, depth)}),
lists AS (SELECT qid, route, doc_id, rank FROM bm UNION ALL SELECT qid, route, doc_id, rank FROM scanned WHERE rank < {depth}),
inner_fused AS (SELECT qid, route, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM lists GROUP BY qid, route, doc_id),
recalled AS (SELECT qid, route, doc_id, row_number() OVER (PARTITION BY qid, route ORDER BY score DESC, doc_id) - 1 AS rank FROM inner_fused QUALIFY rank < {depth}),
flagged AS (SELECT *, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, doc_id) AS orig FROM recalled JOIN routes USING (qid, route)),
fused AS (SELECT qid, doc_id, round(sum(weight / (60 + rank) * CASE WHEN route > 0 AND orig = 1 THEN 0.35 ELSE 1 END), 9) AS score, count(*) AS n_routes FROM flagged GROUP BY qid, doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM fused)"""


@query(f"WITH {_ROUTES}, {_DOCUMENTS}, {_recall_sql(10)} SELECT qid, doc_id, score, n_routes, place, title FROM placed JOIN documents USING (doc_id) WHERE place <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Original and rewritten wordings, each by BM25 and by nearest vectors, fused; titles are joined to the five best of each query only."""
    docs = read(spark, d, "documents").select("doc_id", "title", "text")
    return search.search(read(spark, d, "rewrites"), docs).join(docs.select("doc_id", "title"), "doc_id")


@query(f"""WITH {_bm25_sql(10)}, o AS (SELECT bm.*, routes.weight, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, doc_id) AS orig FROM bm JOIN routes USING (qid, route)),
f AS (SELECT qid, doc_id, round(sum(weight / (60 + rank) * CASE WHEN route > 0 AND orig = 1 THEN 0.35 ELSE 1 END), 9) AS score, count(*) AS n_routes FROM o GROUP BY qid, doc_id)
SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM f QUALIFY place <= 5""")
def lexical_search(spark: SparkSession, d: str) -> DataFrame:
    return search.search(read(spark, d, "rewrites"), read(spark, d, "documents").select("doc_id", "text"), vector=False)


_VISIBLE = "corpus AS (SELECT id AS doc_id, text FROM chunks WHERE is_parent AND collection = 'techblog' AND list_has_any(acl, ['public']))"


@query(f"WITH {_ROUTES.replace('0.6 / len(v)', '0.2')}, {_VISIBLE}, {_recall_sql(6)} SELECT qid, doc_id, score, n_routes, place FROM placed WHERE place <= 3")
def search_with_access(spark: SparkSession, d: str) -> DataFrame:
    """Over the parents of one collection that the reader may see, with a fixed weight for each rewrite."""
    docs = read(spark, d, "chunks").where("is_parent").select(F.col("id").alias("doc_id"), "text", "collection", "acl")
    return search.search(read(spark, d, "rewrites"), docs, k=3, per_route=6, collection="techblog", acl=["public"], rewrite=0.2, share_budget=False)


@query(f"""WITH routes AS (SELECT qid, 0 AS route, regexp_replace(query, '^\\s+|\\s+$', '', 'g') AS query, 1.0 AS weight FROM rewrites WHERE regexp_replace(query, '^\\s+|\\s+$', '', 'g') <> ''), {_DOCUMENTS}, {_recall_sql(20)}
SELECT qid, doc_id, CAST(rank + 1 AS BIGINT) AS place FROM recalled WHERE rank < 10""")
def lexical_and_vector(spark: SparkSession, d: str) -> DataFrame:
    """Each query's own wording by BM25 and by hashed embeddings, fused into one order."""
    asked = search.routes(read(spark, d, "rewrites")).where("route = 0").select("qid", "route", "query")
    found = search.recall(asked, read(spark, d, "documents").select("doc_id", "text"), 20)
    return found.where("rank < 10").select("qid", "doc_id", (F.col("rank") + 1).alias("place"))


@query(f"""WITH {_ROUTES}, {_DOCUMENTS}, {_recall_sql(10)} SELECT qid, place, doc_id, score, n_routes, title, substring(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 160) AS snippet
 FROM placed JOIN documents USING (doc_id) WHERE place <= 5""")
def search_json(spark: SparkSession, d: str) -> DataFrame:
    """A JSON line for each query with its hits in order, written and read back."""
    docs = read(spark, d, "documents").select("doc_id", "title", "text")
    hits = cut(search.search(read(spark, d, "rewrites"), docs))
    ids = hits.select("doc_id").distinct()
    shown = docs.join(F.broadcast(ids) if hits.count() <= 1_000_000 else ids, "doc_id", "left_semi").select("doc_id", "title", tx.snippet(F.col("text")).alias("snippet"))
    lines = search.hits_json(hits.join(shown, "doc_id"))
    schema = "struct<qid:bigint,hits:array<struct<place:bigint,doc_id:bigint,score:double,n_routes:bigint,title:string,snippet:string>>>"
    return lines.select(F.from_json("json", schema).alias("j")).select("j.qid", F.inline("j.hits"))


# ---- explain


@query("SELECT qid, route, doc_id, rank, round(weight / (60 + rank), 9) AS contribution, round(1 - distance, 6) AS similarity FROM scans")
def explain_contributions(spark: SparkSession, d: str) -> DataFrame:
    return explain.contributions(_scans(spark, d)).select("qid", "route", "doc_id", "rank", "contribution", "similarity")


@query("SELECT qid, route, doc_id, rank FROM scans WHERE doc_id IN (SELECT id FROM chunks WHERE is_parent AND collection = 'techblog')")
def explain_scan_gaps(spark: SparkSession, d: str) -> DataFrame:
    parents = read(spark, d, "chunks").where("is_parent and collection = 'techblog'").select(F.col("id").alias("doc_id"))
    return explain.existing_only(_scans(spark, d), parents).select("qid", "route", "doc_id", "rank")


_TARGETS = """targets AS (SELECT DISTINCT t.qid, c.id AS doc_id FROM (SELECT qid, min(doc_id) AS doc_id FROM scans GROUP BY qid) t JOIN chunks s ON s.id = t.doc_id JOIN chunks c ON c.source_doc = s.source_doc AND c.is_parent)"""


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Of each query, all parents of the page that its smallest scanned document is of."""
    parents = read(spark, d, "chunks").select("id", "source_doc", "is_parent")
    least = _scans(spark, d).groupBy("qid").agg(F.min("doc_id").alias("id"))
    page = least.join(parents.select("id", "source_doc"), "id").select("qid", "source_doc")
    return page.join(parents.where("is_parent").select("source_doc", F.col("id").alias("doc_id")), "source_doc").select("qid", "doc_id").distinct()


@query(f"WITH {_TARGETS}, m AS (SELECT qid, route, min(struct_pack(rank := rank, doc_id := doc_id, distance := distance)) AS m FROM scans JOIN targets USING (qid, doc_id) GROUP BY qid, route) SELECT qid, route, m.rank AS rank, m.doc_id AS doc_id FROM m")
def explain_first_target(spark: SparkSession, d: str) -> DataFrame:
    return explain.first_by_route(_scans(spark, d), _targets(spark, d)).select("qid", "route", "rank", "doc_id")


@query(f"""WITH {_TARGETS}, m AS (SELECT qid, route, min(struct_pack(rank := rank, doc_id := doc_id, weight := weight)) AS m FROM scans JOIN targets USING (qid, doc_id) GROUP BY qid, route),
per AS (SELECT qid, list(route ORDER BY route) AS hits, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) AS orig FROM m GROUP BY qid),
sc AS (SELECT m.qid, sum(m.m.weight / (60 + m.m.rank) * CASE WHEN m.route > 0 AND per.orig = 1 THEN 0.35 ELSE 1 END) AS s FROM m JOIN per USING (qid) GROUP BY m.qid),
o AS (SELECT *, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, doc_id) AS orig FROM scans WHERE doc_id IS NOT NULL),
f AS (SELECT qid, doc_id, sum(weight / (60 + rank) * CASE WHEN route > 0 AND orig = 1 THEN 0.35 ELSE 1 END) AS score FROM o GROUP BY qid, doc_id),
g AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS place FROM f),
b AS (SELECT qid, min(place) AS fused_rank FROM g JOIN targets USING (qid, doc_id) GROUP BY qid),
n AS (SELECT qid, count(DISTINCT route) AS n FROM scans GROUP BY qid)
SELECT qid, round(coalesce(s, 0), 9) AS fused_score, fused_rank, n - coalesce(len(hits), 0) AS missed, CASE WHEN coalesce(len(hits), 0) = 0 THEN 'not recalled by any route' WHEN len(hits) = 1 AND hits[1] = 0 THEN 'recalled by the original query only'
 WHEN NOT list_contains(hits, 0) THEN 'recalled by rewrites only' WHEN fused_rank > 5 THEN 'recalled but below the top k' ELSE 'in the top k' END AS verdict
FROM (SELECT DISTINCT qid FROM targets) JOIN n USING (qid) LEFT JOIN per USING (qid) LEFT JOIN sc USING (qid) LEFT JOIN b USING (qid)""")
def explain_target_verdict(spark: SparkSession, d: str) -> DataFrame:
    v = explain.diagnose(_scans(spark, d), _targets(spark, d))
    return v.select("qid", "fused_score", "fused_rank", F.size("missed_routes").cast("long").alias("missed"), "verdict")


@query("""WITH c AS (SELECT qid, route, doc_id, min(rank) AS rank FROM scans WHERE route > 0 GROUP BY qid, route, doc_id), o AS (SELECT qid, doc_id, min(distance) AS distance FROM scans WHERE route = 0 GROUP BY qid, doc_id)
SELECT c.qid, c.route, c.doc_id, o.distance FROM c LEFT JOIN o ON o.qid = c.qid AND o.doc_id = c.doc_id""")
def explain_original_distance(spark: SparkSession, d: str) -> DataFrame:
    """What the rewrites found, with the original query's distance where it has one."""
    found = _scans(spark, d).where("route > 0").select("qid", "route", "doc_id").distinct()
    original = _scans(spark, d).where("route = 0")
    routes_as_0 = found.withColumnRenamed("route", "found_by").withColumn("route", F.lit(0))
    return explain.attach_distance(routes_as_0, original).select("qid", F.col("found_by").alias("route"), "doc_id", "distance")


_EXPLAIN = f"WITH {_ROUTES}, {_DOCUMENTS}, {_recall_sql(10, 100)}"


@query(f"""{_EXPLAIN} SELECT p.qid, p.place, p.doc_id, p.score AS rrf, f.route, CASE WHEN f.route = 0 THEN 'original' ELSE 'rewrite ' || f.route END AS label, f.rank, s.distance AS ann_dist, round(f.weight / (60 + f.rank), 9) AS contribution
 FROM placed p JOIN flagged f USING (qid, doc_id) LEFT JOIN scanned s ON s.qid = f.qid AND s.route = f.route AND s.doc_id = f.doc_id WHERE p.place <= 5""")
def explain_json(spark: SparkSession, d: str) -> DataFrame:
    """What led to each hit, as a JSON object a query, written and read back."""
    hits, _ = explain.explained(read(spark, d, "rewrites"), read(spark, d, "documents").select("doc_id", "text"))
    schema = "struct<qid:bigint,hits:array<struct<rank:bigint,doc_id:bigint,rrf:double,route_detail:array<struct<route:int,label:string,rank:bigint,ann_dist:double,contribution:double>>>>>"
    each = explain.explain_json(hits).select(F.from_json("json", schema).alias("j")).select("j.qid", F.explode("j.hits").alias("h"))
    return each.select("qid", F.col("h.rank").alias("place"), "h.doc_id", "h.rrf", F.explode("h.route_detail").alias("r")).select("qid", "place", "doc_id", "rrf", "r.*")


@query(f"""{_EXPLAIN}, targets AS (SELECT p.qid, t.doc_id FROM placed p JOIN documents a USING (doc_id) JOIN documents t ON t.source = a.source WHERE p.place = 1),
sw AS (SELECT scanned.*, weight FROM scanned JOIN routes USING (qid, route)), m AS (SELECT qid, route, min(struct_pack(rank := rank, doc_id := doc_id, weight := weight)) AS m FROM sw JOIN targets USING (qid, doc_id) GROUP BY qid, route),
per AS (SELECT qid, list(route ORDER BY route) AS hits, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) AS orig FROM m GROUP BY qid),
sc AS (SELECT m.qid, sum(m.m.weight / (60 + m.m.rank) * CASE WHEN m.route > 0 AND per.orig = 1 THEN 0.35 ELSE 1 END) AS s FROM m JOIN per USING (qid) GROUP BY m.qid),
o AS (SELECT *, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY qid, doc_id) AS orig FROM sw), f AS (SELECT qid, doc_id, sum(weight / (60 + rank) * CASE WHEN route > 0 AND orig = 1 THEN 0.35 ELSE 1 END) AS score FROM o GROUP BY qid, doc_id),
g AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 12) DESC, doc_id) AS place FROM f), b AS (SELECT qid, min(place) AS fused_rank FROM g JOIN targets USING (qid, doc_id) GROUP BY qid),
n AS (SELECT qid, count(DISTINCT route) AS n FROM sw GROUP BY qid)
SELECT qid, round(coalesce(s, 0), 9) AS fused_score, fused_rank, n - coalesce(len(hits), 0) AS missed, CASE WHEN coalesce(len(hits), 0) = 0 THEN 'not recalled by any route' WHEN len(hits) = 1 AND hits[1] = 0 THEN 'recalled by the original query only'
 WHEN NOT list_contains(hits, 0) THEN 'recalled by rewrites only' WHEN fused_rank > 5 THEN 'recalled but below the top k' ELSE 'in the top k' END AS verdict
FROM (SELECT DISTINCT qid FROM targets) JOIN n USING (qid) LEFT JOIN per USING (qid) LEFT JOIN sc USING (qid) LEFT JOIN b USING (qid)""")
def explain_target(spark: SparkSession, d: str) -> DataFrame:
    """What became of all documents of the source that the first hit is of, in a search and in its far deeper scans."""
    docs = read(spark, d, "documents").select("doc_id", "text", "source")
    scans, found = explain.traced(read(spark, d, "rewrites"), docs)
    sources = docs.select("doc_id", "source")
    aimed = cut(search.fused_hits(found, 1).select("qid", "doc_id").join(sources, "doc_id").select("qid", "source").where("source is not null"))
    seen = scans.select("qid", "doc_id").distinct().join(sources, "doc_id").join(aimed, ["qid", "source"], "left_semi").select("qid", "doc_id")
    target = explain.diagnose(scans, seen, k=5, asked=aimed)
    return target.select("qid", "fused_score", "fused_rank", F.size("missed_routes").cast("long").alias("missed"), "verdict")


# ---- evaluation


_TRUTH = "truth AS (SELECT qid, arg_min(source_doc, struct_pack(a := distance, b := doc_id)) AS source_doc FROM scans JOIN chunks ON chunks.id = scans.doc_id WHERE distance IS NOT NULL GROUP BY qid)"


def _truth(spark: SparkSession, d: str, docs: DataFrame) -> DataFrame:
    """Of each query the page of its nearest document."""
    near = _scans(spark, d).where("distance is not null").join(docs, "doc_id")
    return near.groupBy("qid").agg(F.min_by("source_doc", F.struct("distance", "doc_id")).alias("source_doc"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").select(F.col("id").alias("doc_id"), "source_doc")


@query(_fused("weight", True, 0.35) + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM fused),
s AS (SELECT qid, source_doc, min(place) AS p FROM placed JOIN chunks ON chunks.id = placed.doc_id GROUP BY qid, source_doc), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p, source_doc) AS place FROM s),
{_TRUTH}, k AS (SELECT truth.qid, min(r.place) AS rank FROM truth LEFT JOIN r ON r.qid = truth.qid AND r.source_doc = truth.source_doc AND r.place <= 10 GROUP BY truth.qid)
SELECT count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg FROM k""")
def eval_recall_mrr_ndcg(spark: SparkSession, d: str) -> DataFrame:
    docs = _pages(spark, d)
    scored = _rounded(fusion.rrf_fuse(_scans(spark, d), dampen=0.35, dedup=True))
    placed = scored.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id")))
    return evaluation.metrics(evaluation.relevant_rank(evaluation.by_source(placed, docs), _truth(spark, d, docs), 10))


@query(_fused("weight", True, 0.35) + """, full_run AS (SELECT qid, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM fused) WHERE place <= 5),
base AS (SELECT qid, doc_id FROM p WHERE route = 0 AND pos < 5), rw AS (SELECT DISTINCT qid, doc_id FROM scans WHERE route > 0), org AS (SELECT DISTINCT qid, doc_id FROM scans WHERE route = 0),
n AS (SELECT count(DISTINCT qid) AS n FROM scans), kept AS (SELECT count(*) AS v FROM base JOIN full_run USING (qid, doc_id)), only_base AS (SELECT * FROM base ANTI JOIN rw USING (qid, doc_id)),
stay AS (SELECT count(*) AS v FROM only_base JOIN full_run USING (qid, doc_id)), fresh AS (SELECT count(*) AS v FROM full_run ANTI JOIN org USING (qid, doc_id)), slots AS (SELECT count(*) AS v FROM only_base)
SELECT n, round(kept.v / (n * 5), 6) AS top_retention, CASE WHEN slots.v > 0 THEN round(stay.v / slots.v, 6) ELSE 1.0 END AS original_only_retention, slots.v AS original_only_slots, round(fresh.v / n, 6) AS rewrite_only_per_query FROM n, kept, stay, fresh, slots""")
def eval_retention(spark: SparkSession, d: str) -> DataFrame:
    scans = _scans(spark, d)
    full = fusion.top_k(_rounded(fusion.rrf_fuse(scans, dampen=0.35, dedup=True)), 5)
    base = fusion.positions(scans.where("route = 0")).where("pos < 5")
    return evaluation.retention(base.select("qid", "doc_id"), full.select("qid", "doc_id"), scans.select("qid", "doc_id", "route"), 5)


_NOISE = evaluation.NOISE_TITLE.replace("'", "''")


@query(f"""WITH r AS (SELECT source_doc, chunk_index, id, section, length(text) AS len, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM chunks WHERE is_parent AND source_doc IS NOT NULL),
w AS (SELECT *, coalesce(sum(length(clean)) OVER (PARTITION BY source_doc ORDER BY chunk_index, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r),
g AS (SELECT source_doc, CAST(sum(len) AS BIGINT) AS chars, arg_min(section, struct_pack(a := chunk_index, b := id)) FILTER (WHERE coalesce(section, '') <> '') AS title, string_agg(clean, ' ' ORDER BY chunk_index, id) FILTER (WHERE before < 800) AS lead FROM w GROUP BY source_doc),
k AS (SELECT * FROM g WHERE chars >= 1500 AND length(lead) >= 200 AND NOT coalesce(regexp_matches(title, '{_NOISE}'), false)),
h AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN source_doc LIKE '%//%' THEN split_part(source_doc, '/', 3) ELSE source_doc END ORDER BY chars DESC, source_doc) AS nth FROM k)
SELECT source_doc, title, chars, lead FROM h WHERE nth <= 2 ORDER BY chars DESC, source_doc LIMIT 18""")
def eval_sample_docs(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.sample_documents(read(spark, d, "chunks").where("is_parent").select("source_doc", "chunk_index", "id", "section", "text"))


_ASKED = """asked AS (SELECT item_id AS qid, i.query, variants FROM eval_items i LEFT JOIN (SELECT query, min(variants) AS variants FROM rewrites GROUP BY query) r ON r.query = i.query)"""


@query(f"""WITH {_ASKED}, {_ROUTES.replace("FROM rewrites)", "FROM asked)", 1)}, corpus AS (SELECT id AS doc_id, text FROM chunks WHERE is_parent AND collection = 'techblog'), {_recall_sql(20)},
s AS (SELECT qid, source_doc, min(place) AS p FROM placed JOIN chunks ON chunks.id = placed.doc_id WHERE place <= 10 GROUP BY qid, source_doc), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY p, source_doc) AS place FROM s),
truth AS (SELECT item_id AS qid, source_doc FROM eval_items), k AS (SELECT truth.qid, min(r.place) AS rank FROM truth LEFT JOIN r ON r.qid = truth.qid AND r.source_doc = truth.source_doc GROUP BY truth.qid)
SELECT count(*) AS n, round(avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg(coalesce(1 / log2(rank + 1), 0)), 6) AS ndcg FROM k""".replace("), s AS (SELECT qid, source_doc", "), sd AS (SELECT qid, source_doc").replace("placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM fused),\ns AS", "placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS place FROM fused),\nsd AS").replace("ORDER BY p, source_doc) AS place FROM s)", "ORDER BY p, source_doc) AS place FROM sd)"))
def eval_search(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation items asked of the parents of a collection, with the rewrites that there are for them."""
    items = read(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "query", "source_doc")
    known = read(spark, d, "rewrites").groupBy("query").agg(F.min("variants").alias("variants"))
    docs = read(spark, d, "chunks").where("is_parent").select(F.col("id").alias("doc_id"), "text", "source_doc", "collection")
    return evaluation.evaluate(items.join(known, "query", "left"), items.select("qid", "source_doc"), docs, collection="techblog")


@query(f"""WITH {_ROUTES}, {_DOCUMENTS}, {_recall_sql(10)}, full_run AS (SELECT qid, doc_id FROM placed WHERE place <= 5), base AS (SELECT qid, doc_id FROM recalled WHERE route = 0 AND rank < 5), rw AS (SELECT DISTINCT qid, doc_id FROM recalled WHERE route > 0), org AS (SELECT DISTINCT qid, doc_id FROM recalled WHERE route = 0),
n AS (SELECT count(DISTINCT qid) AS n FROM recalled), kept AS (SELECT count(*) AS v FROM base JOIN full_run USING (qid, doc_id)), only_base AS (SELECT * FROM base ANTI JOIN rw USING (qid, doc_id)),
stay AS (SELECT count(*) AS v FROM only_base JOIN full_run USING (qid, doc_id)), fresh AS (SELECT count(*) AS v FROM full_run ANTI JOIN org USING (qid, doc_id)), slots AS (SELECT count(*) AS v FROM only_base)
SELECT n.n, round(kept.v / (n.n * 5), 6) AS top_retention, CASE WHEN slots.v > 0 THEN round(stay.v / slots.v, 6) ELSE 1.0 END AS original_only_retention, slots.v AS original_only_slots, round(fresh.v / n.n, 6) AS rewrite_only_per_query FROM n, kept, stay, fresh, slots""")
def search_retention(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.search_retention(read(spark, d, "rewrites"), read(spark, d, "documents").select("doc_id", "text"))


@query("""WITH a AS (SELECT source_doc, '「' || query || '」' || chr(10) || 'because of the title' AS raw, query FROM eval_items),
c AS (SELECT source_doc, regexp_replace(query, '^\\s+|\\s+$', '', 'g') || '」' AS q FROM a)
SELECT i.query AS query, p.source_doc, substring(p.title, 1, 120) AS title, p.chars FROM (SELECT source_doc, min(section) AS title, CAST(sum(length(text)) AS BIGINT) AS chars FROM chunks WHERE is_parent GROUP BY source_doc) p
JOIN (SELECT source_doc, trim(query) || '」' AS query FROM eval_items) i USING (source_doc) WHERE length(i.query) BETWEEN 4 AND 30 AND regexp_matches(i.query, '[一-鿿]')""")
def eval_build_set(spark: SparkSession, d: str) -> DataFrame:
    """A frozen evaluation set from answers of a generator, here the stored queries in quotes with a line of chatter after them."""
    answers = read(spark, d, "eval_items").select("source_doc", F.concat(F.lit("「"), F.trim("query"), F.lit("」\nbecause of the title")).alias("raw"))
    pages = read(spark, d, "chunks").where("is_parent").groupBy("source_doc").agg(F.min("section").alias("title"), F.sum(F.length("text")).alias("chars"))
    return evaluation.build_set(pages, answers)


# ---- extensions


@query("""SELECT id, regexp_replace(regexp_replace(source_doc, '([?&])utm_[a-z]+=[^&#]*', '\\1', 'g'), '[?&]+(#|$)', '\\1') AS url FROM chunks""")
def ext_url_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without tracking parameters."""
    bare = F.regexp_replace("source_doc", "([?&])utm_[a-z]+=[^&#]*", "$1")
    return read(spark, d, "chunks").select("id", F.regexp_replace(bare, "[?&]+(#|$)", "$1").alias("url"))


@query("""SELECT qid, route, round(count(DISTINCT source_doc) / count(*), 6) AS diversity FROM (SELECT s.qid, s.route, c.source_doc FROM scans s JOIN chunks c ON c.id = s.doc_id WHERE s.rank < 10) GROUP BY qid, route""")
def ext_diversity(spark: SparkSession, d: str) -> DataFrame:
    """The share of different pages among a route's first ten places."""
    top = _scans(spark, d).where("rank < 10").join(_pages(spark, d), "doc_id")
    return top.groupBy("qid", "route").agg(F.round(F.countDistinct("source_doc") / F.count("*"), 6).alias("diversity"))


@query("""SELECT qid, route, source_doc, min(rank) AS rank FROM (SELECT s.qid, s.route, s.rank, c.source_doc FROM scans s JOIN chunks c ON c.id = s.doc_id) GROUP BY qid, route, source_doc""")
def ext_source_dedup(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).join(_pages(spark, d), "doc_id").groupBy("qid", "route", "source_doc").agg(F.min("rank").alias("rank"))


@query("SELECT doc_id, source, epoch_us(published_at) AS published_us FROM documents WHERE published_at >= TIMESTAMPTZ '2024-06-01 00:00:00+00' AND lang = 'en'")
def ext_since_filter(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").where("published_at >= timestamp'2024-06-01 00:00:00Z' and lang = 'en'").select("doc_id", "source", F.unix_micros("published_at").alias("published_us"))


@query("""WITH m AS (SELECT qid, max(CASE WHEN route = 0 THEN 1 ELSE 0 END) AS own, max(CASE WHEN route > 0 THEN 1 ELSE 0 END) AS other FROM scans WHERE rank < 5 GROUP BY qid)
SELECT r.qid, CASE WHEN coalesce(own, 0) = 1 THEN 'covered' WHEN coalesce(other, 0) = 1 THEN 'vocabulary gap' ELSE 'missing content' END AS triage FROM rewrites r LEFT JOIN m ON m.qid = r.qid""")
def ext_gap_triage(spark: SparkSession, d: str) -> DataFrame:
    """Whether a query's own words find something, only its rewrites do, or nothing does."""
    near = _scans(spark, d).where("rank < 5").groupBy("qid").agg(F.max(F.when(F.col("route") == 0, 1).otherwise(0)).alias("own"), F.max(F.when(F.col("route") > 0, 1).otherwise(0)).alias("other"))
    triage = F.when(F.coalesce("own", F.lit(0)) == 1, "covered").when(F.coalesce("other", F.lit(0)) == 1, "vocabulary gap").otherwise("missing content")
    return read(spark, d, "rewrites").select("qid").join(near, "qid", "left").select("qid", triage.alias("triage"))


@query()
def ext_mmr(spark: SparkSession, d: str) -> DataFrame:
    """The fifty nearest of each query reordered so that like ones don't follow each other: maximal marginal relevance, ten of them."""
    e = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vec"))
    near = _nearest(spark, d, 50).join(e, "doc_id")

    def reorder(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values(["distance", "doc_id"], ignore_index=True)
        v = np.vstack(df["vec"]).astype(np.float64)
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        like, gain, chosen = v @ v.T, 0.7 * (1 - df["distance"].to_numpy()), []
        while len(chosen) < min(10, len(df)):
            worst = like[:, chosen].max(axis=1) if chosen else np.zeros(len(df))
            value = gain - 0.3 * worst
            value[chosen] = -np.inf
            chosen.append(int(value.argmax()))
        return pd.DataFrame({"qid": key[0], "doc_id": df["doc_id"].to_numpy()[chosen], "place": np.arange(1, len(chosen) + 1)})

    return near.groupBy("qid").applyInPandas(reorder, "qid long, doc_id long, place long")
