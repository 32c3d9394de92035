"""One crawl as one job: fetch, extract, decide, chunk, store, remember."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.dates import effective_date, norm_date
from quern.operators.ingest import chunk_rows, crawl_status, foreign_conflicts, merge_manifest, prefixed, replace_documents, source_stats
from quern.session import cut
from quern.sources import http
from quern.sources.html import article_body, article_text, article_title, html_blocks, used_blocks


class Crawl(NamedTuple):
    """status: the items with their fate; chunks: the new rows; store: with these in place of the pages' old ones; manifest: merged; stats: by source."""

    status: DataFrame
    chunks: DataFrame
    store: DataFrame
    manifest: DataFrame
    stats: DataFrame


def crawl(
    items: DataFrame,
    store: DataFrame,
    manifest: DataFrame,
    *,
    collection: str,
    acl: list[str],
    run_date: str,
    stored_at: str,
    force: bool = False,
    get: http.Fetcher = http.open_url,
    sleep: Callable[[float], None] | None = None,
) -> Crawl:
    """Take items(source, title, url, date, and fulltext, markdown if there are any) into the store.

    A page that fails, in whatever way, is a row of status with its reason. Only pages whose text is new or changed are
    chunked; force takes unchanged ones too. Addresses that another collection holds aren't fetched. An item's own full
    text goes before the API's markdown and the page's article; its summary is never taken for the article. Of items with the same address the one with the first title is stored.
    """
    wait = {} if sleep is None else {"sleep": sleep}
    items = items.withColumn("url", F.trim("url"))
    for name in ("fulltext", "markdown"):
        if name not in items.columns:
            items = items.withColumn(name, F.lit(None).cast("string"))
    conflicts = cut(foreign_conflicts(items, store, collection))
    wanted = items.where("coalesce(url, '') <> ''").select("url").distinct().join(conflicts, "url", "left_anti")
    pages = cut(http.crawl(wanted, get=get, **wait))
    used = used_blocks(html_blocks(F.when(F.col("error").isNull(), F.col("text"))))
    read = pages.select("url", "error", F.when(F.col("error").isNull(), article_body(used)).alias("_body"), article_title(used).alias("_title"))
    with_body = items.join(read, "url", "left").withColumn("body", F.when(F.coalesce(F.col("error"), F.lit("")) == "robots", None).otherwise(article_text(F.col("fulltext"), F.col("markdown"), F.col("_body"))))
    titled = with_body.withColumn("title", F.coalesce(F.when(F.col("_title") != "", F.col("_title")), "title", "url"))
    status = cut(crawl_status(titled.select("source", "url", "title", "date", "body", "error"), manifest, conflicts, force=force))
    ok = status.where("status = 'ok'").groupBy("url").agg(F.min(F.struct("title", "body", "date", "sha256", "chars")).alias("x")).select("url", "x.*")
    dated = ok.withColumn("effective_date", effective_date(norm_date(F.col("date")), F.col("url"), F.lit(run_date).cast("date")))
    chunks = cut(chunk_rows(dated.select("url", prefixed(F.col("title"), F.col("body")).alias("text"), "effective_date"), collection, acl))
    counts = chunks.where("not is_parent").groupBy(F.col("source_doc").alias("url")).agg(F.count("*").cast("int").alias("n_chunks"))
    fresh = ok.join(counts, "url").select(F.col("url").alias("source_doc"), "sha256", F.col("n_chunks").alias("chunks"), "chars", F.lit(stored_at).alias("stored_at"))
    kept = [c for c in chunks.columns if c in store.columns]
    new_store = replace_documents(store.select(*kept), chunks.select(*kept))
    return Crawl(status, chunks, new_store, merge_manifest(manifest, fresh), source_stats(status.join(counts, "url", "left")))
