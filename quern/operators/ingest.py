"""Incremental ingest: what to do with each crawled item, the manifest, and two-level chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import content_hash, strip

LEAST_CHARS = 600
PARENT_CHARS, CHILD_CHARS, OVERLAP = 2000, 400, 60


def prefixed(title: Column, body: Column) -> Column:
    """The body, with the title as its heading unless it starts with one."""
    return F.when(body.startswith("#"), body).otherwise(F.concat(F.lit("# "), title, F.lit("\n\n"), body))


def foreign_conflicts(items: DataFrame, store: DataFrame, collection: str) -> DataFrame:
    """(url) of items whose address another collection already holds."""
    other = store.where(F.col("collection") != collection).select(F.col("source_doc").alias("url")).distinct()
    return items.select("url").distinct().join(other, "url", "left_semi")


def without_conflicts(items: DataFrame, store: DataFrame, collection: str) -> DataFrame:
    return items.join(store.where(F.col("collection") != collection).select(F.col("source_doc").alias("url")).distinct(), "url", "left_anti")


def crawl_status(items: DataFrame, manifest: DataFrame, conflicts: DataFrame, *, force: bool = False) -> DataFrame:
    """items(source, url, title, body, and error if fetching gave one) with sha256, chars, known_chunks, status and reason, the first that holds of:

    fail (no address), skip (the address is another collection's), skip (robots), fail (no body), skip (too short), unchanged
    (same hash as the manifest's, which has chunks), ok.
    """
    text = prefixed(F.col("title"), F.col("body"))
    error = F.col("error") if "error" in items.columns else F.lit(None).cast("string")
    known = manifest.groupBy("source_doc").agg(F.max(F.struct("stored_at", "sha256", "chunks")).alias("m")).select(F.col("source_doc").alias("_url"), F.col("m.sha256").alias("_sha"), F.col("m.chunks").alias("_chunks"))
    held = conflicts.select(F.col("url").alias("_held")).distinct()
    joined = items.withColumn("sha256", content_hash(text)).withColumn("chars", F.length(text)).join(known, F.col("url") == F.col("_url"), "left").join(held, F.col("url") == F.col("_held"), "left")
    same = (F.col("sha256") == F.col("_sha")) & (F.coalesce("_chunks", F.lit(0)) > 0) & F.lit(not force)
    verdict = (
        F.when(F.coalesce("url", F.lit("")) == "", F.array(F.lit("fail"), F.lit("no address")))
        .when(F.col("_held").isNotNull(), F.array(F.lit("skip"), F.lit("another collection has it")))
        .when(error == "robots", F.array(F.lit("skip"), F.lit("robots")))
        .when(F.col("body").isNull(), F.array(F.lit("fail"), F.coalesce(error, F.lit("no body"))))
        .when(F.length(strip(F.col("body"))) < LEAST_CHARS, F.array(F.lit("skip"), F.lit("too short")))
        .when(F.coalesce(same, F.lit(False)), F.array(F.lit("unchanged"), F.lit(None).cast("string")))
        .otherwise(F.array(F.lit("ok"), F.lit(None).cast("string")))
    )
    out = joined.withColumn("_v", verdict).withColumn("status", F.col("_v")[0]).withColumn("reason", F.col("_v")[1]).withColumn("known_chunks", F.coalesce("_chunks", F.lit(0)))
    return out.drop("_url", "_sha", "_chunks", "_held", "_v")


def source_stats(status: DataFrame) -> DataFrame:
    """A row for each source: items by status, characters taken in and their mean (0 if none was), chunks made and saved, reasons of failures.

    status: crawl_status's rows, with n_chunks where chunks were made.
    """
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    total = lambda s, c: F.coalesce(F.sum(F.when(F.col("status") == s, c)), F.lit(0)).cast("long")
    made = F.col("n_chunks") if "n_chunks" in status.columns else F.lit(0)
    reasons = F.array_sort(F.collect_set(F.when(F.col("status") == "fail", F.col("reason"))))
    out = status.groupBy("source").agg(n("ok"), n("skip"), n("fail"), n("unchanged"), total("ok", F.col("chars")).alias("words"), total("ok", made).alias("chunks"), total("unchanged", F.col("known_chunks")).alias("saved_chunks"), reasons.alias("fail_reasons"))
    return out.withColumn("avg_words", F.when(F.col("ok") > 0, F.floor(F.col("words") / F.col("ok"))).otherwise(0).cast("long"))


def merge_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    """The keyed union of two manifests; of several rows of a page the latest stays, new before old."""
    both = new.withColumn("_fresh", F.lit(1)).unionByName(old.withColumn("_fresh", F.lit(0)))
    cols = [c for c in old.columns if c != "source_doc"]
    best = both.groupBy("source_doc").agg(F.max(F.struct("_fresh", "stored_at", *[F.col(c).alias(f"v_{c}") for c in cols])).alias("m"))
    return best.select("source_doc", *[F.col(f"m.v_{c}").alias(c) for c in cols])


def replace_documents(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """The store with chunks in place of all its chunks of the same pages, in any collection."""
    return store.join(chunks.select("source_doc").distinct(), "source_doc", "left_anti").unionByName(chunks.select(*store.columns))


def two_level_chunks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section_no, parent_no, child_no, section, parent_text, text, chars): sections at headings, parents of at most 2000 characters, children of 400 that overlap by 60.

    section is the heading that the part stands under, "" before the first. Empty and null texts have no chunks.
    """
    marked = F.regexp_replace(F.col(text_col), "(?m)^(#{1,6} )", "\u0001$1")
    sections = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(F.split(marked, "\u0001"), lambda s: s != "")).alias("section_no", "s"))
    named = sections.withColumn("section", F.trim(F.regexp_extract("s", "^#{1,6} ([^\r\n]*)", 1)))
    starts = lambda c, step, span: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (span - step)), F.lit(step))
    parents = named.select("doc_id", "section_no", "section", F.posexplode(F.transform(starts(F.col("s"), PARENT_CHARS, PARENT_CHARS), lambda i: F.substring("s", i, F.lit(PARENT_CHARS)))).alias("parent_no", "parent_text"))
    step = CHILD_CHARS - OVERLAP
    cut_up = F.transform(starts(F.col("parent_text"), step, CHILD_CHARS), lambda i: F.substring("parent_text", i, F.lit(CHILD_CHARS)))
    children = parents.select("doc_id", "section_no", "parent_no", "section", "parent_text", F.posexplode(cut_up).alias("child_no", "text"))
    return children.select("doc_id", "section_no", "parent_no", "child_no", "section", "parent_text", "text", F.length("text").alias("chars"))


def chunk_rows(pages: DataFrame, collection: str, acl: list[str], *, doc_version: str = "v1") -> DataFrame:
    """Rows for the store of pages(url, text, effective_date): each parent and its children, with ids by hash of page and place."""
    parts = two_level_chunks(pages, id_col="url").withColumnRenamed("doc_id", "source_doc").join(pages.select(F.col("url").alias("source_doc"), "effective_date"), "source_doc")
    parent_id = F.xxhash64("source_doc", "section_no", "parent_no")
    common = ["source_doc", F.lit(collection).alias("collection"), F.lit(doc_version).alias("doc_version"), "effective_date", F.array(*map(F.lit, acl)).alias("acl"), "section"]
    children = parts.select(F.xxhash64("source_doc", "section_no", "parent_no", "child_no").alias("id"), F.lit(False).alias("is_parent"), parent_id.alias("parent_id"), F.col("child_no").alias("chunk_index"), "text", *common)
    order = F.row_number().over(Window.partitionBy("source_doc").orderBy("section_no", "parent_no")) - 1
    parents = parts.where("child_no = 0").select(parent_id.alias("id"), F.lit(True).alias("is_parent"), F.lit(None).cast("long").alias("parent_id"), order.alias("chunk_index"), F.col("parent_text").alias("text"), *common)
    return parents.unionByName(children)


def chunk_counts(store: DataFrame) -> DataFrame:
    """(collection, total, parents, children)."""
    return store.groupBy("collection").agg(F.count("*").alias("total"), F.count_if(F.col("is_parent")).alias("parents"), F.count_if(~F.col("is_parent")).alias("children"))
