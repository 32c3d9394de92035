"""The manifest as the state of a stream of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.functions.text import content_hash
from quern.operators.ingest import merge_manifest
from quern.sources.tables import append_manifest, read_manifest


def changed_pages(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows of the pages(source_doc, text, chunks, stored_at) that are new or have another hash; the latest of a page counts."""
    rows = pages.select("source_doc", content_hash(F.col("text")).alias("sha256"), "chunks", F.length("text").alias("chars"), "stored_at").where("source_doc is not null and text is not null")
    latest = merge_manifest(rows.limit(0), rows)
    same = manifest.where("chunks > 0").select("source_doc", "sha256").distinct()
    return latest.join(same, ["source_doc", "sha256"], "left_anti")


def follow(pages: DataFrame, path: str, checkpoint: str, *, available_now: bool = True) -> StreamingQuery:
    """Keep the manifest at path up to date with a stream of pages: a micro-batch appends the rows it changes.

    A batch that runs again after a failure changes nothing, as its pages then have the stored hash.
    """

    def merge(batch: DataFrame, _: int) -> None:
        old = read_manifest(batch.sparkSession, path)
        fresh = changed_pages(batch, old)
        if not fresh.isEmpty():
            append_manifest(fresh, path)

    writer = pages.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
