"""Problem 7: a limit on the records of each contributor, by distributed suitor b-matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import site
from quern.operators.ranking import group_ranks
from quern.session import cut, read


def suitor_matching(proposals: DataFrame, capacities: DataFrame) -> DataFrame:
    """(record, kept): which records all of their contributors have room for.

    proposals: (record BIGINT, contributor, weight DOUBLE), one row for each contributor that a record lists;
    capacities: (contributor, capacity). Contributors prefer a greater weight, nulls last, then the smaller record.

    Rounds: every undecided record proposes to all its contributors. A contributor's weakest proposals beyond its
    capacity are displaced for the time being. A record that no contributor displaced is matched for good, as
    nothing undecided is preferred to it; a record one of whose contributors has no room left after the matched ones
    is dropped for good, which frees its place with its other contributors for the next round. With one
    contributor a record, the first round decides all. The result is that of taking records by preference as long as
    all their contributors have room.

    Ranks are range-partitioned, so a contributor with a third of all records is no single task. Nulls: a null
    contributor is a contributor; one without a capacity takes nothing. Repeated (record, contributor) rows count
    once; rows without record take no part. Empty input gives an empty result.
    """
    order = [F.col("weight").desc_nulls_last(), F.col("record")]
    live = proposals.select("record", "contributor", "weight").where("record is not null").groupBy("record", "contributor").agg(F.max("weight").alias("weight"))
    caps = capacities.select(F.col("contributor").alias("_contributor"), F.col("capacity").cast("long").alias("_capacity"))
    decided, full = None, None
    while True:
        ranked = group_ranks(live, ["contributor"], order)
        ranked = ranked.join(caps, F.col("contributor").eqNullSafe(F.col("_contributor")), "left").withColumn("_room", F.coalesce("_capacity", F.lit(0)))
        verdict = cut(ranked.groupBy("record").agg(F.max(F.col("rank") > F.col("_room")).alias("displaced"), F.max(F.col("_room") <= 0).alias("hopeless"), F.count("*").alias("listed")))
        final = verdict.where(~F.col("displaced") | F.col("hopeless")).select("record", (~F.col("displaced")).alias("kept"))
        many = verdict.agg(F.max("listed")).first()[0]
        if many is None or many == 1:  # nothing listed twice: displaced is final
            now = verdict.select("record", (~F.col("displaced")).alias("kept"))
            return now if decided is None else decided.unionByName(now)
        decided = final if decided is None else decided.unionByName(final)
        taken = live.join(final.where("kept"), "record", "left_semi").groupBy("contributor").agg(F.count("*").alias("_taken"))
        taken = taken.withColumnRenamed("contributor", "_by")
        caps = cut(caps.join(taken, F.col("_contributor").eqNullSafe(F.col("_by")), "left").select("_contributor", (F.col("_capacity") - F.coalesce("_taken", F.lit(0))).alias("_capacity")))
        live = cut(live.join(final, "record", "left_anti"))
        decided = cut(decided)
        if live.isEmpty():
            return decided


def capped(records: DataFrame, *, group: str, contributor: str, share: int, id_col: str = "id", weight: str = "quality") -> DataFrame:
    """(id, kept): within each group a contributor keeps at most n div share records, at least 1.

    n is the number of the group's records. Each (group, contributor) is a contributor of the matching.
    """
    key = F.struct(F.col(group).alias("g"), F.col(contributor).alias("c"))
    size = records.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    props = records.select(F.col(id_col).alias("record"), key.alias("contributor"), F.col(weight).cast("double").alias("weight"))
    caps = props.select("contributor").distinct().join(size, F.col("contributor.g").eqNullSafe(F.col("_g"))).select("contributor", F.greatest(F.lit(1), F.floor(F.col("_n") / share)).alias("capacity"))
    return suitor_matching(props, caps).withColumnRenamed("record", "id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent").select("id", "batch_no", site(F.col("source_doc")).alias("site"), "quality")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return capped(_records(spark, d), group="batch_no", contributor="site", share=20).where(~F.col("kept")).select("id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many parents of each batch and site stay, and the sum of their quality in millionths (whole numbers, so that it has no rounding ties)."""
    records = _records(spark, d)
    kept = capped(records, group="batch_no", contributor="site", share=20).where("kept")
    return records.join(kept, "id", "left_semi").groupBy("batch_no", "site").agg(F.count("*").alias("kept"), F.sum(F.round(F.col("quality") * 1_000_000).cast("long")).alias("quality"))


def p7_authors(spark: SparkSession, d: str) -> DataFrame:
    """feed_items have two contributors each, their author and their source: at most a twentieth for each of them."""
    items = read(spark, d, "feed_items").select(F.xxhash64("source", "url", "title", "fetched_at").alias("id"), "author", "source", F.length("summary").cast("double").alias("quality")).dropDuplicates(["id"])
    props = items.select(F.col("id").alias("record"), F.explode(F.array(F.concat(F.lit("a:"), "author"), F.concat(F.lit("s:"), "source"))).alias("contributor"), F.col("quality").alias("weight")).where("contributor is not null")
    n = items.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 20)).alias("capacity"))
    caps = props.select("contributor").distinct().join(F.broadcast(n))  # one row
    return suitor_matching(props, caps).groupBy("kept").agg(F.count("*").alias("records"))


_RANK = """WITH p AS (SELECT id, batch_no, {site} AS site, quality, count(*) OVER (PARTITION BY batch_no) AS n FROM chunks WHERE is_parent),
r AS (SELECT *, row_number() OVER (PARTITION BY batch_no, site ORDER BY quality DESC NULLS LAST, id) AS rank FROM p) """

QUERIES = {"p7_found": p7_found, "p7_kept": p7_kept, "p7_authors": p7_authors}


def _sql() -> dict[str, str]:
    from quern.llm.lines import SITE_SQL

    r = _RANK.format(site=SITE_SQL)
    return {
        "p7_found": r + "SELECT id FROM r WHERE rank > greatest(1, n // 20)",
        "p7_kept": r + "SELECT batch_no, site, count(*) AS kept, CAST(sum(CAST(round(quality * 1000000) AS BIGINT)) AS BIGINT) AS quality FROM r WHERE rank <= greatest(1, n // 20) GROUP BY batch_no, site",
    }


SQL = _sql()
