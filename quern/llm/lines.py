"""Problem 5: lines repeated across one site's documents, by prefix-projected sequential patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import site
from quern.session import cut, read


def letters(line: Column) -> Column:
    """What makes two lines the same: their letters in lower case."""
    return F.lower(F.regexp_replace(line, "[^\\p{L}]+", ""))


def line_items(docs: DataFrame, *, id_col: str = "id", text_col: str = "text", doc_col: str = "source_doc", least_letters: int = 12) -> DataFrame:
    """(site, doc, id, line_no, item): one row for each line with enough letters; item is 96 bits of hash.

    Null texts, addresses or ids give no rows. Lines are counted from 1, blank ones too.
    """
    lines = docs.select(F.col(id_col).alias("id"), F.xxhash64(doc_col).alias("doc"), F.xxhash64(site(F.col(doc_col))).alias("site"), F.posexplode(F.split(text_col, "\n")).alias("at", "line")).where(F.col(doc_col).isNotNull() & (F.length("line") >= least_letters))
    keyed = lines.withColumn("key", letters(F.col("line"))).where(F.length("key") >= least_letters)
    return keyed.select("site", "doc", "id", (F.col("at") + 1).alias("line_no"), F.xxhash64("key").alias("item"), F.hash("key").alias("item2"))


def site_support(docs: DataFrame, least_docs: int, least_share: float, *, doc_col: str = "source_doc") -> DataFrame:
    """(site, need): how many different source_doc values a pattern of the site must occur in."""
    counted = docs.where(F.col(doc_col).isNotNull()).select(F.xxhash64(site(F.col(doc_col))).alias("site"), F.xxhash64(doc_col).alias("doc")).distinct().groupBy("site").count()
    return counted.select("site", F.greatest(F.lit(float(least_docs)), F.col("count") * least_share).alias("need"))


def frequent_items(items: DataFrame, need: DataFrame) -> DataFrame:
    """Level 1: the single lines with enough different documents."""
    counted = items.select("site", "item", "item2", "doc").distinct().groupBy("site", "item", "item2").agg(F.count("*").alias("docs"))
    return counted.join(need, "site").where(F.col("docs") >= F.col("need")).select("site", "item", "item2", "docs")


def frequent_sequences(items: DataFrame, need: DataFrame) -> DataFrame:
    """(site, pattern ARRAY<BIGINT>, docs): PrefixSpan over each text's sequence of frequent lines.

    Each level joins the prefixes' projected databases (text and the place after the prefix's earliest match) with
    the frequent lines that follow, keeps extensions with enough documents, and goes on until no extension has. All
    frequent sequences come out, not the closed ones alone: a block of n lines that always stand together has 2^n - 1.
    """
    single = frequent_items(items, need)
    rows = cut(items.join(single.drop("docs"), ["site", "item", "item2"], "left_semi").drop("item2"))
    found = single.select("site", F.array("item").alias("pattern"), "docs")
    state = rows.groupBy("site", "doc", "id", F.array("item").alias("pattern")).agg(F.min("line_no").alias("after"))
    follow = rows.select("site", F.col("doc").alias("_doc"), F.col("id").alias("_id"), "item", "line_no")
    while True:
        longer = (
            state.join(follow.withColumnsRenamed({"_id": "id", "_doc": "doc"}), ["site", "doc", "id"])
            .where(F.col("line_no") > F.col("after"))
            .groupBy("site", "doc", "id", F.concat("pattern", F.array("item")).alias("pattern"))
            .agg(F.min("line_no").alias("after"))
        )
        counted = longer.select("site", "pattern", "doc").distinct().groupBy("site", "pattern").agg(F.count("*").alias("docs"))
        kept = cut(counted.join(need, "site").where(F.col("docs") >= F.col("need")).select("site", "pattern", "docs"))
        if kept.isEmpty():
            return found
        found = found.unionByName(kept)
        state = cut(longer.join(kept.drop("docs"), ["site", "pattern"], "left_semi"))


def line_blocks(items: DataFrame, need: DataFrame) -> DataFrame:
    """(site, item, block): frequent lines that stand in the very same documents of a site (told by number and hash) form a block."""
    marked = items.select("site", "item", "doc").distinct().groupBy("site", "item").agg(F.count("*").alias("docs"), F.bit_xor("doc").alias("mark"))
    frequent = marked.join(need, "site").where(F.col("docs") >= F.col("need"))
    blocks = frequent.groupBy("site", "docs", "mark").agg(F.min("item").alias("block"))
    return frequent.join(blocks, ["site", "docs", "mark"]).select("site", "item", "block")


def repeated_lines(docs: DataFrame, *, least_docs: int = 4, least_share: float = 0.1, least_letters: int = 12) -> DataFrame:
    """(id, line_no) of every occurrence of a line that belongs to a frequent sequence of its site.

    Single lines are sequences too. The sequences are those of blocks of lines, so that a footer of n lines which always stand
    together is one item instead of 2^n - 1 sequences; no line is lost by it, as a block's lines are frequent in the same documents.
    Null text or source_doc: no rows. Repeated rows count once as documents, and each comes out.
    """
    items = cut(line_items(docs, least_letters=least_letters))
    need = cut(site_support(docs, least_docs, least_share))
    blocks = cut(line_blocks(items, need))
    rows = items.join(blocks, ["site", "item"])
    found = frequent_sequences(rows.select("site", "doc", "id", "line_no", F.col("block").alias("item"), F.lit(0).alias("item2")), need)
    kept = found.select("site", F.explode("pattern").alias("block")).distinct()
    return rows.join(kept, ["site", "block"], "left_semi").select("id", "line_no")


def without_lines(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs(id, text) with the given (id, line_no) removed from the text."""
    gone = repeated.groupBy("id").agg(F.collect_set("line_no").alias("_gone"))
    kept = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("_gone", (i + 1).cast("int")))
    return docs.join(gone, "id", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("_gone")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent and not doc_version <=> 'raw'").select("id", "source_doc", "text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines(_parents(spark, d))


def p5_sequences(spark: SparkSession, d: str) -> DataFrame:
    docs = _parents(spark, d)
    found = frequent_sequences(line_items(docs), site_support(docs, 4, 0.1))
    return found.groupBy("site", F.size("pattern").alias("lines")).agg(F.count("*").alias("patterns"), F.max("docs").alias("most_docs"))


def p5_cleaned(spark: SparkSession, d: str) -> DataFrame:
    docs = _parents(spark, d)
    return without_lines(docs.select("id", "text"), repeated_lines(docs)).select("id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


SITE_SQL = """CASE WHEN source_doc LIKE '%//%' THEN regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(
 regexp_extract(source_doc, '//([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '\\.$', '')), '^www\\.', '') ELSE source_doc END"""

P5_SQL = f"""
WITH p AS (SELECT id, source_doc, {SITE_SQL} AS site, text FROM chunks WHERE is_parent AND doc_version IS DISTINCT FROM 'raw'),
s AS (SELECT site, count(DISTINCT source_doc) AS n FROM p GROUP BY site),
x AS (SELECT id, source_doc, site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM p),
l AS (SELECT *, lower(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) AS key FROM x),
f AS (SELECT site, key FROM l JOIN s USING (site) WHERE length(key) >= 12 GROUP BY site, key, n HAVING count(DISTINCT source_doc) >= greatest(4, 0.1 * n))
"""

QUERIES = {"p5_found": p5_found, "p5_sequences": p5_sequences, "p5_cleaned": p5_cleaned}
SQL = {
    "p5_found": P5_SQL + "SELECT id, CAST(line_no AS INTEGER) AS line_no FROM l JOIN f USING (site, key)",
    "p5_cleaned": P5_SQL
    + """, c AS (SELECT p.id, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(string_agg(CASE WHEN f.key IS NULL THEN l.line END, chr(10) ORDER BY l.line_no), '') END AS text
 FROM p LEFT JOIN l ON l.id = p.id LEFT JOIN f ON f.site = l.site AND f.key = l.key GROUP BY p.id, p.text) SELECT id, sha256(text) AS sha256, length(text) AS chars FROM c""",
}
