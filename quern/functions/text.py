"""Text expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "[\\u4e00-\\u9fff]"


def site(source_doc: Column) -> Column:
    """The host of an address: lower case, without user part, port, final dot and a leading "www.".

    A value without "//" is returned whole; null gives null.
    """
    authority = F.regexp_extract(source_doc, "//([^/?#]*)", 1)
    host = F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", "")
    host = F.regexp_replace(F.lower(F.regexp_replace(host, "\\.$", "")), "^www\\.", "")
    return F.when(source_doc.contains("//"), host).otherwise(source_doc)


def strip(c: Column) -> Column:
    """Drop white space of any kind at both ends (Spark's trim drops blanks only)."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def snippet(c: Column, n: int = 160) -> Column:
    return F.substring(squeeze(c), 1, n)


def has_cjk(c: Column) -> Column:
    return c.rlike(CJK)


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def url_host(c: Column) -> Column:
    """The third part of an address split at "/", as it stands (port and user part kept)."""
    return F.when(c.contains("//"), F.split_part(c, F.lit("/"), F.lit(3))).otherwise(c)


def terms(c: Column) -> Column:
    """Words of letters and digits in lower case, and the overlapping pairs of neighbouring ideographs."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[\\p{L}\\p{N}&&[^\\u4e00-\\u9fff]]+"), F.lit(0))
    pairs = F.regexp_extract_all(c, F.lit("(?=([\\u4e00-\\u9fff]{2}))"), F.lit(1))
    return F.concat(words, pairs)
