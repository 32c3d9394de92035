"""Problem 3: the page around the article, by templates of tokens that share occurrence vectors across a site's pages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import site
from quern.session import cut, read

BULLET = re.compile(r"^\s*(?:[-*+•–·▪]|\d{1,3}[.)])\s+")
LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")
SEPARATOR = re.compile(r"\s*[|/›>»·•→←↑,，、]\s*|\s{2,}")
PREFIX = re.compile(r"^\s*([^:：]{2,24})[:：]\s*\S")
NUMBER = re.compile(r"\d+(?:[.,]\d+)*")
WORD = re.compile(r"[A-Z][a-z]{3,}")
SENTENCE_END = re.compile(r"[.!?。！？…:：;；”\"’)）*_]\s*$")
WIDE = re.compile("[぀-ヿ㐀-鿿]")

TOKEN = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("token", T.LongType()),
        T.StructField("page", T.LongType()),
        T.StructField("at", T.IntegerType()),
        T.StructField("times", T.IntegerType()),
        T.StructField("prose", T.BooleanType()),
        T.StructField("heading", T.BooleanType()),
    ]
)
FOUND = T.StructType([T.StructField("id", T.LongType()), T.StructField("line_no", T.IntegerType())])


def _hash(kind: str, s: str) -> int:
    """61 bits, so that two can be added to them."""
    return xxhash.xxh3_64_intdigest(kind + s) >> 3


def signature(line: str, host: str) -> str:
    """The line with numbers alike, and words of the host's name left out."""
    s = NUMBER.sub("0", line.strip())
    return WORD.sub(lambda m: "~" if m[0].lower() in host else m[0], s)


def line_tokens(line: str, host: str) -> tuple[int, list[int], int | None]:
    """Hashes of the whole line, of its parts (menu entries, without bullets and link marks), and of the words before a colon."""
    s = signature(line, host)
    bare = BULLET.sub("", LINK.sub(r"\1", s))
    parts = [p for p in SEPARATOR.split(bare) if p]
    m = PREFIX.match(bare)
    return _hash("l", s), [_hash("p", p) for p in parts], _hash("c", m[1]) if m else None


def is_prose(line: str) -> bool:
    """A line long enough for sentences, ending like one."""
    n = len(line) + 1.5 * len(WIDE.findall(line))
    return n >= 50 and not BULLET.match(line) and (bool(SENTENCE_END.search(line)) or n >= 120)


def _fences(lines: list[str]) -> list[bool]:
    inside, out = False, []
    for line in lines:
        fence = line.lstrip().startswith("```")
        out.append(inside or fence)
        inside ^= fence
    return out


def _page_tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A page's different tokens, each with the line of its last occurrence and their number; prose, heading: the token is a whole line of prose, a heading."""
    for df in batches:
        rows = []
        for host, text in zip(df["host"], df["text"], strict=True):
            lines = (text or "").split("\n")
            code = _fences(lines)
            prose = [is_prose(x) for x in lines]
            # all prose lines make the page: a notice that many pages share, however long, doesn't make them one
            page = _hash("t", "\n".join(sorted({x.strip() for x, p in zip(lines, prose, strict=True) if p} or {x.strip() for x in lines})))
            seen: dict[int, tuple[int, int, bool, bool]] = {}

            def note(token: int, k: int, p: bool, h: bool, seen: dict = seen) -> None:
                seen[token] = k, seen[token][1] + 1 if token in seen else 1, p, h

            for k, line in enumerate(lines):
                if code[k]:
                    if prose[k]:
                        note(_hash("k", line), k, True, False)
                elif line.strip():
                    whole, parts, prefix = line_tokens(line, host or "")
                    if len(line) <= 200:  # only short lines are menus or labels
                        for t in (*parts, *([prefix] if prefix is not None else [])):
                            note(t, k, False, line.lstrip().startswith("#"))
                    note(whole, k, prose[k], line.lstrip().startswith("#"))
            rows += ((host, t, page, *x) for t, x in seen.items())
        yield pd.DataFrame(rows, columns=TOKEN.names).astype({"token": "int64", "page": "int64", "at": "int32", "times": "int32", "prose": "bool", "heading": "bool"})


def _placed(once: DataFrame, sizes: DataFrame, total: DataFrame, host_share: float, all_share: float, least: int) -> DataFrame:
    """once with slot, the place of a token in its page: 0 before the first line of the page's own prose, 1 inside it, 2 after the last.

    Prose lines that recur like a template's don't count as the page's own; a page without any has slot 2 throughout.
    """
    lines = once.where("prose").groupBy("host", "token").agg(F.count("*").alias("n"))
    of_host = lines.join(sizes, "host").where((F.col("n") >= least) & (F.col("n") >= F.col("pages") * host_share)).select("host", "token")
    of_all = lines.groupBy("token").agg(F.sum("n").alias("n")).join(F.broadcast(total)).where((F.col("n") >= least) & (F.col("n") >= F.col("pages") * all_share)).select("token")
    own = once.where("prose").join(of_host, ["host", "token"], "left_anti").join(of_all, "token", "left_anti")
    span = own.groupBy("host", "page").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    slot = F.when(F.col("at") < F.col("first"), 0).when(F.col("at") < F.col("last"), 1).otherwise(2)
    return once.join(span, ["host", "page"], "left").withColumn("slot", slot)


def template_classes(placed: DataFrame) -> DataFrame:
    """(host, cls, n, size, tokens, ordered): the equivalence classes of tokens.

    Tokens with the same occurrence vector (which of the host's pages have them, and how often, compared by hash) form a
    class: no larger than a page. ordered: the share of its pages in which the class's tokens stand in its most frequent order.
    """
    slots = [F.count_if(F.col("slot") == k).alias(f"in{k}") for k in range(3)]
    vectors = placed.groupBy("host", "token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("page", "times")).alias("v1"), F.sum(F.xxhash64("times", "page").cast("decimal(20,0)")).alias("v2"), F.max("heading").alias("heading"), *slots)
    cls = F.xxhash64("n", "v1", "v2")
    classes = vectors.groupBy("host", cls.alias("cls")).agg(F.max("n").alias("n"), F.count("*").alias("size"), F.collect_list(F.struct("token", "heading", "in0", "in1", "in2")).alias("tokens"))
    members = classes.where("size > 1").select("host", "cls", F.explode("tokens.token").alias("token"))
    of_page = placed.join(members, ["host", "token"]).groupBy("host", "cls", "page").agg(F.hash(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"])).alias("order"))
    ordered = of_page.groupBy("host", "cls", "order").agg(F.count("*").alias("m")).groupBy("host", "cls").agg((F.max("m") / F.sum("m")).alias("ordered"))
    return classes.join(ordered, ["host", "cls"], "left").withColumn("ordered", F.coalesce("ordered", F.lit(1.0)))


def template_tokens(pages: DataFrame, *, host_share: float = 0.05, all_share: float = 0.01, least: int = 3, nested: float = 0.75, strong: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """(by host, over all hosts): the tokens of the template, with their place in it.

    The template is made of the equivalence classes that occur in at least least pages, with different articles, and in the
    share host_share of the host's pages, and that nest: their tokens keep one order, and a class lies in one slot of the
    page in the share nested of its pages, before the article, inside its span or after it. A class that floats from slot to slot, or a
    heading inside the article, is of the template only with strong times the support: an article's own headings and labels
    recur too. A token's place is "tail" where it hardly ever has prose after it. Pages with the same prose lines
    count once, so copies of one article don't make it a template. Over all hosts, tokens of at
    least two hosts are counted in the same way, for hosts with few pages.
    """
    tokens = pages.mapInPandas(_page_tokens, TOKEN)
    once = cut(tokens.groupBy("host", "token", "page").agg(F.max("at").alias("at"), F.max("times").alias("times"), F.max("prose").alias("prose"), F.max("heading").alias("heading")))
    sizes = once.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    total = sizes.agg(F.sum("pages").alias("pages"))  # one row
    placed = cut(_placed(once, sizes, total, host_share, all_share, least))
    classes = template_classes(placed).join(sizes, "host")
    inside = lambda k: F.aggregate("tokens", F.lit(0).cast("long"), lambda acc, t: acc + t[f"in{k}"])
    one_slot = F.greatest(*(inside(k) for k in range(3))) >= nested * F.col("n") * F.col("size")
    own_heading = F.forall("tokens", lambda t: t["heading"]) & (inside(1) * 2 >= F.col("n") * F.col("size"))
    support = F.col("pages") * host_share
    valid = (F.col("n") >= least) & (F.col("n") >= support) & (F.col("ordered") >= 0.9) & ((one_slot & ~own_heading) | (F.col("n") >= strong * support))
    each = classes.where(valid).select("host", "n", F.explode("tokens").alias("t"))
    by_host = each.select("host", "t.token", ((F.col("t.in0") + F.col("t.in1")) < 0.25 * F.col("n")).alias("tail"), F.lit(True).alias("strong"))
    of_host = placed.groupBy("token", "host").agg(F.count("*").alias("n"), F.count_if(F.col("slot") < 2).alias("followed"), F.count_if(F.col("heading") & (F.col("slot") == 1)).alias("headed"))
    everywhere = of_host.groupBy("token").agg(F.sum("n").alias("n"), F.sum("followed").alias("followed"), F.sum("headed").alias("headed"), F.count("*").alias("hosts")).join(F.broadcast(total))
    everywhere = everywhere.where((F.col("n") >= least) & (F.col("n") >= F.col("pages") * all_share) & (F.col("hosts") > 1) & ((F.col("headed") * 2 < F.col("n")) | (F.col("n") >= strong * all_share * F.col("pages"))))
    return by_host, everywhere.select("token", (F.col("followed") < 0.25 * F.col("n")).alias("tail"), (F.col("n") >= 4 * all_share * F.col("pages")).alias("strong"))


def _places(packed) -> dict[int, bool]:
    return {int(t) >> 2: bool(int(t) & 1) for t in (packed if packed is not None else [])}


def _outside(text: str, host: str, own: dict[int, bool], common: dict[int, bool], strong: dict[int, bool]) -> Iterator[int]:
    """Numbers of the lines outside the article's slots. List entries need the host's tokens or common ones of strong support."""
    lines = text.split("\n")
    code = _fences(lines)
    template, tail = [False] * len(lines), [False] * len(lines)
    for k, line in enumerate(lines):
        if not line.strip() or code[k]:
            continue
        whole, parts, prefix = line_tokens(line, host)
        bullet = BULLET.match(line) is not None
        known = own.get(whole, common.get(whole))
        if known is None and parts:
            hits = [own.get(p, (strong if bullet else common).get(p)) for p in parts]
            if all(h is not None for h in hits) or (len(parts) > 1 and hits[0] is not None and len(line) <= 200 and not is_prose(line)):
                known = all(h is True for h in hits)
        if known is None and prefix is not None and not bullet and len(line) <= 200:
            known = own.get(prefix, common.get(prefix))
        if known is None and not bullet and not WIDE.search(line):
            words = line.split()  # a menu set in one line
            if 2 <= len(words) <= 12 and all(_hash("p", w) in own or _hash("p", w) in common for w in words):
                known = False
        if known is not None:
            template[k], tail[k] = True, known
    prose = [k for k, line in enumerate(lines) if line.strip() and not code[k] and not template[k] and is_prose(line)]
    last = prose[-1] if prose else -1
    end = len(lines)
    for k in range(last + 1, len(lines)):
        if template[k] and (tail[k] or not any(x.strip() and not template[j] for j, x in enumerate(lines) if j > k)):
            end = k
            break
    for k, line in enumerate(lines):
        if line.strip() and (template[k] or k >= end):
            yield k + 1


def _classify(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = _places(shared.value)
        strong = _places(t for t in shared.value if int(t) & 2)
        for df in batches:
            ids, numbers = [], []
            made: dict[tuple, dict[int, bool]] = {}
            for i, host, text, own in zip(df["id"], df["host"], df["text"], df["own"], strict=True):
                if not text:
                    continue
                key = (host, len(own) if own is not None else 0)
                if key not in made:
                    made[key] = _places(own)
                found = list(_outside(text, host or "", made[key], common, strong))
                ids += [i] * len(found)
                numbers += found
            yield pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "line_no": pd.Series(numbers, dtype="int32")})

    return run


def boilerplate_lines(pages: DataFrame) -> DataFrame:
    """(id, line_no): the non-blank lines of pages(id, source_doc, text) that don't belong to the article.

    A line is outside if it is a template token of its site (or of all), or made of such tokens; and so are the slots after the
    last paragraph, from the first tail token on (titles of other pages, tags, comments). The lists of tokens that
    go with the pages are bounded: a host has at most (tokens of a page) / host_share of them. Null and empty texts have no
    lines; a null address is a host of its own. Rows without id have none, and repeated ids count as one.
    """
    pages = pages.select("id", F.coalesce(site(F.col("source_doc")), F.lit("")).alias("host"), "text").where("id is not null")
    by_host, everywhere = template_tokens(pages)
    # hashes leave two bits, for the place and the strength
    packed = lambda: F.shiftleft(F.col("token"), 2) + F.col("strong").cast("long") * 2 + F.col("tail").cast("long")
    own = by_host.groupBy("host").agg(F.collect_list(packed()).alias("own"))
    common = everywhere.select(packed().alias("t")).toPandas()["t"].to_numpy()  # at most (tokens of a page) / all_share
    shared = pages.sparkSession.sparkContext.broadcast(common)
    return pages.join(own, "host", "left").select("id", "host", "text", "own").mapInPandas(_classify(shared), FOUND).dropDuplicates()


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent and doc_version = 'raw'").select("id", "source_doc", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate_lines(_pages(spark, d))


def p3_articles(spark: SparkSession, d: str) -> DataFrame:
    """The articles alone: their hash and length."""
    from quern.llm.lines import without_lines

    pages = _pages(spark, d)
    return without_lines(pages.select("id", "text"), boilerplate_lines(pages)).select("id", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


QUERIES = {"p3_found": p3_found, "p3_articles": p3_articles}
SQL: dict[str, str] = {}
