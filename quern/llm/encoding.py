"""Problem 4: text that was decoded with the wrong code page.

A wrong code page is a substitution cipher: each byte, or run of bytes, of the true text stands as other letters. Which cipher
a piece of text went through is hidden. Expectation-maximisation finds it: a character bigram model of the corpus (most of
which is sound) scores what each possible inverse makes of the piece; the expected numbers of pieces by cipher and source
give the next round's priors. The expected counts of (symbols, letter) give each source's table from symbols to letters, which
translate() applies where it is one to one, and which also restores pieces that no cipher inverts as a whole.

No swap is listed by hand: the code pages are all single-byte ones that Python has, and any may have been taken for UTF-8 or
for any other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from encodings.aliases import aliases
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import site
from quern.session import cut, read



def _single_byte_pages() -> dict[str, str]:
    """The code pages that give ASCII as it is and at least 90 of the other bytes a character of their own: name -> their upper half, by byte."""
    found: dict[str, str] = {}
    for name in sorted(set(aliases.values())):
        try:
            if bytes(range(32, 127)).decode(name) != bytes(range(32, 127)).decode("ascii"):
                continue
            upper = "".join(bytes([b]).decode(name, "replace")[:1] or "\ufffd" for b in range(128, 256))
        except (LookupError, UnicodeError, TypeError, ValueError):
            continue
        if len(set(upper) - {"\ufffd"}) >= 90 and len(upper) == 128 and upper not in found.values():
            found[name] = upper
    return found


PAGES = _single_byte_pages()
#: By wrong page, symbol -> byte; by true page, byte -> letter: two such tables make a cipher.
SYMBOLS = {name: {ord(c): 128 + k for k, c in enumerate(upper) if c != "\ufffd"} for name, upper in PAGES.items()}
for _name in ("cp1252", "cp1250"):  # their undefined bytes pass as controls
    SYMBOLS[_name] |= {k: k for k in range(128, 160) if k not in SYMBOLS[_name].values()}
WIDE_PAGES = ("gb18030", "big5", "cp932", "euc_kr")
#: For whole lines, as the bytes may be ASCII in part.
LINE_SWAPS = [(w, r) for w in ("latin_1", "cp1252") for r in ("gb18030", "big5", "euc_jp", "cp932", "euc_kr")]
LINE_SWAPS += [("gb18030", "big5"), ("gb18030", "euc_jp"), ("gb18030", "cp932"), ("big5", "gb18030"), ("cp932", "gb18030"), ("cp932", "euc_jp"), ("gb18030", "utf-8"), ("big5", "utf-8"), ("cp932", "utf-8"), ("euc_kr", "utf-8"), *((w, "utf-8") for w in PAGES)]
LOST = "�"
RUN = re.compile("[^\x00-\x7f]+")
FOUR = re.compile("[^\x00-\x7f]{4}")
WIDE = re.compile("[぀-ヿ㐀-鿿가-힯]")
CONTROL = re.compile("[\x80-\x9f]")
NARROW_RUN = re.compile("[^\x00-\x7f\u3000-\u30ff\u3400-\u9fff\uac00-\ud7af\uff00-\uffef]+")
#: Swaps of one single-byte page for another are tried where a line's characters are so rare in the corpus, in nats each.
UNLIKELY = -8.0
SHIFT = 21  # bits of a code point

PAIR = T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.LongType())])
PIECE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("swap", T.StringType()),
        T.StructField("gain", T.DoubleType()),
        T.StructField("garbled", T.StringType()),
        T.StructField("restored", T.StringType()),
    ]
)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _wide(c: np.ndarray) -> np.ndarray:
    """Ideographs, kana and hangul: for these single characters are counted, not pairs."""
    return ((c >= 0x3040) & (c <= 0x30FF)) | ((c >= 0x3400) & (c <= 0x9FFF)) | ((c >= 0xAC00) & (c <= 0xD7AF))


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        c = _points("\n".join(t for t in df["text"] if t)).astype(np.int64)
        if not len(c):
            continue
        single, n = np.unique(c, return_counts=True)
        a, b = c[:-1], c[1:]
        odd = ((a > 127) | (b > 127)) & ~_wide(a) & ~_wide(b)
        pair, m = np.unique(a[odd] << SHIFT | b[odd], return_counts=True)
        # a single character is stored with a first member that no text has
        yield pd.DataFrame({"pair": np.concatenate([single | (0x1FFFFF << SHIFT), pair]), "n": np.concatenate([n, m]).astype(np.int64)})


class Language:
    """log P(character | the one before), from counts over the whole corpus."""

    def __init__(self, pairs: np.ndarray, n: np.ndarray):
        first, second = pairs >> SHIFT, pairs & 0x1FFFFF
        one = first == 0x1FFFFF
        total = max(1, n[one].sum())
        self.floor = float(np.log(0.05 / (total + 1e5)))
        self.single = np.full(0x110000, self.floor, dtype=np.float32)
        self.single[second[one]] = np.log(n[one] / (total + 1e5))
        count = np.zeros(0x110000, dtype=np.int64)
        count[second[one]] = n[one]
        p = 0.9 * n[~one] / np.maximum(1, count[first[~one]]) + 0.1 * np.exp(self.single[second[~one]])
        self.pair = dict(zip(pairs[~one].tolist(), np.log(p).tolist(), strict=True))
        self.single[ord(LOST)] = self.floor
        self.common = np.zeros(0x110000, dtype=bool)
        self.common[second[one]] = n[one] > total * 2e-5

    def score(self, text: str, before: str, after: str) -> float:
        total, last = 0.0, ord(before)
        for ch in text + after:
            c = ord(ch)
            known = self.pair.get(last << SHIFT | c)
            total += known if known is not None else float(self.single[c]) - 2.3
            last = c
        return total

    def flat(self, text: str) -> float:
        return float(self.single[_points(text)].sum())


def _bytes(text: str, wrong: str) -> bytes | None:
    try:
        if wrong in SYMBOLS:
            table = SYMBOLS[wrong]
            return bytes([c if c < 128 else table[c] for c in map(ord, text)])
        return text.encode(wrong)
    except (UnicodeError, KeyError):
        return None


def _sane(out: str, text: str) -> bool:
    return out != text and not (CONTROL.search(out) and not CONTROL.search(text))


@lru_cache(maxsize=50_000)
def _run_ways(run: str) -> tuple[tuple[str, str], ...]:
    """What the bytes of a run are in UTF-8, once or twice over, whatever page they were read by."""
    out: dict[str, str] = {}
    for wrong in (*PAGES, *WIDE_PAGES):
        raw = _bytes(run, wrong)
        try:
            once = None if raw is None else raw.decode("utf-8")
        except UnicodeError:
            continue
        if once is None or not _sane(once, run):
            continue
        out.setdefault(once, f"{wrong}>utf-8")
        try:
            again = None if once.isascii() or (raw := _bytes(once, wrong)) is None else raw.decode("utf-8")
        except UnicodeError:
            again = None
        if again is not None and _sane(again, once):
            out.setdefault(again, f"{wrong}>utf-8 twice")
    return tuple((s, t) for t, s in out.items())


@lru_cache(maxsize=50_000)
def _page_ways(run: str) -> tuple[tuple[str, str], ...]:
    """What a run is if one single-byte page was taken for another."""
    out: dict[str, str] = {}
    raws = {raw: wrong for wrong in reversed(PAGES) if (raw := _bytes(run, wrong)) is not None}
    for raw, wrong in raws.items():
        for right, upper in PAGES.items():
            text = "".join(upper[b - 128] if b > 127 else chr(b) for b in raw)
            if LOST not in text and right != wrong and _sane(text, run):
                out.setdefault(text, f"{wrong}>{right}")
    return tuple((s, t) for t, s in out.items())


def _line_ways(line: str) -> list[tuple[str, str]]:
    """Whole-line inverses; a few undecodable bytes are let pass, as a character may have been lost before."""
    out = []
    for wrong, right in LINE_SWAPS:
        raw = _bytes(line.replace(LOST, "?"), wrong)
        if raw is None:
            continue
        text = raw.decode(right, "replace")
        if text != line and text.count(LOST) * 12 <= len(text):
            out.append((f"{wrong}>{right}", text))
    return out


def _pieces(language):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lm: Language = language.value
        for df in batches:
            out = []
            for i, source, text in zip(df["id"], df["source"], df["text"], strict=True):
                if text and not text.isascii() and not _sound(lm, text):
                    out += ((i, source, *x) for x in _suspicious(lm, text))
            yield pd.DataFrame(out, columns=[f.name for f in PIECE]).astype({"id": "int64", "line_no": "int32"})

    return run


def _sound(lm: Language, text: str) -> bool:
    """Narrow text none of whose runs can have been UTF-8, nor is unlikely by itself: nothing can be suspicious in it."""
    if WIDE.search(text) or LOST in text or FOUR.search(text):
        return False
    return not any(_run_ways(r) or lm.flat(r) < UNLIKELY * len(r) for r in set(RUN.findall(text)))


def _suspicious(lm: Language, text: str) -> Iterator[tuple]:
    """(line_no, swap, gain, garbled, restored) of each cipher that explains a line better than no cipher."""
    for no, line in enumerate(text.split("\n"), 1):
        if line.isascii():
            continue
        if LOST in line:
            yield no, "lost", 1e3, line, None
        n_odd = n_wide = 0
        if WIDE.search(line):
            c = _points(line)
            odd = c > 127
            wide = _wide(c)
            n_odd, n_wide = int(odd.sum()), int(wide.sum())
            level = float(lm.single[c[wide]].mean())
            if n_wide * 2 > n_odd and level > -9.5 and lm.common[c[odd & ~wide]].all():
                continue  # common characters of a wide script
        runs = list((NARROW_RUN if n_wide * 2 > n_odd else RUN).finditer(line))
        narrow = "".join(m[0] for m in runs if not WIDE.search(m[0]))
        unlikely = len(narrow) > 0 and lm.flat(narrow) < UNLIKELY * len(narrow)  # of the line: a short run says little
        for m in runs:
            piece = m[0]
            before, after = line[m.start() - 1 : m.start()] or "\n", line[m.end() : m.end() + 1] or "\n"
            ways = _run_ways(piece) if len(piece) <= 64 else _run_ways.__wrapped__(piece)
            now = lm.score(piece, before, after)
            if not ways and unlikely and not WIDE.search(piece):
                ways = _page_ways(piece) if len(piece) <= 64 else _page_ways.__wrapped__(piece)
            for swap, restored in ways:
                gain = lm.score(restored, before, after) - now
                if gain > 0:
                    yield no, swap, gain, piece, restored
        if n_wide * 2 > n_odd >= 4 or FOUR.search(line):
            n_odd = n_odd or len(line) - len(line.encode("ascii", "ignore"))
            now = lm.flat(line)
            ways = [(lm.flat(restored) - now, swap, restored) for swap, restored in _line_ways(line)]
            if ways and (best := max(ways))[0] > 2.0 * n_odd ** 0.5:
                yield no, best[1], best[0], line, best[2]


def learn(docs: DataFrame) -> DataFrame:
    """The bigram counts of docs(text): (pair, n), over all documents."""
    return docs.select("text").mapInPandas(_count_pairs, PAIR).groupBy("pair").agg(F.sum("n").alias("n"))


def pieces(docs: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(id, source, line_no, swap, gain, garbled, restored): every reading of a piece by which a cipher raises its likelihood.

    The model is learned from all docs; only(id), if given, has the texts whose pieces are wanted.

    The model sent to the tasks has a row for each character, and for each pair of characters of which one isn't ASCII
    and none is of a wide script: alphabets bound it, not the corpus. Rows without id have no pieces, and null and empty texts
    have none; a null source is a source; repeated rows count once.
    """
    spark = docs.sparkSession
    counts = cut(learn(docs)).toPandas()
    model = spark.sparkContext.broadcast(Language(counts["pair"].to_numpy(dtype=np.int64), counts["n"].to_numpy(dtype=np.int64)))
    wanted = docs if only is None else docs.join(only, "id", "left_semi")
    return wanted.select("id", "source", "text").where("id is not null").mapInPandas(_pieces(model), PIECE)


#: Multi-byte sequences that are valid UTF-8 hardly arise in sound text; single letters that another code page explains do.
UTF8_PRIOR, OTHER_PRIOR, LEAST_GAIN = 0.5, 1e-3 / max(1, len(PAGES)), 8.0


def solve(found: DataFrame, *, rounds: int = 3) -> DataFrame:
    """The pieces with their responsibility: the probability that the piece went through that cipher.

    EM over sources: the E-step weighs each reading by its likelihood gain and the cipher's prior in the source against
    no cipher; the M-step sets the prior from the expected numbers, smoothed by the prior of all sources.
    """
    prior = F.when(F.col("swap").contains(">utf-8"), UTF8_PRIOR).otherwise(OTHER_PRIOR)
    p = found.withColumn("p", prior)
    for step in range(rounds):
        weight = F.exp(F.least(F.col("gain"), F.lit(300.0)) + F.log("p"))
        each = p.withColumn("w", weight)
        total = each.groupBy("id", "line_no", "garbled").agg(F.sum("w").alias("all"))
        p = each.join(total, ["id", "line_no", "garbled"]).withColumn("share", F.col("w") / (1 + F.col("all"))).drop("w", "all")
        if step < rounds - 1:
            by = p.groupBy("source", "swap").agg(F.sum("share").alias("e"), F.count("*").alias("n"))
            by = by.select(F.col("source").alias("_s"), F.col("swap").alias("_w"), (0.998 * (F.col("e") + prior) / (F.col("n") + 1)).alias("new"))
            p = p.join(by, F.col("source").eqNullSafe(F.col("_s")) & (F.col("swap") == F.col("_w"))).select(*PIECE.names, F.col("new").alias("p"))
    return p.select(*PIECE.names, "share")


UNIT = T.ArrayType(T.StructType([T.StructField("symbols", T.StringType()), T.StructField("letter", T.StringType())]))


def _aligned(garbled: str, restored: str) -> list[tuple[str, str]]:
    """Which symbols stand for which letter: one for each byte of the letter in UTF-8, or one for each letter; nothing if neither fits."""
    if len(garbled) == len(restored):
        return [x for x in zip(garbled, restored, strict=True) if x[0] != x[1]]
    sizes = [len(c.encode("utf-8", "replace")) for c in restored]
    if sum(sizes) != len(garbled):
        return []
    ends = np.cumsum(sizes)
    return [(garbled[e - n : e], c) for e, n, c in zip(ends, sizes, restored, strict=True)]


@F.pandas_udf(UNIT)
def _units(garbled: pd.Series, restored: pd.Series) -> pd.Series:
    return pd.Series([[{"symbols": a, "letter": b} for a, b in _aligned(x, y)] for x, y in zip(garbled, restored, strict=True)])


def substitutions(solved: DataFrame) -> DataFrame:
    """(source, symbols, letter): each source's table, by the expected counts of all its pieces, whatever their length."""
    sure = solved.where("restored is not null and share > 0.01")
    each = sure.select("source", "share", F.explode(_units("garbled", "restored")).alias("u")).groupBy("source", "u.symbols", "u.letter").agg(F.sum("share").alias("n"))
    return each.groupBy("source", "symbols").agg(F.max(F.struct("n", "letter")).alias("m"), F.sum("n").alias("all")).where("m.n > 0.5 and m.n > 0.8 * all").select("source", "symbols", F.col("m.letter").alias("letter"))


def found_ids(solved: DataFrame) -> DataFrame:
    """Texts with a piece that more likely than not went through a cipher."""
    sure = F.when(F.col("swap").contains(">utf-8"), F.greatest("gain", F.lit(LEAST_GAIN))).otherwise(F.col("gain"))
    piece = solved.groupBy("id", "line_no", "garbled").agg(F.sum("share").alias("s"), F.max(sure).alias("gain"))
    return piece.where("s > 0.5").groupBy("id").agg(F.sum("gain").alias("gain")).where(F.col("gain") >= LEAST_GAIN).select("id")


def restore(docs: DataFrame, solved: DataFrame) -> DataFrame:
    """(id, text, lost): the found texts with their pieces replaced by the likeliest readings; lost: characters that can't be won back.

    Runs that consist of the source's garbled symbols alone, at least two of them, are rewritten by the source's table: symbols
    that stand for a letter each by translate(), as they have the evidence of the whole source. Other pieces are rewritten by
    readings of their own, and those without one by the table's runs of symbols.
    """
    best = solved.where("restored is not null and share > 0.2").groupBy("id", "line_no", "garbled").agg(F.max(F.struct("share", "restored")).alias("m"))
    per = best.groupBy("id").agg(F.collect_list(F.struct("line_no", "garbled", F.col("m.restored").alias("restored"))).alias("pieces"))
    single = F.length("symbols") == 1
    # alphabets bound a source's table; it goes with the found texts only
    table = substitutions(solved).groupBy("source").agg(
        F.sort_array(F.collect_list(F.when(single, F.struct("symbols", "letter")))).alias("ones"),
        F.sort_array(F.collect_list(F.when(~single, F.struct("symbols", "letter")))).alias("runs"),
    )
    side = lambda name: F.array_join(F.transform("ones", lambda x: x[name]), "")
    table = table.select(F.col("source").alias("_s"), side("symbols").alias("from_symbols"), side("letter").alias("to_letters"), "runs")
    both = docs.select("id", "source", "text").join(found_ids(solved), "id").dropDuplicates(["id"]).join(per, "id", "left").join(table, F.col("source").eqNullSafe(F.col("_s")), "left")
    done = both.withColumn("text", _rewrite("text", "pieces", "runs", "from_symbols"))
    # what has readings of its own is marked, so that translate() passes it over
    parts = F.transform(F.split("text", OWN), lambda part, k: F.when(k % 2 == 1, part).otherwise(F.call_function("translate", part, F.coalesce("from_symbols", F.lit("")), F.coalesce("to_letters", F.lit("")))))
    out = done.select("id", F.array_join(parts, "").alias("text"))
    return out.withColumn("lost", F.length("text") - F.length(F.regexp_replace("text", LOST, "")))


#: Set around what needs no table any more.
OWN = "\ue0ff"


@F.pandas_udf(T.StringType())
def _rewrite(texts: pd.Series, pieces: pd.Series, runs: pd.Series, ones: pd.Series) -> pd.Series:
    out = []
    for text, some, table, single in zip(texts, pieces, runs, ones, strict=True):
        own: dict[int, dict[str, str]] = {}
        for x in some if some is not None else []:
            own.setdefault(x["line_no"], {})[x["garbled"]] = x["restored"]
        units = {x["symbols"]: x["letter"] for x in (table if table is not None else [])}
        known = re.compile("|".join(map(re.escape, sorted(units, key=len, reverse=True)))) if units else None
        letters = set(single or "")

        def swap(m: re.Match, mine: dict, units: dict = units, known: re.Pattern | None = known, letters: set = letters) -> str:
            run = m[0]
            if len(run) > 1 and letters.issuperset(run):
                return run  # left to translate()
            if run in mine:
                return f"{OWN}{mine[run]}{OWN}"
            if known and len(run) > 1 and not known.sub("", run):
                return f"{OWN}{known.sub(lambda x: units[x[0]], run)}{OWN}"
            return f"{OWN}{run}{OWN}"

        lines = text.replace(OWN, "").split("\n")
        for no, line in enumerate(lines, 1):
            if not line.isascii():
                mine = own.get(no, {})
                lines[no - 1] = f"{OWN}{mine[line]}{OWN}" if line in mine else (NARROW_RUN if WIDE.search(line) else RUN).sub(lambda m, mine=mine: swap(m, mine), line)
        out.append("\n".join(lines))
    return pd.Series(out)


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent").select("id", site(F.col("source_doc")).alias("source"), "text")


def wrongly_decoded(spark: SparkSession, d: str, only: DataFrame | None = None) -> DataFrame:
    return found_ids(solve(cut(pieces(_parents(spark, d), only))))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return wrongly_decoded(spark, d)


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    docs = _parents(spark, d)
    return restore(docs, cut(solve(cut(pieces(docs)))))


QUERIES = {"p4_found": p4_found, "p4_restored": p4_restored}
SQL: dict[str, str] = {}
