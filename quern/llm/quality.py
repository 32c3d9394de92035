"""Problem 1: statistics of each text, and texts that aren't prose, by empirical tail probabilities."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.ranking import group_cdf
from quern.session import cut, read

#: Common words of the languages met, by which prose is told from terms and strings.
COMMON = frozenset(
    """the a an of and or to in on for with by from at as is are was were be been had has have it its this that these
    those not no if but so than then when while because before after we our they their there which who what how why
    der die das den dem des ein eine einen einem einer und oder nicht ist war wird wurde hat haben mit von vom zum zur im am
    auf aus bei für auch als wie dass wenn weil aber sich es wir
    le la les un une des du de et ou ne pas est sont était a ont avec pour par sur dans que qui quand mais sans il
    elle nous au aux ce cette son sa ses plus
    el los las una unos del y o no es son fue ha han con para por en se lo que cuando pero sin su sus más
    os um uma uns do da dos das e ou não é foi tem com para por em no na nos nas se que quando mas sem seu sua mais""".split()
)
COMMON_IDEOGRAPHS = "的了是在和与我们这个把被都就也没有不先再更对从为让"
KANA = re.compile("[぀-ゟ]+")
HAN = re.compile("[㐀-鿿]+")
WIDE = re.compile("[぀-ヿ㐀-鿿]+")
ASCII = re.compile("[\x00-\x7f]+")
NOT_ASCII = re.compile("[^\x00-\x7f]+")
NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha())
SOUP = re.compile("[\u0080-\u024f\u0370-\u06ff]{4}")
ODD = re.compile("[\x80-\xbf\xc2\xc3\u0370-\u06ff\u2500-\u259f\ue000-\uf8ff\uff61-\uffdc\ufffd]")
SOUND = re.compile("[’‘“”–—…·•«»°§©→←↑›¿¡ªº]")
ENDS = tuple(".!?。！？…:：;；\"”’」)）")
ENTRY = re.compile(r"\s*(?:[-*+•–—·▪◦#>]\s|\[[ xX]?\]|\d{1,4}[.)、]\s?|\(\d+\)\s|[#][^\s#])")
RECORD = re.compile(r"\s*\[?(?:\d{4}[-/]\d\d?[-/]\d\d?[ T]?\d\d?:|\d\d:\d\d|v?\d+\.\d+\.\d+)")
GAPS = re.compile(r"\S(?:\t| {2,}|\u3000)(?=\S)")
FIELD = re.compile(r"[;|,\t，；]")
LONG = re.compile(r"[!-~]{40,}")
HEADING = re.compile(r"#{1,6} ")
STOP = re.compile("[。，！？；：,;]")
#: Ideographs set apart, as no sentence has them.
APART = re.compile("[\u3400-\u9fff）)](?:\\s{2,}| ?[/|·;,] ?|\\s)[\u3400-\u9fff（(]|\\s{2,}")
LETTER = re.compile(r"[^\W\d_]+")

SENTENCE_END = re.compile(r"[.!?](?=\s|$)|[。！？]")

#: The statistics that are ranked, and which tail of each tells that a text isn't prose; 0: either.
STATS = {"words": 0, "word_length": 0, "symbols": 1, "ends": -1, "common": -1, "broken": 1, "stops": -1}
STAT_ROW = T.StructType([T.StructField("id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("script", T.StringType()), *(T.StructField(s, T.DoubleType()) for s in (*STATS, "unprosaic"))])
#: Labels of fewer texts are ranked with all texts of their script.
LEAST_GROUP = 200


def _count(runs: re.Pattern, text: str) -> int:
    """How many characters lie in matches; runs are quicker to find than characters."""
    return sum(map(len, runs.findall(text)))


def _letters(text: str) -> int:
    """How many letters: those of ASCII by bytes, others by runs."""
    n = len(text.encode("ascii", "ignore").translate(None, NO_LETTERS))
    return n if text.isascii() else n + _count(LETTER, "".join(NOT_ASCII.findall(text)))


def _garbled(line: str) -> bool:
    """Probably decoded wrongly: many letters that belong to no sound text."""
    odd = len(ODD.findall(line)) - len(SOUND.findall(line))
    if odd * 8 > len(line) or len(SOUP.findall(line)) * 16 > len(line):
        return True
    han = "".join(HAN.findall(line))
    if len(han) > 5:
        raw = han.encode("gb2312", "replace")
        rare = raw.count(b"?") + sum(b >= 0xD8 for b in raw[::2] if b > 127)
        if rare * 8 > len(han) and not KANA.search(line):
            return True
        for page in ("gb18030", "big5", "cp932"):  # the bytes are those of UTF-8
            once = ASCII.sub("", line).encode(page, "ignore").decode("utf-8", "replace")
            if once.count("\ufffd") * 6 < len(once) and not once.isascii():
                return True
    return False


def unprosaic(line: str) -> bool:
    """The line is a list entry, a table row, a log or version entry, a row of numbers or characters, or words that form no sentence."""
    if ENTRY.match(line) and not HEADING.match(line):
        body = ENTRY.sub("", line, count=1).strip()
        return not (line.lstrip()[0] == ">" and body.endswith(ENDS) and len(body) > 40)
    if RECORD.match(line) or LONG.search(line):
        return True
    if line.count("|") >= 2 or "\t" in line.strip():
        return True
    ascii_only = line.isascii()
    letters = _letters(line)
    if letters * 2 < len(line) - line.count(" "):
        return not _garbled(line)
    wide = 0 if ascii_only else _count(WIDE, line)
    if wide * 3 > letters:
        if _count(KANA, line) * 5 > wide:
            return False
        hits = sum(map(line.count, COMMON_IDEOGRAPHS))
        stops = len(STOP.findall(line))
        if HEADING.match(line) or hits * 25 >= wide and (stops * 60 >= wide or wide < 40 and not APART.search(line)):
            return False
        return wide > 3 and not _garbled(line)
    words = line.lower().split()
    if not words:
        return False
    hits = sum(map(COMMON.__contains__, words))
    if hits * 8 >= len(words) and not (hits * 5 < len(words) and len(GAPS.findall(line)) * 6 > len(words)):
        return False
    if len(words) < 3 and not FIELD.search(line) and not GAPS.search(line):
        return len(line) > 40 and not _garbled(line)
    return not _garbled(line)


def _statistics(text: str) -> tuple:
    """The script; words, mean word length, shares of symbols, of lines ending in punctuation, of common words, of words that break off, sentence ends a word; then the share of unprosaic text."""
    words = text.split()
    wide = 0 if text.isascii() else _count(WIDE, text)
    size = max(1, sum(map(len, words)))
    hits = sum(map(COMMON.__contains__, text.lower().split())) + (sum(map(text.count, COMMON_IDEOGRAPHS)) + _count(KANA, text) * 0.4 if wide else 0)
    letters = _letters(text)
    lines = [x for x in text.split("\n") if x.strip()]
    content, bad, code, ended = 0, 0, False, 0
    for line in lines:
        ended += line.rstrip().endswith(ENDS)
        if line.startswith("```"):
            code = not code
            continue
        n = len(line.strip())
        content += n
        if not code and unprosaic(line):
            bad += n
    units = max(1.0, len(words) + wide * 0.6)  # about five thirds of an ideograph make a word
    ranked = (units, size / units, (size - letters) / size, ended / max(1, len(lines)), hits / units, len(GAPS.findall(text)) / units, len(SENTENCE_END.findall(text)) / units)
    return ("wide" if wide * 3 > letters else "narrow", *ranked, bad / max(1, content))


def _rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        rows = [(i, lang, *_statistics(t or "")) for i, lang, t in zip(df["id"], df["lang"], df["text"], strict=True)]
        yield pd.DataFrame(rows, columns=STAT_ROW.names)


def base_language(lang: Column) -> Column:
    """The part of a label before "-" or "_" in lower case; "und" if there is none."""
    code = F.lower(F.regexp_extract(F.trim(lang), "^([A-Za-z]+)", 1))
    return F.when(lang.isNull() | (code == ""), "und").otherwise(code)


def statistics(docs: DataFrame) -> DataFrame:
    """(id, lang, script, the statistics, unprosaic) of docs(id, lang, text); a null text counts as an empty one: one word, all symbol, the other shares 0.

    Rows without id have no statistics.
    """
    return docs.select("id", base_language(F.col("lang")).alias("lang"), "text").where("id is not null").mapInPandas(_rows, STAT_ROW)


def with_group(stats: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """stats with the column group, in which a text is ranked: its label, or its script.

    A label counts if at least least texts of the script have it and most of its texts are of the script: texts with rare, wrong or no
    labels are held against all texts of their script, so that no small group hides them.
    """
    many = stats.groupBy("lang", "script").agg(F.count("*").alias("_n"))
    of_label = many.groupBy("lang").agg(F.sum("_n").alias("_all"))
    good = many.join(of_label, "lang").where((F.col("_n") >= least) & (F.col("_n") * 2 > F.col("_all")) & (F.col("lang") != "und")).select("lang", "script", F.col("lang").alias("_own"))
    return stats.join(good, ["lang", "script"], "left").withColumn("group", F.coalesce("_own", "script")).drop("_own")


def outlier_scores(stats: DataFrame) -> DataFrame:
    """(id, group, score): the sum over the statistics of -log of the tail probability in the text's group, column group of stats.

    The tails are exact empirical distributions by group: group_cdf's ranks by range-partitioned sorting with partition
    offsets. The tail is the one that tells junk from prose; where either may, it is twice the smaller one. A tail holds at least
    the text itself; ties share their tail. A repeated id has one row, the mean of its rows' scores.
    """
    each = [F.struct(F.lit(s).alias("stat"), F.lit(side).alias("side"), F.col(s).alias("value")) for s, side in STATS.items()]
    long = stats.select("id", "group", F.explode(F.array(*each)).alias("x")).select("id", "group", "x.stat", "x.side", "x.value")
    cdf = group_cdf(long, ["stat", "group"], "value")
    low, high = F.col("upto") / F.col("size"), (F.col("size") - F.col("below")) / F.col("size")
    tail = F.when(F.col("side") < 0, low).when(F.col("side") > 0, high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    joined = long.join(cdf, ["stat", "group", "value"])
    return joined.groupBy("id", "group").agg((F.sum(-F.log(tail)) / (F.count("*") / len(STATS))).alias("score"))


def outliers(stats: DataFrame, *, quantile: float = 0.5) -> DataFrame:
    """(id, score) of the texts whose score is greater than that of the given share of their group: the cut follows from the group's own scores."""
    scores = cut(outlier_scores(cut(with_group(stats))))
    cdf = group_cdf(scores, ["group"], "score").where(F.col("below") >= F.col("size") * quantile).select("group", "score")
    return scores.join(cdf, ["group", "score"], "left_semi").select("id", "score")


def not_prose(docs: DataFrame, *, quantile: float = 0.5, most: float = 0.5) -> DataFrame:
    """(id, score, unprosaic): texts that stand out by their statistics and more than most of which is no prose, line by line.

    The scores choose the texts; the line check, which isn't among the statistics, then confirms them. Empty and null
    texts are never among them. Repeated rows come out as often.
    """
    stats = cut(statistics(docs))
    return stats.where(F.col("unprosaic") > most).select("id", "unprosaic").join(outliers(stats, quantile=quantile), "id").select("id", "score", "unprosaic")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent").select("id", "lang", "text", "doc_version")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Raw pages count in the distributions of their language but aren't cases."""
    docs = _parents(spark, d)
    raw = docs.where("doc_version = 'raw'").select("id")
    return not_prose(docs).select("id").join(raw, "id", "left_anti")


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = cut(statistics(_parents(spark, d)))
    return stats.join(outlier_scores(with_group(stats)).drop("group"), "id")


QUERIES = {"p1_found": p1_found, "p1_statistics": p1_statistics}
SQL: dict[str, str] = {}
