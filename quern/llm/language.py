"""Problem 6: the language of each text and of each paragraph, by interpolated Kneser-Ney character models."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.quality import base_language
from quern.session import cut, read

ORDER, BITS = 3, 21
DISCOUNT = 0.75
NARROW = 160  # characters with a direct table
#: Bounds of the training sample: texts of each label, taken by hash; the models' size follows from them.
TEXTS_PER_LANGUAGE = 400
FENCE = "```"
PARAGRAPH = re.compile(r"\n[ \t\r　]*(?:\n[ \t\r　]*)+")
TWO_LETTERS = re.compile(r"[^\W\d_].*?[^\W\d_]", re.S)
_FOLD = np.arange(0x110000, dtype=np.uint32)
_FOLD[ord("0") : ord("9") + 1] = ord("0")

SEGMENT = T.StructType(
    [T.StructField("id", T.LongType()), T.StructField("para_no", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("chars", T.IntegerType()), T.StructField("main", T.StringType()), T.StructField("margin", T.DoubleType())]
)


def paragraphs(text: str) -> list[tuple[int, str, bool]]:
    """(number, text, code) of a text split at blank lines, numbered from 1; a fence opened in one paragraph holds until it is closed."""
    out, inside = [], False
    for no, p in enumerate(PARAGRAPH.split(text.strip("\n")), 1):
        fences = sum(line.lstrip().startswith(FENCE) for line in p.split("\n"))
        out.append((no, p, inside or p.lstrip().startswith(FENCE)))
        inside ^= fences % 2 == 1
    return out


def _codes(text: str) -> np.ndarray:
    """Characters in lower case, digits alike, runs of other signs kept; a boundary before and after."""
    return _FOLD[np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), dtype=np.uint32)]


def _packed(c: np.ndarray) -> np.ndarray:
    """Three characters in one number: an exact hash."""
    c = c.astype(np.uint64)
    return (c[:-2] << np.uint64(2 * BITS)) | (c[1:-1] << np.uint64(BITS)) | c[2:]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for df in batches:
        for lang, some in df.groupby("lang"):
            grams = [_packed(_codes(p)) for t in some["text"] for _, p, code in paragraphs(t) if not code and p]
            if grams:
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": g.view(np.int64), "n": n.astype(np.int64)})


class Models:
    """log P(c | a, b) of every language, in sorted arrays of hashed windows."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        self.tables = []
        mask = np.uint64((1 << (2 * BITS)) - 1)
        low = np.uint64((1 << BITS) - 1)
        three, two, one = (np.unique(x) for x in self._keys(counts, mask, low))
        k = len(self.langs)
        self.keys = [three, two, one]
        self.values = [np.zeros((len(x), k), dtype=np.float32) for x in self.keys]
        contexts2, contexts1 = np.unique(three >> np.uint64(BITS)), np.unique(two >> np.uint64(BITS))
        self.contexts = [contexts2, contexts1]
        self.back = [np.zeros((len(contexts2), k), dtype=np.float32), np.zeros((len(contexts1), k), dtype=np.float32)]
        for j, lang in enumerate(self.langs):
            mine = counts[counts["lang"] == lang]
            g, n = mine["gram"].to_numpy(np.int64).view(np.uint64), mine["n"].to_numpy(np.float64)
            self._fit(j, g, n, mask, low)

    @staticmethod
    def _keys(counts: pd.DataFrame, mask: np.uint64, low: np.uint64) -> list[np.ndarray]:
        g = counts["gram"].to_numpy(np.int64).view(np.uint64)
        return [g, g & mask, g & low]

    def _fit(self, j: int, g: np.ndarray, n: np.ndarray, mask: np.uint64, low: np.uint64) -> None:
        """Interpolated Kneser-Ney: the highest order by counts, the lower ones by the number of different predecessors."""
        three, two, one = self.keys
        shift = np.uint64(BITS)
        # order 1: in how many different pairs a character comes second
        pairs = np.unique(g & mask)
        follow = np.bincount(np.searchsorted(one, pairs & low), minlength=len(one)).astype(np.float64)
        p1 = (np.maximum(follow - DISCOUNT, 0) + DISCOUNT * (follow > 0).sum() / (len(one) + 20000)) / max(1, follow.sum())
        p1 = np.maximum(p1, DISCOUNT * (follow > 0).sum() / (len(one) + 20000) / max(1, follow.sum()))
        # order 2: different predecessors of each pair
        before = np.bincount(np.searchsorted(two, g & mask), minlength=len(two)).astype(np.float64)
        c1 = np.searchsorted(self.contexts[1], two >> shift)
        total = np.bincount(c1, weights=before, minlength=len(self.contexts[1]))
        kinds = np.bincount(c1, weights=before > 0, minlength=len(self.contexts[1]))
        lam1 = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p2 = np.maximum(before - DISCOUNT, 0) / np.maximum(total[c1], 1) + lam1[c1] * p1[np.searchsorted(one, two & low)]
        # order 3
        count = np.zeros(len(three))
        count[np.searchsorted(three, g)] = n
        c2 = np.searchsorted(self.contexts[0], three >> shift)
        total = np.bincount(c2, weights=count, minlength=len(self.contexts[0]))
        kinds = np.bincount(c2, weights=count > 0, minlength=len(self.contexts[0]))
        lam2 = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        p3 = np.maximum(count - DISCOUNT, 0) / np.maximum(total[c2], 1) + lam2[c2] * p2[np.searchsorted(two, three & mask)]
        for values, p in zip(self.values, (p3, p2, p1), strict=True):
            values[:, j] = np.log(np.maximum(p, 1e-12))
        self.back[0][:, j], self.back[1][:, j] = np.log(np.maximum(lam2, 1e-9)), np.log(np.maximum(lam1, 1e-9))
        self.floor = -14.0

    def index(self) -> None:
        """A direct table from windows of the most frequent narrow characters to places in the sorted array: most text needs no search."""
        narrow = self.keys[2][self.keys[2] < 0x250][: NARROW - 1].astype(np.int64)
        self.small = np.zeros(0x110000, dtype=np.uint32)
        self.small[narrow] = np.arange(1, len(narrow) + 1)
        self.direct = np.full(NARROW**3, -1, dtype=np.int32)
        low = np.uint64((1 << BITS) - 1)
        parts = [self.small[((self.keys[0] >> np.uint64(k * BITS)) & low).astype(np.int64)].astype(np.int64) for k in (2, 1, 0)]
        inside = (parts[0] > 0) & (parts[1] > 0) & (parts[2] > 0)
        cell = (parts[0] * NARROW + parts[1]) * NARROW + parts[2]
        self.direct[cell[inside]] = np.nonzero(inside)[0]

    def calibrate(self, texts: list[tuple[str, str]], *, spread: float = 8.0) -> None:
        """A bound for the cross-entropy of each language from paragraphs that the models were not trained on: what is above it is rejected.

        Shorter paragraphs vary more: the bound for n characters is mean + spread * deviation * sqrt(1 + 100 / n).
        """
        long = [(lang, p) for lang, p in texts if len(p) >= 30 and lang in self.langs]
        ce: dict[str, list[float]] = {lang: [] for lang in self.langs}
        if long:
            for (lang, _), row in zip(long, self.scores([p for _, p in long]), strict=True):
                ce[lang].append(-float(row[self.langs.index(lang)]))
        self.limit = np.array([[np.median(v), spread * max(0.05, 1.4826 * np.median(np.abs(np.array(v) - np.median(v))))] if len(v) >= 5 else [6.0, 0.5] for v in (ce[x] for x in self.langs)])

    def _find(self, table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        return at, table[at] == keys

    def _places(self, codes: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each window stands in the sorted array, and whether it does."""
        s = self.small[codes]
        cell = (s[:-2] * np.uint32(NARROW) + s[1:-1]) * np.uint32(NARROW) + s[2:]
        at = self.direct[cell]
        other = np.nonzero((s[:-2] == 0) | (s[1:-1] == 0) | (s[2:] == 0))[0]
        if len(other):
            found, seen = self._find(self.keys[0], grams[other])
            at[other] = np.where(seen, found, -1)
        return at, at >= 0

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """log P of each window's last character, for all languages; unseen windows back off."""
        grams = _packed(codes)
        at, seen = self._places(codes, grams)
        out = self.values[0][at]
        miss = np.nonzero(~seen)[0]
        if len(miss):
            shift, mask, low = np.uint64(BITS), np.uint64((1 << (2 * BITS)) - 1), np.uint64((1 << BITS) - 1)
            g = grams[miss]
            at, seen = self._find(self.contexts[0], g >> shift)
            log = np.where(seen[:, None], self.back[0][at], 0.0)
            at, seen = self._find(self.keys[1], g & mask)
            log2 = self.values[1][at]
            rare = np.nonzero(~seen)[0]
            if len(rare):
                h = g[rare] & mask
                at, seen = self._find(self.contexts[1], h >> shift)
                back = np.where(seen[:, None], self.back[1][at], 0.0)
                at, seen = self._find(self.keys[2], h & low)
                log2[rare] = back + np.where(seen[:, None], self.values[2][at], self.floor)
            out[miss] = np.maximum(log + log2, self.floor)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Mean log-likelihood of each text under each language."""
        if not hasattr(self, "direct"):
            self.index()
        out, start, size = [], 0, 0
        for k, t in enumerate(texts):  # pieces that fit the processor's cache
            size += len(t)
            if size > 100_000 or k == len(texts) - 1:
                out.append(self._piece(texts[start : k + 1]))
                start, size = k + 1, 0
        return np.concatenate(out)

    def _piece(self, texts: list[str]) -> np.ndarray:
        codes = [_codes(t) for t in texts]
        ends = np.cumsum([len(c) for c in codes])
        starts = np.concatenate([[0], ends[:-1]])
        logs = self.logs(np.concatenate(codes))
        # windows over the boundary of two texts belong to none
        both = np.stack([starts, ends - 2], axis=1).ravel()
        sums = np.add.reduceat(np.concatenate([logs, np.zeros((2, logs.shape[1]), dtype=logs.dtype)]), both, axis=0)[::2]
        return sums / (ends - starts - 2)[:, None]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("direct", "small")}

    def classify(self, texts: list[str], scores: np.ndarray | None = None) -> list[tuple[str, float]]:
        """(language, confidence) of each text, none of them empty; "und" if no model or no single one fits.

        The confidence is the languages' posterior with an independent piece of evidence every four characters.
        """
        s = self.scores(texts) if scores is None else scores
        n = np.array([len(t) for t in texts])[:, None]
        z = (s - s.max(axis=1, keepdims=True)) * np.minimum(n / 4.0, 50.0)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        best = s.argmax(axis=1)
        conf = p[np.arange(len(best)), best]
        bound = self.limit[best]
        good = -s[np.arange(len(best)), best] <= bound[:, 0] + bound[:, 1] * np.sqrt(1 + 100 / n[:, 0])
        return [(self.langs[b] if ok else "und", float(c) if ok else 0.0) for b, c, ok in zip(best, conf, good, strict=True)]


def sample(docs: DataFrame, per_language: int = TEXTS_PER_LANGUAGE) -> DataFrame:
    """(lang, text): at most per_language texts of each label, those of least hash."""
    place = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    labelled = docs.select("id", base_language(F.col("lang")).alias("lang"), "text").where("lang <> 'und' and text is not null")
    return labelled.withColumn("place", F.row_number().over(place)).where(F.col("place") <= per_language).select("lang", "text")


def _is_wide(text: str) -> bool:
    """Much of the text is ideographs or kana."""
    return 3 * sum("\u3040" <= c <= "\u9fff" for c in text) > len(text)


def _fitted(rows: list[tuple[str, str]], held_out: list[tuple[str, str]] | None = None) -> Models:
    """Models of the rows; the bounds for rejection come from held_out, or else from models of either half of the rows on the other."""
    models = Models(pd.concat(list(_count(iter([pd.DataFrame(rows, columns=["lang", "text"])])))))
    if held_out is None and min(Counter(lang for lang, _ in rows).values()) >= 10:
        models.limit = _fitted(rows[0::2], rows[1::2]).limit
    else:
        models.calibrate(held_out or rows)
    return models


def _told(models: Models, rows: list[tuple[str, str]], least: float) -> list[tuple[str, str]]:
    """The texts with the language that the models give them, if sure, whatever their label was: a wrong label costs no text."""
    said = [x for k in range(0, len(rows), 1000) for x in models.classify([t for _, t in rows[k : k + 1000]])]
    return [(lang, t) for (lang, c), (_, t) in zip(said, rows, strict=True) if lang != "und" and c >= least]


def train(docs: DataFrame, *, per_language: int = TEXTS_PER_LANGUAGE) -> Models | None:
    """Models of the languages that label at least one text, trained on a bounded sample of labelled texts; None if no labelled text has 40 characters."""
    return models_of(sorted((x["lang"], x["text"]) for x in sample(docs, per_language).toLocalIterator()))


def models_of(texts: list[tuple[str, str]]) -> Models | None:
    """Models of labelled texts (language, text), though labels may be wrong and texts mixed.

    Texts in another script than most texts of their label are left out. Then each half of the texts is told by models of
    the other half: a model that saw a wrongly labelled text would take it for its own. The paragraphs of texts so
    told are told in the same way, and the final models are trained on those that have their text's language.
    """
    whole = [(lang, body) for lang, t in texts if len(body := "\n\n".join(p for _, p, code in paragraphs(t) if not code)) >= 40]
    if not whole:
        return None
    whole = _of_usual_script(whole)
    told = _told_across(whole, whole, 0.9)
    pieces = _of_usual_script([(lang, p) for lang, t in told for _, p, _ in paragraphs(t) if len(p) >= 3])
    kept = set(_told_across(pieces, told, 0.0))
    return _fitted([x for x in pieces if x in kept] or told)


def _of_usual_script(rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Without the texts that are in another script than most of their language's."""
    votes = Counter((lang, _is_wide(t)) for lang, t in rows)
    return [(lang, t) for lang, t in rows if votes[lang, _is_wide(t)] >= votes[lang, not _is_wide(t)]]


def _told_across(rows: list[tuple[str, str]], train_on: list[tuple[str, str]], least: float) -> list[tuple[str, str]]:
    """The rows with the language that models of the other half of train_on give them: every second text by the models of the others.

    Where a half lacks a language, the rows stay as they are. A row of train_on is in the half that its text has in it.
    """
    place = {t: k % 2 for k, (_, t) in enumerate(train_on)}
    halves = [train_on[0::2], train_on[1::2]]
    if any({x for x, _ in h} != {x for x, _ in train_on} for h in halves):
        return rows
    of_text = {p: place[t] for t in place for _, p, _ in paragraphs(t)} | place
    out = []
    for k in (0, 1):
        out += _told(_fitted(halves[1 - k], halves[k]), [x for x in rows if of_text.get(x[1], 0) == k], least)
    return out


def _majority(langs: list[str], confidences: list[float], sizes: list[int]) -> str:
    """The language of most paragraphs, sure ones if there are any; in ties that of more characters, then the first by name."""
    sure = [k for k, c in enumerate(confidences) if c >= 0.8 and langs[k] != "und"] or [k for k, x in enumerate(langs) if x != "und"]
    votes: dict[str, list] = {}
    for k in sure:
        v = votes.setdefault(langs[k], [0, 0])
        v[0] += 1
        v[1] += sizes[k]
    return max(sorted(votes), key=lambda x: votes[x]) if votes else "und"


def _segments(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models: Models = shared.value
        for df in batches:
            keys, texts, spans = [], [], []
            for i, t in zip(df["id"], df["text"], strict=True):
                start = len(texts)
                for no, p, code in paragraphs(t or ""):
                    if not code and TWO_LETTERS.search(p):
                        keys.append((i, no))
                        texts.append(p)
                spans.append((start, len(texts)))
            if not texts:
                continue
            scores = models.scores(texts)
            said = models.classify(texts, scores)
            rows = []
            for start, end in spans:
                some = said[start:end]
                main = _majority([x for x, _ in some], [c for _, c in some], [len(t) for t in texts[start:end]])
                at = models.langs.index(main) if main != "und" else None
                for k in range(start, end):
                    lang, conf = said[k]
                    margin = float(scores[k].max() - scores[k, at]) if at is not None else 0.0
                    rows.append((*keys[k], lang, conf, len(texts[k]), main, margin))
            yield pd.DataFrame(rows, columns=SEGMENT.names).astype({"id": "int64", "para_no": "int32", "chars": "int32"})

    return run


def segment_languages(docs: DataFrame, models: Models | None) -> DataFrame:
    """(id, para_no, lang, confidence, chars, main, margin): a row for each paragraph that has letters and is no code.

    lang is "und" where the models reject; main is the language of most of the text's paragraphs; margin is by how
    much a character is likelier, in nats, in lang than in main. Without models, and for rows without id, there are no rows;
    repeated rows have theirs as often.
    """
    if models is None:
        return docs.sparkSession.createDataFrame([], SEGMENT)
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return docs.select("id", "text").where("id is not null").mapInPandas(_segments(shared), SEGMENT)


def document_languages(segments: DataFrame) -> DataFrame:
    """(id, lang, confidence): the language of most paragraphs, with those paragraphs' mean confidence."""
    return segments.where("main <> 'und'").groupBy("id", F.col("main").alias("lang")).agg(F.avg(F.when(F.col("lang") == F.col("main"), F.col("confidence"))).alias("confidence"))


def language_errors(docs: DataFrame, models: Models | None, *, least: float = 0.9, least_evidence: float = 14.0, least_margin: float = 0.3) -> DataFrame:
    """(id, para_no, lang, confidence) of docs(id, lang, text).

    para_no 0: the label is missing or names another language than most paragraphs have; lang is the right one. para_no k:
    paragraph k is in another language than most: the whole paragraph is likelier in it by least_evidence nats, and a character by
    least_margin, so that a short heading in another script counts, and a name in a long paragraph doesn't. Null
    and empty texts, and texts of no model's language, give no rows.
    """
    segments = cut(segment_languages(docs, models))
    labels = docs.select("id", base_language(F.col("lang")).alias("label"))
    wrong = document_languages(segments).join(labels, "id").where("label <> lang").select("id", F.lit(0).alias("para_no"), "lang", "confidence")
    sure = (F.col("confidence") >= least) & (F.col("margin") >= least_margin) & (F.col("margin") * F.col("chars") >= least_evidence)
    other = segments.where((F.col("lang") != F.col("main")) & (F.col("lang") != "und") & (F.col("main") != "und") & sure)
    return wrong.unionByName(other.select("id", "para_no", "lang", "confidence"))


def _parents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "chunks").where("is_parent and not doc_version <=> 'raw'").select("id", "lang", "text")


def _errors(spark: SparkSession, d: str) -> DataFrame:
    docs = _parents(spark, d)
    return language_errors(docs, train(docs))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The cases in texts that are prose and decoded rightly; of the others, only those with cases are looked for."""
    from quern.llm.encoding import wrongly_decoded
    from quern.llm.quality import p1_found

    errors = cut(_errors(spark, d))
    skipped = p1_found(spark, d).unionByName(wrongly_decoded(spark, d, errors.select("id").distinct()))
    return errors.join(skipped, "id", "left_anti").select("id", "para_no", "lang")


def p6_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every parent that isn't raw, with its language and confidence."""
    docs = _parents(spark, d)
    return document_languages(cut(segment_languages(docs, train(docs))))


def p6_errors(spark: SparkSession, d: str) -> DataFrame:
    """The cases with their confidence, in texts of all kinds."""
    return _errors(spark, d)


QUERIES = {"p6_found": p6_found, "p6_languages": p6_languages, "p6_errors": p6_errors}
SQL: dict[str, str] = {}
