"""Reading level of each document (problem 8).

Method: a linear pairwise ranker is learned from pairs of graded texts on features of syntax and vocabulary, and its
scores are calibrated into levels with isotonic regression. Vocabulary features are the shares of words (hashed into
``BUCKETS``), so that words of which only the graded texts tell the level count; syntax features are rates by sentence
and word, standardised.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pairs, plaintext

#: Levels from the lowest to the highest.
BANDS = ("easy", "middle", "hard")
#: Documents with fewer words have no level.
LEAST_WORDS = 40
#: Graded texts that a model is fitted on at most, chosen by the hash of their text; a documented bound, far above the table's 180.
MOST_SAMPLES = 5000
BUCKETS = 1 << 12
#: Weight of the penalty on the ranker's weights.
PENALTY = 1e-3

#: Words of clauses, and endings of learned words.
SUBORDINATORS = frozenset("although because since unless until whereas while whether though if when where which who whom whose that once before after so".split())
PERSONAL = frozenset("i you he she we they me him her us them my your his our their it its".split())
CONNECTORS = frozenset("hence thus thereby consequently notwithstanding insofar therein herein thereof moreover furthermore nevertheless whereby wherein conditional provided save given".split())
LEARNED = re.compile(r"(?:tion|sion|ment|ity|ism|ous|ical|ogy|ance|ence|ised|ized|ising|izing|ation|metric|graphic|logical|eous|ary|ive|al)s?$")

_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n+")
_LOG_START = re.compile(r"^\W*(?:f|fr|frame|img|ts|t|id|no)?\W*\d+\s*[;,|:\t]|^\W*(?:\d{4}-\d\d-\d\d|\d\d:\d\d)", re.I)
_WORDS, _BEYOND_ASCII, _WORD_CHARACTER = re.compile(r"[a-z]+"), re.compile(r"[^\x00-\x7f]"), re.compile(r"\w")
_TOKEN = re.compile(r"[a-z]+(?:['’-][a-z]+)*|\d+(?:[.,]\d+)*")


def _sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if _WORD_CHARACTER.search(s)]


def clean(text: str | None) -> str:
    """Lower case, without markup and broken encoding; line breaks stay."""
    return "\n".join(" ".join(line.split()) for line in plaintext.folded(text or "").replace("\r\n", "\n").replace("\r", "\n").split("\n"))


def is_log_line(line: str, words: int) -> bool:
    """Starts like an entry of a log, or is a few words between separators."""
    return bool(_LOG_START.search(line)) or (words <= 12 and sum(map(line.count, ";|\t")) >= 2)


class Vocabulary:
    """What each word contributes, looked up once: length, bucket and kinds. Forgotten when there are too many words."""

    KINDS = ("alpha", "subordinator", "personal", "connector", "learned", "digit")

    def __init__(self, most: int = 1 << 18):
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.lengths, self.buckets, self.kinds = [], [], []
        self.table = None

    def _add(self, token: str) -> int:
        alpha = token[0].isalpha()
        self.lengths.append(len(token))
        self.buckets.append(xxhash.xxh32_intdigest(token if alpha else "9") % BUCKETS)
        self.kinds.append((alpha, token in SUBORDINATORS, token in PERSONAL, token in CONNECTORS, bool(LEARNED.search(token)), token[0].isdigit()))
        self.table = None
        return self.codes.setdefault(token, len(self.codes))

    def look(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lengths, buckets, kinds as rows of 0 and 1) of the tokens."""
        if len(self.codes) > self.most:
            self.forget()
        codes = self.codes
        at = [codes[t] if t in codes else self._add(t) for t in tokens]
        if self.table is None:
            self.table = np.array(self.lengths), np.array(self.buckets), np.array(self.kinds, np.int64).reshape(-1, len(self.KINDS))
        at = np.array(at, np.int64)
        return tuple(column[at] for column in self.table)


_VOCABULARY = Vocabulary()


def _letters(text: str) -> tuple[int, int]:
    """(letters, those from a to z) of a text in lower case."""
    codes = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    latin = int(((codes >= 97) & (codes <= 122)).sum())
    return latin + (0 if text.isascii() else sum(map(str.isalpha, _BEYOND_ASCII.findall(text)))), latin


def is_prose(plain: str) -> bool:
    """Mainly English running prose of ``LEAST_WORDS`` words or more: neither a log nor a stub nor another language."""
    lines = [line for line in plain.split("\n") if line.strip()]
    tokens = [_TOKEN.findall(line) for line in lines]
    logs = [is_log_line(line, len(found)) for line, found in zip(lines, tokens)]
    in_prose = sum(len(found) for found, log in zip(tokens, logs) if not log)
    if in_prose < LEAST_WORDS or in_prose * 2 < sum(map(len, tokens)):
        return False
    text = "\n".join(line for line, log in zip(lines, logs) if not log)
    letters, latin = _letters(text)
    if letters * 10 < 6 * (len(text) - text.count(" ") - text.count("\n")) or latin * 2 < letters:
        return False
    counts = {name: 0 for name in pairs.FUNCTION_WORDS}
    for word in _WORDS.findall(text):
        if found := _LANGUAGE.get(word):
            counts[found] += 1
    if sum(counts.values()) < 2:  # terse style without function words
        return sum(bool(LEARNED.search(t)) for found, log in zip(tokens, logs) if not log for t in found) * 8 >= in_prose
    return counts["en"] * 2 >= sum(counts.values())


#: Function words without accents, as texts are folded.
_LANGUAGE = {plaintext.folded(word): name for name, words in reversed(pairs.FUNCTION_WORDS.items()) for word in words.split()}


def features(plain: str) -> tuple[np.ndarray, np.ndarray]:
    """(syntax features, bucket shares) of a cleaned text."""
    sentences = [_TOKEN.findall(s) for s in _sentences(plain)]
    sentences = [s for s in sentences if s]
    tokens = [t for s in sentences for t in s]
    n, m = max(len(tokens), 1), max(len(sentences), 1)
    sizes = sorted(len(s) for s in sentences) or [0]
    mean = sum(sizes) / len(sizes)
    spread = (sum((x - mean) ** 2 for x in sizes) / len(sizes)) ** 0.5
    at, part = divmod(0.9 * (len(sizes) - 1), 1)
    long = sizes[int(at)] + part * (sizes[min(int(at) + 1, len(sizes) - 1)] - sizes[int(at)])
    lengths, buckets, kinds = _VOCABULARY.look(tokens)
    alpha, subordinate, personal, connecting, learned, digits = kinds.sum(0).tolist() if len(tokens) else [0] * 6
    letters = lengths[kinds[:, 0] > 0] if alpha else np.zeros(1)
    syntax = np.array([
        np.log1p(mean), spread / (mean + 1), np.log1p(long), plain.count(",") / m, (plain.count(";") + plain.count(":")) / m, plain.count("(") / m,
        plain.count("?") / m, plain.count("!") / m, subordinate / n, personal / n, connecting / n, letters.mean(), (letters >= 7).mean(), (letters >= 11).mean(), (letters <= 3).mean(),
        learned / n, digits / n, len(set(tokens)) / n**0.5,
    ])
    return syntax, np.sqrt(np.bincount(buckets, minlength=BUCKETS) / n)


@dataclass
class LevelModel:
    center: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    grades: np.ndarray

    def vector(self, plain: str) -> np.ndarray:
        syntax, shares = features(plain)
        return np.concatenate([np.clip((syntax - self.center) / self.spread, -4, 4) / len(syntax) ** 0.5, shares])

    def score(self, plain: str) -> float:
        return float(self.vector(plain) @ self.weights)

    def grade(self, score: float) -> float:
        return float(np.interp(score, self.knots, self.grades))

    def band(self, score: float) -> str:
        return BANDS[int(np.searchsorted(self.cuts, score, "right"))]

    @cached_property
    def cuts(self) -> np.ndarray:
        """The scores between the levels: midway between the last knot below and the first above the grade between two levels."""
        cuts = []
        for grade in np.arange(len(BANDS) - 1) + 0.5:
            below, above = self.knots[self.grades < grade], self.knots[self.grades > grade]
            cuts.append((below[-1] + above[0]) / 2 if len(below) and len(above) else -np.inf if len(above) else np.inf)
        return np.array(cuts)


def isotonic(scores: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(knots, values) of the non-decreasing step function nearest to the grades, by pooling adjacent violators."""
    order = np.argsort(scores, kind="stable")
    blocks: list[list[float]] = []
    for s, g in zip(scores[order], grades[order]):
        blocks.append([g, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            value, weight, low, high = blocks.pop()
            last = blocks[-1]
            blocks[-1] = [(last[0] * last[1] + value * weight) / (last[1] + weight), last[1] + weight, last[2], high]
    knots = np.array([x for b in blocks for x in (b[2], b[3])])
    return knots, np.array([x for b in blocks for x in (b[0], b[0])])


def rank_weights(x: np.ndarray, grades: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights under which the text of the higher grade of each pair scores higher (logistic loss, L2 penalty, accelerated descent)."""
    high, low = np.nonzero(grades[:, None] > grades[None, :])
    if not len(high):
        return np.zeros(x.shape[1])
    importance = (grades[high] - grades[low]) / (grades[high] - grades[low]).sum()
    gram = x @ x.T  # the weights are a combination of the texts
    alpha, ahead = np.zeros(len(x)), np.zeros(len(x))
    rate = 1.0 / (0.5 * np.abs(gram).max() * 2 + PENALTY)
    for step in range(1, steps + 1):
        scores = gram @ ahead
        pull = importance / (1 + np.exp(np.clip(scores[high] - scores[low], -50, 50)))
        slope = np.bincount(high, pull, len(x)) - np.bincount(low, pull, len(x)) - PENALTY * ahead
        moved = ahead + rate * slope
        ahead = moved + (step - 1) / (step + 2) * (moved - alpha)
        alpha = moved
    return x.T @ alpha


def fit(texts: list[str], grades: list[float]) -> LevelModel:
    """A model of graded texts (grades from 0, the easiest); without any all texts get the lowest level's grade."""
    cleaned = [clean(t) for t in texts]
    if not cleaned:
        size = len(features("")[0])
        return LevelModel(np.zeros(size), np.ones(size), np.zeros(size + BUCKETS), np.zeros(1), np.zeros(1))
    y = np.array(grades)
    syntax = np.array([features(t)[0] for t in cleaned])
    model = LevelModel(syntax.mean(0), syntax.std(0) + 1e-6, np.zeros(0), np.zeros(1), np.zeros(1))
    x = np.array([model.vector(t) for t in cleaned])
    model.weights = rank_weights(x, y)
    # calibrated on scores that each text gets from a ranker that has not seen it
    held, folds = np.zeros(len(y)), np.arange(len(y)) % 10
    for fold in range(10):
        seen = folds != fold
        held[~seen] = x[~seen] @ (rank_weights(x[seen], y[seen]) if seen.any() else model.weights)
    model.knots, model.grades = isotonic(held, y)
    return model


def fit_samples(samples: DataFrame) -> LevelModel:
    """A model of a table (text, band_a, band_b); a text's grade is the mean of its known bands. Texts without either are left out."""
    known = samples.where(F.col("text").isNotNull()).select("text", "band_a", "band_b").orderBy(F.xxhash64("text"), "text", "band_a", "band_b").limit(MOST_SAMPLES).collect()
    graded = [(r["text"], [BANDS.index(b) for b in (r["band_a"], r["band_b"]) if b in BANDS]) for r in known]
    graded = [(text, sum(g) / len(g)) for text, g in graded if g]
    return fit([t for t, _ in graded], [g for _, g in graded])


def reading_levels(documents: DataFrame, samples: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score, grade, band) of each document mainly in English running prose of ``LEAST_WORDS`` words or more.

    The model (some ten thousand numbers) is fitted at the driver and sent to the executors; documents are scored in
    Arrow batches where they lie, without a shuffle. Null, empty and other texts have no row; equal texts get equal
    levels.
    """
    model = documents.sparkSession.sparkContext.broadcast(fit_samples(samples))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            places, scores, seen = [], [], {}
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t not in seen:
                    plain = clean(t)
                    seen[t] = m.score(plain) if is_prose(plain) else None
                if seen[t] is not None:
                    places.append(i)
                    scores.append(seen[t])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(places, pa.int64())), pa.array(scores, pa.float64()), pa.array([m.grade(s) for s in scores], pa.float64()), pa.array([m.band(s) for s in scores], pa.string())],
                names=[doc, "score", "grade", "band"],
            )

    return documents.select(doc, text).mapInArrow(score, f"`{doc}` {documents.schema[doc].dataType.simpleString()}, score double, grade double, band string")


def level_profile(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """Documents and their mean grade by source (in one spelling) and band."""
    from ..functions import names

    sources = documents.select("doc_id", names.slug(F.col("source")).alias("source"))
    return reading_levels(documents, samples).join(sources, "doc_id").groupBy("source", "band").agg(F.count(F.lit(1)).alias("documents"), F.round(F.avg("grade"), 6).alias("mean_grade"))


def found(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, band) of p8_found."""
    return reading_levels(documents, samples).select("doc_id", "band")
