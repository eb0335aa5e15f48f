"""Language identification in two levels: the family first, then pairs of languages within it.

A text becomes a histogram of hashed letter 1-, 2- and 3-grams over its whole length.  One linear
support vector machine for each pair of families votes for the family; within it one for each pair
of languages votes for the language.  All are trained in numpy on the squared hinge loss.

Votes always name one of the learnt languages.  Whether the text is in that language at all is told by the mean
log-probability of its n-grams there, held against the texts that were learnt from.
"""

from __future__ import annotations

import itertools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import held_out, session, texts_of, unit_hash

DIMENSIONS = 1 << 13

#: Families of some ISO 639-1 codes.  A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ca ro gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "baltic": "lt lv",
    "celtic": "ga cy gd br",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
    "indo-aryan": "hi bn mr gu pa ne si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "austronesian": "id ms tl jv",
}


def family_of(lang: str) -> str:
    """The family of a language code (the part before ``-`` or ``_`` counts)."""
    code = lang.lower().replace("_", "-").split("-")[0]
    return next((f for f, codes in FAMILIES.items() if code in codes.split()), f"only:{lang}")


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: the lower-case letter, or 0 for what is not a letter."""
    if not _LETTERS:
        table = np.zeros(sys.maxunicode + 1, np.uint32)
        for i in range(sys.maxunicode + 1):
            c = chr(i)
            if c.isalpha():
                table[i] = ord(c.lower()[0])
        _LETTERS.append(table)
    return _LETTERS[0]


def histograms(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 over the hashed n-grams of each whole text, and whether it has a letter."""
    out, has = np.zeros((len(texts), DIMENSIONS), np.float32), np.zeros(len(texts), bool)
    table = letters()
    for i, text in enumerate(texts):
        total = np.zeros(DIMENSIONS, np.int64)
        for start in range(0, len(text), 1 << 20):  # very long texts in pieces that overlap by two
            piece = text[max(0, start - 2) : start + (1 << 20)]
            c = table[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
            seen = min(start, 2)
            has[i] |= bool(c[seen:].any())
            mark = np.concatenate([c, np.zeros(1, np.uint32)]) if start + (1 << 20) >= len(text) else c
            if start == 0:
                mark, seen = np.concatenate([np.zeros(1, np.uint32), mark]), 1
            one = mark.astype(np.uint64)
            two = one[:-1] * np.uint64(1_000_003) + one[1:]
            three = two[:-1] * np.uint64(1_000_003) + one[2:]
            l = one != 0
            grams = [
                one[seen:][l[seen:]],
                (two * np.uint64(3) + np.uint64(1))[max(seen - 1, 0) :][(l[:-1] | l[1:])[max(seen - 1, 0) :]],
                (three * np.uint64(3) + np.uint64(2))[max(seen - 2, 0) :][l[1:-1][max(seen - 2, 0) :]],
            ]
            for g in grams:
                h = (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)
                total += np.bincount(h.astype(np.int64), minlength=DIMENSIONS)
        row = np.sqrt(total.astype(np.float32))
        norm = float(np.sqrt((row * row).sum()))
        out[i] = row / norm if norm else row
    return out, has


def train_svm(x: np.ndarray, y: np.ndarray, steps: int = 120, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias on the squared hinge loss; ``y`` is 1 or -1 and both sides weigh alike."""
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    pw, pb = w, b
    for t in range(1, steps + 1):  # accelerated gradient; the loss is 2 (|x|^2 + 1)-smooth and |x| is 1
        k = (t - 1) / (t + 2)
        vw, vb = w + k * (w - pw), b + k * (b - pb)
        slack = np.maximum(0, 1 - y * (x @ vw + vb)).astype(np.float32)
        g = -2 * weight * slack * y
        pw, pb = w, b
        w, b = vw - 0.25 * (g @ x + decay * vw), float(vb - 0.25 * g.sum())
    return w, b


@dataclass
class Model:
    """``pairs``: (a, b, weights, bias, slope) of the classifiers that tell group a from group b."""

    families: list[str]
    languages: dict[str, list[str]]
    between: list[tuple[int, int, int]]
    within: dict[str, list[tuple[int, int, int]]]
    weights: np.ndarray
    bias: np.ndarray
    slope: np.ndarray
    names: list[str]
    logs: np.ndarray
    usual: float
    floor: float

    @staticmethod
    def _vote(p: np.ndarray, pairs: list[tuple[int, int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
        """Winner by votes (then by the sum of probabilities) and its mean probability."""
        if n == 1:
            return np.zeros(len(p), np.int64), np.ones(len(p))
        votes, belief = np.zeros((len(p), n)), np.zeros((len(p), n))
        for a, b, k in pairs:
            votes[:, a] += p[:, k] >= 0.5
            votes[:, b] += p[:, k] < 0.5
            belief[:, a] += p[:, k]
            belief[:, b] += 1 - p[:, k]
        belief /= n - 1
        best = (votes + 0.5 * belief / max(n, 1)).argmax(1)
        return best, belief[np.arange(len(p)), best]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score, and how typical of the language the text is: from 0, unlike anything learnt, to 1."""
        x, has = histograms(texts)
        p = 1 / (1 + np.exp(-np.clip(self.slope * (x @ self.weights.T + self.bias), -40, 40)))
        if not self.families:
            return ["und"] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        family, sure = self._vote(p, self.between, len(self.families))
        lang, score = np.empty(len(texts), object), np.zeros(len(texts))
        for i, name in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            if len(rows):
                own = self.languages[name]
                best, belief = self._vote(p[rows], self.within[name], len(own))
                lang[rows], score[rows] = np.array(own, object)[best], sure[rows] * belief
        mean = ((x * x) @ self.logs.T)[np.arange(len(texts)), [self.names.index(v) for v in lang]]
        typical = np.clip((mean - self.floor) / (self.usual - self.floor), 0, 1)
        lang[~has], score[~has], typical[~has] = "und", 0.0, 0.0
        return lang.tolist(), np.clip(score, 0, 1).tolist(), typical.astype(float).tolist()


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", max_rows: int = 4000, max_languages: int = 128) -> Model:
    """Train on rows outside the held-out fold whose language is not null and whose text has a letter.

    The sample has at most about ``max_rows`` rows, shared equally by the languages (a language with
    fewer rows gives all of them) and chosen by a hash of the key; the counts behind the rates are
    over all rows.  Only texts of the sample and their languages reach the driver, as histograms.
    Of a column with more than ``max_languages`` values the most frequent ones are learnt, since pairs grow with their
    square.  A text is unlike a language if it is less typical than nearly all (99.9 %) of the sample by half the distance between
    these and the median.  Without such rows the model answers ``und``.
    """
    session(docs.sparkSession)
    known = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).cast("string").alias("_l")).where(
        F.col("_l").isNotNull() & F.col("_t").isNotNull() & ~held_out(F.col("_k"))
    )
    counts = {r["_l"]: r["count"] for r in known.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(max_languages).collect()}
    each = max_rows / max(len(counts), 1)
    rates = docs.sparkSession.createDataFrame([(x, min(1.0, each / n)) for x, n in counts.items()], "_l string, _r double")
    sample = known.join(F.broadcast(rates), "_l").where(unit_hash(F.coalesce(F.col("_k").cast("string"), F.lit("")), "langid") < F.col("_r"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                x, has = histograms(texts_of(batch.column(0), start, 64))
                rows = [r.astype(np.float16).tobytes() for r in x[has]]
                langs = [v for v, h in zip(batch.column(1).slice(start, 64).to_pylist(), has, strict=True) if h]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(langs, pa.string())], ["x", "l"])

    got = sample.select("_t", "_l").mapInArrow(extract, "x binary, l string").toArrow()
    label = np.array(got.column("l").to_pylist(), object)
    x = np.zeros((len(label), DIMENSIONS), np.float32)
    for i, v in enumerate(got.column("x")):
        x[i] = np.frombuffer(v.as_buffer(), np.float16)
    del got
    own = sorted(set(label.tolist()))
    families = sorted({family_of(v) for v in own})
    languages = {f: [v for v in own if family_of(v) == f] for f in families}
    group = np.array([family_of(v) for v in label], object)
    weights, bias, slope = [], [], []

    def pair(a: np.ndarray, b: np.ndarray) -> int:
        rows = np.flatnonzero(a | b)
        y = np.where(a[rows], 1.0, -1.0).astype(np.float32)
        part = x if len(rows) == len(x) else x[rows]  # the sample is large: no second copy of all of it
        w, c = train_svm(part, y)
        size = np.abs(part @ w + c)
        weights.append(w)
        bias.append(c)
        slope.append(4.0 / max(float(np.median(size)), 1e-3))  # the median margin counts as 98 % sure
        return len(weights) - 1

    between = [(i, j, pair(group == families[i], group == families[j])) for i, j in itertools.combinations(range(len(families)), 2)]
    within = {f: [(i, j, pair(label == v[i], label == v[j])) for i, j in itertools.combinations(range(len(v)), 2)] for f, v in languages.items()}
    n = len(weights)
    logs = np.zeros((len(own), DIMENSIONS), np.float32)
    mean = np.zeros(len(label))
    for i, v in enumerate(own):
        rows = np.flatnonzero(label == v)
        part = x[rows]
        part *= part
        logs[i] = np.log(0.999 * part.mean(0) + 0.001 / DIMENSIONS)
        mean[rows] = part @ logs[i]
    usual, low = (float(np.median(mean)), float(np.quantile(mean, 0.001))) if len(mean) else (0.0, -1.0)
    floor = low - max(0.5 * (usual - low), 0.5)
    return Model(families, languages, between, within, np.array(weights, np.float32).reshape(n, DIMENSIONS), np.array(bias, np.float32), np.array(slope, np.float32), own, logs, usual, floor)


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return ``key, held_out, lang_pred, score, typical`` for every row of ``docs``, from the whole text alone.

    ``typical`` is 0 for a text unlike any that the language was learnt from.  Null texts and texts without a letter give ``und`` and score 0.  Repeated rows give equal rows;
    other columns are not read; empty tables give empty results.
    """
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                lang, score, typical = own.predict(texts_of(batch.column(1), start, 64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, 64), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(typical, pa.float64())],
                    [key, "lang_pred", "score", "typical"],
                )

    found = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, lang_pred string, score double, typical double")
    return found.select(F.col(key), held_out(F.col(key)).alias("held_out"), "lang_pred", "score", "typical")


def keep_known(docs: DataFrame, model: Model, least: float = 0.0, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learnt language, with a score of ``least`` or more.

    Texts without a letter and texts unlike anything learnt go.
    """
    shared = session(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            keep: list[bool] = []
            for start in range(0, batch.num_rows, 64):
                found = own.predict(texts_of(batch.column(at), start, 64))
                keep += [x != "und" and y >= least and z > 0 for x, y, z in zip(*found, strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
