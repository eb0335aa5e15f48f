"""Toxicity by non-negative positive-unlabelled learning in numpy.

Positives are texts confirmed as toxic, the rest is unlabelled text.  With the class prior p the
risk of a classifier g is ``p R_P(+) + max(0, R_U(-) - p R_P(-))``: the part in the maximum is the
risk on negatives, estimated from unlabelled texts less the positives among them, and is kept from
going below zero, where a model would only be fitting noise.

Features are the words and the word beginnings that occur in a text at all, so one word counts
alike in a short and in a very long text.  Only features whose frequency among positives differs
clearly from that among unlabelled texts enter the model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, held_out, scope, session, texts_of, unit_hash

TOKEN = re.compile(r"[^\W\d_]+")
STEM = 5
MEMO = 1 << 18


def features(text: str, memo: dict[str, tuple[int, int]]) -> set[int]:
    """Hashes of what the whole text has: its distinct lower-case words, the beginnings of longer
    words, and those beginnings that two, or four, different words share."""
    found: set[int] = set()
    stems: dict[int, int] = {}
    for word in set(TOKEN.findall(text.lower())):
        ids = memo.get(word)
        if ids is None:
            ids = (zlib.crc32(word.encode()), zlib.crc32(b"^" + word[:STEM].encode()) if len(word) > STEM else -1)
            if len(memo) >= MEMO:
                memo.clear()
            memo[word] = ids
        found.add(ids[0])
        if ids[1] >= 0:
            stems[ids[1]] = stems.get(ids[1], 0) + 1
    for stem, n in stems.items():
        found.add(stem)
        if n >= 2:
            found.add(stem ^ 0x55555555)
        if n >= 4:
            found.add(stem ^ 0x2AAAAAAA)
    return found


@dataclass
class Model:
    """Weights by feature, and the line that turns a margin into a probability."""

    weights: dict[int, float]
    bias: float
    slope: float
    offset: float

    def margin(self, ids: set[int]) -> float:
        get = self.weights.get
        return self.bias + sum(get(i, 0.0) for i in ids)

    def score(self, ids: set[int]) -> float:
        z = self.slope * self.margin(ids) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


@dataclass
class Rows:
    """Which features of a vocabulary each of ``size`` texts has: places in the vocabulary, and the text of each."""

    ids: np.ndarray
    text: np.ndarray
    size: int
    wide: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.text, weights=w[self.ids], minlength=self.size)

    def back(self, d: np.ndarray) -> np.ndarray:
        return np.bincount(self.ids, weights=d[self.text], minlength=self.wide)

    def only(self, keep: np.ndarray) -> Rows:
        place = np.cumsum(keep) - 1
        inside = keep[self.text]
        return Rows(self.ids[inside], place[self.text[inside]], int(keep.sum()), self.wide)


def _screen(found: DataFrame, n: int, m: int, least: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features whose frequency among the ``n`` positives differs clearly from that among all ``m`` texts, and both counts.

    Counts are summed on the executors.  Only features of which the sample of positives has, or lacks, more than chance gives can
    pass, so what reaches the driver is bounded by that sample, not by the corpus."""
    a, expected, share = F.col("a"), F.col("b") * n / m, F.col("b") / m
    far = F.abs(a - expected) / F.sqrt(expected * (1 - share) + 1)  # what comes up once or twice is far from nothing
    clear = found.where((F.col("b") >= least) & (far >= z)).select(F.pmod(F.col("f").cast("long"), F.lit(1 << 32)).alias("f"), "a", "b").toArrow()
    columns = [clear.column(c).to_numpy().astype(np.int64) for c in ("f", "a", "b")]
    order = np.argsort(columns[0])
    return columns[0][order], columns[1][order], columns[2][order]


def _rows(sets: DataFrame, vocabulary: np.ndarray) -> tuple[Rows, np.ndarray, np.ndarray]:
    """By text of the sample which features of the (sorted) vocabulary it has, its label (-1: none) and whether it counts as unlabelled."""
    wide = len(vocabulary)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for f in batch.column(0):
                s = f.values.to_numpy(zero_copy_only=False).view(np.uint32).astype(np.int64)
                at = np.minimum(np.searchsorted(vocabulary, s), max(wide - 1, 0))
                found.append(at[vocabulary[at] == s].astype(np.int32) if wide and len(s) else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1), batch.column(2)], ["f", "y", "u"])

    got = sets.mapInArrow(known, "f array<int>, y int, u boolean").toArrow().combine_chunks()
    lists = got.column("f").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    y = np.array([-1 if v is None else v for v in got.column("y").to_pylist()], np.int64)
    rows = Rows(lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), len(sizes), wide)
    return rows, y, np.array(got.column("u").to_pylist(), bool)


def _scale(in_pos: np.ndarray, in_all: np.ndarray, n: int, m: int, prior: float) -> np.ndarray:
    """Log ratio of a feature's frequency among positives to that among negatives, the latter as all texts less prior times positives."""
    pos = (in_pos + 0.5) / (n + 1)
    neg = np.maximum((in_all / m - prior * in_pos / n) / (1 - prior), 0) + 0.5 / m + 0.02 * pos
    return np.clip(np.log(pos / neg), -4, 4)


def nnpu(pos: Rows, unl: Rows, scale: np.ndarray, prior: float, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear classifier under the non-negative risk with the logistic loss (Adam, full batches)."""
    sigmoid = lambda v: 1 / (1 + np.exp(-np.clip(v, -40, 40)))
    w, b = np.zeros(len(scale)), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        gp, gu = pos.dot(scale * w) + b, unl.dot(scale * w) + b
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        up = -prior * sigmoid(-gp) / len(gp)  # of p R_P(+)
        if negative >= 0:
            dp, du = up - prior * sigmoid(gp) / len(gp), sigmoid(gu) / len(gu)
        else:  # the part below zero is undone before anything else is learnt
            dp, du = prior * sigmoid(gp) / len(gp), -sigmoid(gu) / len(gu)
        g = np.append(scale * (pos.back(dp) + unl.back(du)) + decay * w, dp.sum() + du.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return scale * w, b


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope (never negative) and offset of a logistic line by Newton steps."""
    a, c = 1.0, 0.0
    mean, spread = float(margin.mean()), float(margin.std()) or 1.0
    u = (margin - mean) / spread
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * u + c, -40, 40)))
        q = p * (1 - p) + 1e-9
        g = np.array([((p - label) * u).sum() + 1e-2 * a, (p - label).sum()])
        h = np.array([[(q * u * u).sum() + 1e-2, (q * u).sum()], [(q * u).sum(), q.sum()]])
        d = np.linalg.solve(h, g)
        a, c = a - float(np.clip(d[0], -2, 2)), c - float(np.clip(d[1], -2, 2))
    a = max(a, 0.0)
    return a / spread, c - a * mean / spread


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    max_positive: int = 6000,
    max_negative: int = 6000,
    max_unlabelled: int = 12000,
    prior: float | None = None,
    clear: float = 4.0,
    decay: float = 1e-3,
) -> Model:
    """Train on the rows outside the held-out fold.

    What frequent features are is counted over all these rows.  The sample on which the risk is minimised is bounded: at most
    about ``max_positive`` rows labelled 1, ``max_negative`` labelled 0 (these serve the calibration and the prior only) and
    ``max_unlabelled`` rows of any kind, each chosen by a hash of the key at a rate that the counts over all rows give.
    ``prior`` is by default the share of 1 among the labelled rows.  A key with several labels is toxic if any of them is;
    null labels and null keys are no labels.  A feature enters the model if its frequency among positives is ``clear`` standard
    deviations from that among all texts.  Margins are calibrated on halves of the sample that the other half judges.
    Texts are read once, for counts and sample alike.  Without a positive or without another text the model scores
    everything as the prior (0 without labels).
    """
    spark = session(docs.sparkSession)
    with scope(spark):
        own = (
            labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y"))
            .where(F.col("_k").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_k")))
            .groupBy("_k")
            .agg(F.max("_y").alias("_y"))
        )
        counts = {r["_y"]: r["count"] for r in own.groupBy("_y").count().collect()}
        pos_n, neg_n = counts.get(1, 0), counts.get(0, 0)
        share = pos_n / (pos_n + neg_n) if pos_n + neg_n else 0.0
        if prior is None:
            prior = share
        rate = lambda most, n: min(1.0, most / n) if n else 0.0
        train = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).where(~held_out(F.col("_k")))
        total = train.count()
        draw = unit_hash(F.col("_k"), "toxicity")
        chosen = own.where(draw < F.when(F.col("_y") == 1, rate(max_positive, pos_n)).otherwise(rate(max_negative, neg_n)))
        marked = (
            train.withColumn("_free", unit_hash(F.coalesce(F.col("_k").cast("string"), F.lit("")), "unlabelled") < rate(max_unlabelled, total))
            .join(F.broadcast(chosen), "_k", "left")  # the sample's labels, bounded by its parameters
            .select("_t", "_y", "_free")
        )
        read = cut(marked.mapInArrow(_extract, "f array<int>, y int, u boolean, c array<long>"), "toxicity-features")
        sets = read.where("c IS NULL").select("f", "y", "u")
        sizes = sets.agg(F.count_if(F.col("y") == 1).alias("n"), F.count_if("u").alias("m")).first()
        if not sizes["n"] or not sizes["m"] or not 0 < prior < 1:
            flat = min(max(prior, 1e-6), 1 - 1e-6)
            return Model({}, 0.0, 0.0, float(np.log(flat / (1 - flat))))
        everywhere = read.where("c IS NOT NULL").select(F.explode(F.arrays_zip("f", "c")).alias("x")).groupBy(F.col("x.f").alias("f")).agg(F.sum("x.c").alias("b"))
        positive = sets.where("y = 1").select(F.explode("f").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("a"))
        found = everywhere.join(positive, "f", "left").select("f", F.coalesce("a", F.lit(0)).alias("a"), "b")
        vocabulary, in_pos, in_all = _screen(found, sizes["n"], total, least=5, z=clear)
        x, y, free = _rows(sets, vocabulary)
    n = int((y == 1).sum())
    scale = _scale(in_pos, in_all, n, total, prior)
    learn = lambda rows: nnpu(x.only((y == 1) & rows), x.only(free & rows), scale, prior, decay=decay)
    w, b = learn(np.ones(x.size, bool))
    half = (np.arange(x.size) * 2654435761 % (1 << 32)) >> 31 == 0
    known = np.flatnonzero(y >= 0)
    margin = x.dot(w) + b
    if min((y[half] == 1).sum(), (y[~half] == 1).sum(), (free & half).sum(), (free & ~half).sum()) >= 20:
        for side in (half, ~half):
            other_w, other_b = learn(~side)
            margin[side] = (x.dot(other_w) + other_b)[side]
    # rows labelled 0 and 1 may have been drawn at different rates: weigh by repeating the offset
    slope, offset = platt(margin[known], y[known].astype(float))
    drawn = (y[known] == 1).mean()
    if 0 < drawn < 1 and 0 < share < 1:
        offset += float(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return Model({int(i): float(v) for i, v in zip(vocabulary, w, strict=True)}, float(b), slope, offset)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of the texts that the sample holds, and, with ``c``, how many texts of this task have each feature."""
    names = ["f", "y", "u", "c"]
    kinds = [pa.list_(pa.int32()), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
    memo: dict[str, tuple[int, int]] = {}
    seen: dict[int, int] = {}

    def counts() -> pa.RecordBatch:
        ids = np.fromiter(seen.keys(), np.uint32, len(seen)).view(np.int32)
        row = [[ids], [None], [None], [np.fromiter(seen.values(), np.int64, len(seen))]]
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names)

    for batch in batches:
        rows = []
        for x, y, u in zip(texts_of(batch.column(0), 0, batch.num_rows), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            found = features(x, memo)
            for f in found:
                seen[f] = seen.get(f, 0) + 1
            if u or y is not None:
                rows.append((np.array(sorted(found), np.uint32).view(np.int32), y, bool(u), None))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        if len(seen) >= MEMO:  # as much as a task holds; the rest is added up later
            yield counts()
    if seen:
        yield counts()


def keep_clean(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under ``threshold``; null texts count as empty."""
    shared = session(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, int]] = {}
        own = shared.value
        for batch in batches:
            keep = [own.score(features(x, memo)) < threshold for x in texts_of(batch.column(at), 0, batch.num_rows)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def score_documents(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Return ``key, held_out, score, predicted`` for every row of ``docs``, from the text alone.

    Whole texts are read; null counts as empty and is scored like a text without words.  Repeated
    rows give equal rows; other columns are not read; empty tables give empty results.
    """
    spark = session(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple[int, int]] = {}
        own = shared.value
        for batch in batches:
            scores = [own.score(features(x, memo)) for x in texts_of(batch.column(1), 0, batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], [key, "score"])

    scored = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(
        F.col(key), held_out(F.col(key)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )
