"""Nearest neighbours by additive quantisation and exact reranking.

A vector is coded as the sum of one word from each of several full-dimensional codebooks, trained
one after the other on what the earlier ones leave.  Encoding is a beam search over the codebooks.
Every vector is encoded once, and its code and the squared norm of what is coded are stored in a table;
the distance of a query to it is ``|q|^2 - 2 sum <q, word> + norm``, so a table of the query's products
with all words scores a code by a few lookups.  The best by that score are fetched by their keys and ranked
again by exact distances on the vectors.

A vector that is many times longer or shorter than most is coded at a scale of its own, a power of two
that is stored with its code, so neither large nor small components are lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import cut, scope, session, unit_hash

BATCH = 1024


@dataclass
class Quantiser:
    """``books`` is (codebooks, words, dimensions); ``cross`` has the products of all pairs of words."""

    books: np.ndarray

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows by codebooks) and squared norms of the coded vectors."""
        n, (m, k, _) = len(x), self.books.shape
        codes = np.zeros((n, 1, 0), np.uint8)
        left = x[:, None, :].astype(np.float32)
        for book in self.books:
            b = left.shape[1]
            flat = left.reshape(n * b, -1)
            cost = ((flat * flat).sum(1)[:, None] - 2 * flat @ book.T + (book * book).sum(1)).reshape(n, b * k)
            keep = min(beam, b * k)
            best = np.argpartition(cost, keep - 1, axis=1)[:, :keep] if keep < b * k else np.tile(np.arange(b * k), (n, 1))
            best = np.take_along_axis(best, np.argsort(np.take_along_axis(cost, best, 1), axis=1, kind="stable"), 1)
            parent, word = best // k, best % k
            rows = np.arange(n)[:, None]
            left = left[rows, parent] - book[word]
            codes = np.concatenate([codes[rows, parent], word[:, :, None].astype(np.uint8)], axis=2)
        coded = x - left[:, 0]
        return codes[:, 0], (coded * coded).sum(1)


def train(x: np.ndarray, codebooks: int, words: int, rounds: int, seed: int = 7) -> Quantiser:
    """Codebooks by k-means on the residuals, one after the other."""
    rng = np.random.default_rng(seed)
    left, books = x.astype(np.float32), []
    for _ in range(codebooks):
        k = min(words, max(len(left), 1))
        book = left[rng.permutation(len(left))[:k]].copy() if len(left) else np.zeros((1, x.shape[1]), np.float32)
        for _ in range(rounds):
            near = ((book * book).sum(1) - 2 * left @ book.T).argmin(1) if len(left) else np.zeros(0, np.int64)
            count = np.bincount(near, minlength=k)
            total = np.zeros_like(book)
            np.add.at(total, near, left)
            full = count > 0
            book[full] = total[full] / count[full, None]
            if (~full).any() and len(left):
                book[~full] = left[rng.integers(0, len(left), (~full).sum())]
        near = ((book * book).sum(1) - 2 * left @ book.T).argmin(1) if len(left) else np.zeros(0, np.int64)
        left = left - book[near] if len(left) else left
        books.append(book)
    k = max(len(b) for b in books)
    return Quantiser(np.stack([np.pad(b, ((0, k - len(b)), (0, 0)), mode="edge") for b in books]))


def usable(v: Column) -> Column:
    """Not null, not zero, and every component finite."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def scales(x: np.ndarray, usual: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the usual range, and by how many powers of two each was brought there: 0 for lengths within a factor of 16 of the usual."""
    power = np.frexp(np.abs(x).max(1))[1].astype(np.int64) - usual
    power[np.abs(power) <= 4] = 0
    return np.ldexp(x, -(power + usual)[:, None].astype(np.int32)), power


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision, summed from the first component on; scaled where squares would leave the range."""
    parts = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: F.abs(x - y))
    plain = F.sqrt(F.aggregate(parts, F.lit(0.0), lambda t, x: t + x * x))
    most = F.array_max(parts)
    scaled = most * F.sqrt(F.aggregate(parts, F.lit(0.0), lambda t, x: t + (x / most) * (x / most)))
    return F.when((most == 0) | ((most > 1e-150) & (most < 1e150)), plain).otherwise(scaled)


def search(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    every: int = 100,
    k: int = 10,
    codebooks: int = 32,
    words: int = 256,
    sample: int = 16000,
    beam: int = 2,
    rerank: int = 256,
    block: int = 1024,
) -> DataFrame:
    """The ``k`` nearest of all other rows for each row whose key is divisible by ``every``: ``query_id, rank, vec_id, score``.

    The score is the Euclidean distance in double precision on the original vectors; ties go to
    the smaller key.  Vectors that are null, zero, or hold a null or non-finite component take no
    part, nor do null keys and vectors of another length than the most frequent one (the longer of
    equally frequent ones).  Of rows that repeat a key the least vector counts.  With fewer candidates
    than ``k`` all are returned.  An empty table gives an empty result.  Other columns are not read.

    The codebooks are trained on about ``sample`` rows at most, chosen by a hash of the key; every row is
    encoded, once.  Of equal vectors only the ``k + 1`` smallest keys can be among any answer: a limit on
    the rank within equal vectors, applied before and after the shuffle, removes the others.  Queries go in
    blocks of ``block`` (a bounded broadcast each) over the table of codes, 8 bytes and ``codebooks`` bytes a row; a
    task keeps the ``rerank`` best by lookup for each query, of those of all tasks the ``rerank`` best are fetched
    and ranked exactly.  More than ``rerank`` candidates that are nearer by their codes hide a neighbour: recall is
    measured against brute force.
    """
    spark = session(vectors.sparkSession)
    final = "query_id long, rank int, vec_id long, score double"
    with scope(spark):
        kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
        given = vectors.select(F.col(key).cast("long").alias("_k"), F.col(vector).cast(kind).alias("_v")).where(F.col("_k").isNotNull() & usable(F.col("_v")))
        lengths = given.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
        if not lengths:
            return spark.createDataFrame([], final)
        dims, total = lengths[0]["d"], lengths[0]["count"]
        rows = given.where(F.size("_v") == dims)
        again = cut(rows.groupBy("_k").count().where("count > 1").select("_k"), "ann-repeated")
        if not again.isEmpty():  # only these move, for that
            least = rows.join(again, "_k", "left_semi").groupBy("_k").agg(F.min("_v").alias("_v"))
            rows = cut(rows.join(again, "_k", "left_anti").unionByName(least), "ann-rows")
        drawn = rows.where(unit_hash(F.col("_k"), "ann") < min(1.0, sample / total)).select("_v").toArrow().column("_v").combine_chunks()
        if not len(drawn):
            drawn = rows.select("_v").limit(1).toArrow().column("_v").combine_chunks()
        x = _vectors(drawn, dims)
        usual = int(np.median(np.frexp(np.abs(x).max(1))[1]))
        model = spark.sparkContext.broadcast((train(scales(x, usual)[0], codebooks, words, rounds=6), usual))
        same = Window.partitionBy("_v").orderBy("_k")
        base = cut(rows.withColumn("_r", F.row_number().over(same)).where(F.col("_r") <= k + 1).drop("_r"), "ann-distinct")
        codes = cut(base.mapInArrow(_encode(model, beam, dims), "_k long, code binary, norm double, power int"), "ann-codes")
        asked = cut(rows.where(F.col("_k") % every == 0).withColumn("_block", F.pmod(F.xxhash64("_k"), F.lit(1 << 40))), "ann-queries")
        count = asked.count()
        blocks, found = max(1, -(-count // block)), []
        for i in range(blocks):
            lo, hi = (1 << 40) * i // blocks, (1 << 40) * (i + 1) // blocks
            own = asked.where((F.col("_block") >= lo) & (F.col("_block") < hi)).orderBy("_k").toArrow()
            if not own.num_rows:
                continue
            shared = spark.sparkContext.broadcast((own.column("_k").to_numpy(), _vectors(own.column("_v").combine_chunks(), dims)))
            found.append(cut(codes.mapInArrow(_scan(shared, model, rerank), "query_id long, vec_id long, near double"), "ann-found"))
            shared.unpersist()
        if not found:
            return spark.createDataFrame([], final)
        near = Window.partitionBy("query_id").orderBy("near", "vec_id")
        best = reduce(DataFrame.unionByName, found).withColumn("_r", F.row_number().over(near)).where(F.col("_r") <= rerank).select("query_id", "vec_id")
        of = lambda df, name, v: df.select(F.col("_k").alias(name), F.col("_v").alias(v))
        both = best.join(of(base, "vec_id", "v"), "vec_id").join(of(asked, "query_id", "q"), "query_id")
        nearest = Window.partitionBy("query_id").orderBy("score", "vec_id")
        ranked = both.select("query_id", "vec_id", distance(F.col("q"), F.col("v")).alias("score")).withColumn("rank", F.row_number().over(nearest))
        return cut(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "ann-result", keep=True)


def _encode(model, beam: int, dims: int):
    """Rows to codes, the squared norm of what is coded, and the power of two it was scaled by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quantiser, usual = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x, power = scales(_vectors(part.column(1), dims), usual)
                code, norm = quantiser.encode(x.astype(np.float32), beam)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm.astype(np.float64)), pa.array(power.astype(np.int32))], ["_k", "code", "norm", "power"]
                )

    return run


def _scan(shared, model, rerank: int):
    """The ``rerank`` best of a task for each query of a block by lookups in the table of its products with all words.

    ``near`` is the squared distance less the query's own square, at the query's scale: it orders candidates of one query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        quantiser, usual = model.value
        books = quantiser.books
        own, q_power = scales(q, usual)
        table = np.einsum("mkd,qd->mkq", books, own.astype(np.float32))
        kept_s, kept_id = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                key, norm = part.column(0).to_numpy(), part.column(2).to_numpy()
                code = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(len(key), -1)
                product = np.zeros((len(key), len(ids)), np.float32)
                for j in range(len(books)):
                    product += table[j][code[:, j]]
                power = part.column(3).to_numpy()
                if power.any() or q_power.any():
                    by = np.clip(power[:, None].astype(np.int64) - q_power[None, :], -500, 500).astype(np.int32)
                    score = np.ldexp(norm[:, None], 2 * by) - np.ldexp(2.0 * product.astype(np.float64), by)
                else:
                    score = norm[:, None] - 2.0 * product
                score = score.T
                score[key[None, :] == ids[:, None]] = np.inf  # a query is no candidate of its own
                kept_s = np.concatenate([kept_s, score], 1)
                kept_id = np.concatenate([kept_id, np.broadcast_to(key, score.shape)], 1)
                if kept_s.shape[1] > rerank:
                    best = np.argpartition(kept_s, rerank - 1, axis=1)[:, :rerank]
                    kept_s, kept_id = np.take_along_axis(kept_s, best, 1), np.take_along_axis(kept_id, best, 1)
        if kept_s.shape[1]:
            other = kept_id != ids[:, None]
            at, _ = np.nonzero(other)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(kept_id[other]), pa.array(kept_s[other])], ["query_id", "vec_id", "near"])

    return run
