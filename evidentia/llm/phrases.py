"""Document fingerprints by locally consistent parsing.

Deterministic coin tossing cuts a sequence of symbols into phrases of two to a few symbols: each
symbol is labelled by the lowest bit in which it differs from the one before, labels are labelled
again until six are left and then three, and a phrase begins where a label is greater than its
neighbours.  Each phrase gets a name, and the names are parsed again.  A cut depends on a few
symbols around it only, so equal substrings share their interior names wherever they stand.

The parser works on many texts at once, as one array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import session

#: Names kept of levels 1, 2 and 3, and names that both texts need for a level to be compared.
KEPT = (32, 32, 64)
ENOUGH = (1, 6, 10)

U = np.uint64
_BRUIJN = U(0x03F79D71B4CB0A89)
_BIT = np.zeros(64, np.uint8)
for _i in range(64):
    _BIT[((1 << _i) * int(_BRUIJN) & (2**64 - 1)) >> 58] = _i

#: Next label by (label before, label), for labels under 128.
_a, _b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
_x = (_a ^ _b) | 128
_l = np.log2(_x & -_x).astype(np.int64)
_TOSS = (2 * np.minimum(_l, 6) + ((_b >> np.minimum(_l, 6)) & 1)).astype(np.uint8).ravel()
#: The least colour of 0, 1, 2 that neither neighbour has, by (before, after); 7 is no neighbour.
_FREE = np.array([min({0, 1, 2} - {a, b}) for a in range(8) for b in range(8)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _name(sym: np.ndarray, starts: np.ndarray, salt: int) -> np.ndarray:
    """A name for each block of symbols, from the symbols and their order alone."""
    place = np.arange(len(sym), dtype=np.int64)
    begin = np.zeros(len(sym), np.int64)
    begin[starts[1:]] = np.diff(starts)
    place -= np.cumsum(begin)
    return mix(np.add.reduceat(mix(sym + (place.astype(U) + U(1)) * U(0x9E3779B97F4A7C15)), starts) + U(salt))


def parse(sym: np.ndarray, doc: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases and the text of each.  ``doc`` is sorted."""
    if not len(sym):
        return sym, doc
    # runs of one symbol become one symbol, so neighbours differ
    head = np.ones(len(sym), bool)
    head[1:] = (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])
    starts = np.flatnonzero(head)
    if len(starts) < len(sym):
        length = np.diff(np.append(starts, len(sym)))
        one = sym[starts]
        long = length > 1
        one = one.copy()
        one[long] = mix(one[long] + mix(length[long].astype(U) + U(salt)))
        sym, doc = one, doc[starts]
    n = len(sym)
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    x = np.empty(n, U)
    x[0] = 1
    x[1:] = sym[1:] ^ sym[:-1]
    x[first] = 1
    x[x == 0] = 1  # two runs may get one name, with odds of 1 in 2^64
    low = _BIT[((x & (~x + U(1))) * _BRUIJN) >> U(58)]
    label = (2 * low + ((sym >> low.astype(U)) & U(1)).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        before = np.empty(n, np.uint8)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _TOSS[before.astype(np.int32) * 128 + label]
    for colour in (5, 4, 3):
        before, after = np.empty(n, np.uint8), np.empty(n, np.uint8)
        before[1:], after[:-1] = label[:-1], label[1:]
        before[first], after[last] = 7, 7
        at = np.flatnonzero(label == colour)
        label[at] = _FREE[before[at].astype(np.int32) * 8 + after[at]]
    peak = first.copy()
    peak[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~last[1:-1] & ~first[1:-1]
    starts = np.flatnonzero(peak)
    return _name(sym, starts, salt), doc[starts]


def _least(names: np.ndarray, doc: np.ndarray, n: int, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k least hashes of the names of each text, repeats counted, and how many it has."""
    key = np.sort((doc.astype(U) << U(32)) | (names >> U(32)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
    # the second, third, ... time a name stands in a text it counts as another name
    key = np.unique((key >> U(32) << U(32)) | (mix((key & U(0xFFFFFFFF)) + (place.astype(U) << U(32))) >> U(32)))
    edges = np.searchsorted(key, np.arange(n + 1, dtype=U) << U(32))
    return [key[a : min(b, a + k)].astype(np.uint32) for a, b in zip(edges[:-1], edges[1:], strict=True)], np.diff(edges)


def sketches(texts: list[str]) -> list[tuple[np.ndarray, ...]]:
    """For each text: least names of levels 1, 2, 3, each after the number of names of the level."""
    coded = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sym = np.frombuffer(b"".join(coded), np.uint32).astype(U)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), [len(c) // 4 for c in coded])
    n = len(texts)
    levels = []
    for level in range(len(KEPT)):
        sym, doc = parse(sym, doc, level + 1)
        levels.append((sym, doc))
    upper = [_least(*levels[i], n, KEPT[i]) for i in (1, 2)]
    few = upper[0][1] < 4 * ENOUGH[1]  # only these may have to be compared at the first level
    sym, doc = levels[0]
    short = few[doc]
    own, _ = _least(sym[short], doc[short], n, KEPT[0])
    made = [(own, np.bincount(doc, minlength=n)), *upper]
    return [tuple(np.concatenate([np.array([count[i]], np.uint32), kept[i]]) for kept, count in made) for i in range(n)]


def to_string(sketch: tuple[np.ndarray, ...]) -> str:
    """A fingerprint: for each level the number of names and, in hexadecimal, the least ones."""
    return ".".join(f"{int(s[0])}:{s[1:].astype('>u4').tobytes().hex()}" for s in sketch)


def from_string(text: str) -> tuple[np.ndarray, ...]:
    parts = [x.split(":") for x in text.split(".")]
    return tuple(np.concatenate([np.array([int(n)], np.uint32), np.frombuffer(bytes.fromhex(h), ">u4").astype(np.uint32)]) for n, h in parts)


def likeness(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> float:
    """Estimated share of common names (Jaccard) at the highest level that both texts fill, or else at the lowest of which both have
    names on record; 1 for equal fingerprints, 0 where there is none.  Longer texts keep no names of the first level."""
    if all(len(x) == len(y) and (x == y).all() for x, y in zip(a, b, strict=True)):
        return 1.0
    kept = [i for i in range(len(KEPT)) if len(a[i]) > 1 and len(b[i]) > 1]
    full = [i for i in kept if min(int(a[i][0]), int(b[i][0])) >= ENOUGH[i]]
    if not kept:
        return 0.0
    level = full[-1] if full else kept[0]
    x, y = a[level], b[level]
    union = np.union1d(x[1:], y[1:])[: KEPT[level]]
    both = np.intersect1d(np.intersect1d(x[1:], y[1:], assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def edited(text: str, following: str) -> str:
    """The text with its last quarter (rounded down) replaced by as much of the beginning of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    known = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")  # folded into one literal
    steps = [1 << i for i in range(len(bounds).bit_length() - 1, -1, -1)]
    at = lambda n, s: n + F.when(F.coalesce(F.get(known, n + s - 1) <= order, F.lit(False)), s).otherwise(0)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), at)


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 2000, most_ranges: int = 1 << 16) -> DataFrame:
    """Return ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for every row.

    The next document is the next row in ascending order of (key, text), after the last row the
    first; a null key comes first and a null text counts as empty.  A table of one row is its own
    next.  The key is an integer.  Repeated rows follow each other.  Other columns are not read; an
    empty table gives an empty result.

    Keys are cut into ranges of about ``rows`` rows; their bounds are approximate quantiles of the keys alone, a
    table of 8 bytes a range that the driver holds.  Beyond ``most_ranges`` ranges they get longer.  Each
    range also gets the first row of the next range, goes to a partition of its own, so texts are shuffled once,
    and is streamed in order: a task holds a few texts at a time, however many rows its range has.
    """
    spark = session(docs.sparkSession)
    least = -(2**63)
    order = F.coalesce(F.col("_k").cast("long"), F.lit(least))
    rows_ = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("_o", order)
    keys = docs.select(F.col(key).alias("_k")).withColumn("_o", order)
    total = keys.count()
    n = max(1, min(most_ranges, -(-total // rows)))
    bounds: list[int] = []
    if n > 1:
        at = keys.agg(F.percentile_approx("_o", [i / n for i in range(1, n)], 10 * max(n, 1000))).first()[0]
        bounds = sorted(set(at))
    bucket = _bucket(F.col("_o"), bounds)
    heads = sorted((r["_b"], r["_o"]) for r in keys.withColumn("_b", bucket).groupBy("_b").agg(F.min("_o").alias("_o")).collect())
    place = {b: i for i, (b, _) in enumerate(heads)}  # ranges that have rows, from 0 on
    ends = spark.createDataFrame([(o, i - 1 if i else len(heads) - 1) for i, (_, o) in enumerate(heads)], "_o long, _b int")  # the range that ends with this head
    marks = (
        rows_.join(F.broadcast(ends), "_o")
        .groupBy("_o", "_b")
        .agg(F.min("_t").alias("_t"))
        .select(F.lit(None).cast(docs.schema[key].dataType).alias("_k"), "_t", "_o", "_b", F.lit(True).alias("_end"))
    )
    if len(place) <= len(bounds):  # bounds that no row lies between
        bucket = _bucket(F.col("_o"), [o for _, o in heads][1:])
    stream = (
        rows_.withColumns({"_b": bucket, "_end": F.lit(False)})
        .unionByName(marks)
        .repartitionById(max(1, len(heads)), "_b")
        .sortWithinPartitions("_b", "_end", "_o", "_t")
        .select("_k", "_t", "_end")
    )
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []  # rows whose next row is at hand, but for the last

        def done(kind: pa.DataType) -> pa.RecordBatch:
            own = [(k, t, u) for (k, t, end), (_, u, _) in zip(held[:-1], held[1:], strict=True) if not end]
            changed = [edited(t, u) for _, t, u in own]
            texts = list(dict.fromkeys([x for _, t, u in own for x in (t, u)] + changed))
            made = dict(zip(texts, sketches(texts), strict=True))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, _, _ in own], kind),
                    pa.array([len(t) for _, t, _ in own], pa.int64()),
                    pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], pa.string()),
                    pa.array([to_string(made[t]) for _, t, _ in own], pa.string()),
                    pa.array([to_string(made[c]) for c in changed], pa.string()),
                    pa.array([likeness(made[t], made[c]) for (_, t, _), c in zip(own, changed, strict=True)], pa.float64()),
                    pa.array([likeness(made[t], made[u]) for _, t, u in own], pa.float64()),
                ],
                names,
            )

        chars, kind_ = 0, None
        for batch in batches:
            kind_ = batch.schema.field(0).type
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                chars += len(row[1])
                if chars >= 300_000 and len(held) > 1:
                    yield done(kind_)
                    held, chars = held[-1:], len(row[1])
        if len(held) > 1:
            yield done(kind_)

    return stream.mapInArrow(run, schema)
