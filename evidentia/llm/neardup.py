"""MinHash near-duplicates by an LSH forest.

Equal shingle sets are classes; everything below works on one representative of a class.  Each
representative has a MinHash signature.  A tree of the forest is one order of the signature's positions:
all representatives are sorted by their signatures in that order, by range over all tasks, and in the
sorted run every one is paired with the first of those with which it has the longest common prefix.
So the depth at which two are compared follows how dense the run is there: where few are alike
it is shallow, among many copies it is deep, and no run is cut at a fixed length.

A region is a part of a run with a common prefix of a few positions, as few as the threshold needs so that
all but a ``miss`` share of the pairs at it meet in one of the trees, which share no position up to there.
Pairs are confirmed on the full shingle sets, and links make components.

That leaves pairs of a region that are in different components.  They are gone through exactly: members
that are not in the region's largest component are held against all others of the region, block by block,
by signature in numpy, and what might be a link is confirmed on the full sets in the same task, which
only links leave.  Nothing is capped: a large region only has more blocks.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, scope, session, texts_of
from evidentia.operators.components import components

SPACE = re.compile(r"[\x20\x09-\x0D]+")
_UPPER = {i: i + 32 for i in range(65, 91)}

U = np.uint64
#: Positions of the order of a tree by which representatives are sorted at most.
REACH = 16


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: str, size: int, memo: dict[str, int]) -> np.ndarray:
    """Sorted 64-bit names of the distinct shingles of the whole text.

    A-Z are lower-cased; a text with fewer words than ``size`` has its word sequence as its one
    shingle; without words there is none.
    """
    words = [w for w in SPACE.split(text.translate(_UPPER)) if w]
    if not words:
        return np.zeros(0, U)
    ids = np.empty(len(words), U)
    for i, w in enumerate(words):
        known = memo.get(w)
        if known is None:
            if len(memo) > 200_000:
                memo.clear()
            known = memo[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        ids[i] = known
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, U)
    for i in range(n):
        out = _mix(out * U(0x9E3779B97F4A7C15) + ids[i : len(words) - n + 1 + i])
    return np.unique(out)


def signature(s: np.ndarray, a: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits each, of a set that is not empty: for each odd multiplier the least product, and of that a hash."""
    x = (s >> U(32)).astype(np.uint32)
    low = np.full(len(a), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 256):  # a block of products stays in the cache
        part = x[at : at + 256, None] * a
        part ^= part >> np.uint32(15)
        np.minimum(low, part.min(0), out=low)
    return ((low * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20).integers(0, 2**31, n).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def forest(level: float, positions: int, miss: float) -> tuple[int, int, int]:
    """Trees, depth of their regions, and positions: the deepest regions of which enough trees fit side by side into the positions.

    A pair of Jaccard ``level`` agrees in a region of d positions with a chance of level ** d, in each tree
    independently, since regions share no position.  Where even regions of one position need more trees than there are
    positions, there are more positions.
    """

    def need(d: int) -> int:
        return 1 if level >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-(level**d))))

    depth = max((d for d in range(1, REACH + 1) if d * need(d) <= positions), default=1)
    return need(depth), depth, max(positions, depth * need(depth))


def miss_rate(level: float, trees: int, depth: int) -> float:
    """The chance that a pair of Jaccard ``level`` shares no region."""
    return (1 - level**depth) ** trees


def _orders(positions: int, trees: int, depth: int) -> np.ndarray:
    """By tree the positions it sorts by: first its own, then others in an order of its own."""
    rng = np.random.default_rng(21)
    own = rng.permutation(positions)[: trees * depth].reshape(trees, depth)
    rest = [rng.permutation(np.setdiff1d(np.arange(positions), row)) for row in own]
    return np.stack([np.concatenate([row, r])[: min(REACH, positions)] for row, r in zip(own, rest, strict=True)])


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose two nodes are in different components."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    both = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def _merge(roots: DataFrame | None, links: DataFrame, name: str) -> DataFrame:
    """``node, root`` after more links: components of the components, so that only their roots meet."""
    if roots is None:
        return components(links, name)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
    edges = between.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
    over = components(edges, name)
    moved = roots.join(over.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    fresh = over.join(roots, "node", "left_anti")
    return cut(moved.unionByName(fresh), f"{name}-roots")


def _sets(docs: DataFrame, size: int, positions: int) -> DataFrame:
    """``doc, n, digest, sig`` of each row; digest and sig are null without shingles."""
    a = _multipliers(positions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            n, digest, sig = [], [], []
            for x in texts_of(batch.column(1), 0, batch.num_rows):
                s = shingles(x, size, memo)
                n.append(len(s))
                digest.append(hashlib.sha256(s.tobytes()).digest()[:16] if len(s) else None)
                sig.append(signature(s, a).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sig, pa.binary())], ["doc", "n", "digest", "sig"]
            )

    return docs.mapInArrow(run, "doc long, n long, digest binary, sig binary")


def _strings(reps: DataFrame, orders: np.ndarray) -> DataFrame:
    """``tree, pre, rep, n``: the signatures in the order of each tree, as byte strings that sort like it."""
    trees, reach = orders.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
            pre = sig[:, orders].astype(">u2").tobytes()
            width = 2 * reach
            rows = [pre[i : i + width] for i in range(0, len(pre), width)]
            rep, n = (np.repeat(batch.column(i).to_numpy(), trees) for i in (0, 1))
            tree = np.tile(np.arange(trees, dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(rows, pa.binary()), pa.array(rep), pa.array(n)], ["tree", "pre", "rep", "n"])

    return reps.select("rep", "n", "sig").mapInArrow(run, "tree int, pre binary, rep long, n long")


#: Rows of a forest: members of regions with what they are paired with, and (``mark``) where a region may go on in another task.
RUN = "mark boolean, key long, tree int, rep long, n long, head long, head_n long, common int"


class _Walk:
    """One pass over a range of the sorted run, with the open nodes of the tree on a stack."""

    def __init__(self, depth: int):
        self.depth, self.first, self.begin = depth, True, None
        self.stack: list[tuple[int, tuple[int, int]]] = []

    def name(self, tree: int, pre: np.ndarray) -> int:
        key = np.array([tree + 1], U) * U(0xD1342543DE82EF95)
        for v in pre[: self.depth]:
            key = _mix(key * U(0x9E3779B97F4A7C15) + U(int(v)))
        return int(key.astype(np.int64)[0])

    def rows(self, tree: np.ndarray, pre: np.ndarray, rep: np.ndarray, n: np.ndarray, start: int, last: bool) -> list[tuple]:
        """Rows from ``start`` on; the last one waits for the row after it, unless there is none."""
        same = np.zeros(len(rep), np.int64)
        equal = np.concatenate([pre[1:] == pre[:-1], np.zeros((len(rep) - 1, 1), bool)], 1)
        same[1:] = np.where(tree[1:] == tree[:-1], equal.argmin(1), 0)
        follows = same >= self.depth
        member = follows.copy()
        member[:-1] |= follows[1:]
        member[start] |= self.first
        member[-1] |= last
        out: list[tuple] = []
        for i in (np.flatnonzero(member[start : len(rep) - (not last)]) + start).tolist():
            here = (int(rep[i]), int(n[i]))
            if follows[i]:
                common, head = int(same[i]), (int(rep[i - 1]), int(n[i - 1]))
                while self.stack and self.stack[-1][0] > common:
                    head = self.stack.pop()[1]
                if self.stack and self.stack[-1][0] == common:
                    head = self.stack[-1][1]
                else:
                    self.stack.append((common, head))
                out.append((False, self.begin[0], int(tree[i]), *here, *head, common))
            else:
                self.stack.clear()
                self.begin = (self.name(int(tree[i]), pre[i]), int(tree[i]), *here)
                out.append((False, *self.begin, None, None, None))
                if self.first:
                    out.append((True, *self.begin, None, None, None))
            self.first = False
        if last:
            out.append((True, *self.begin, None, None, None))
        return out


def _runs(strings: DataFrame, depth: int, reach: int) -> DataFrame:
    """The regions of every sorted run, and for each member the first of those with the longest common prefix (``head``).

    A task walks a range of the sorted run once.  The first row of a range and the first of its last region are marked:
    regions that go on in the next range are put together by these.
    """
    kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
    names = [c.split()[0] for c in RUN.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = _Walk(depth), None  # held: the row that waits, after the one before it
        for batch in batches:
            if not batch.num_rows:
                continue
            pre = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, reach)
            now, start = [batch.column(0).to_numpy(), pre, batch.column(2).to_numpy(), batch.column(3).to_numpy()], 0
            if held is not None:
                now, start = [np.concatenate([h, x]) for h, x in zip(held[0], now, strict=True)], held[1]
            out = walk.rows(*now, start, False) if len(now[2]) - start > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            keep = max(0, len(now[2]) - 2)
            held = ([x[keep:].copy() for x in now], len(now[2]) - 1 - keep)
        if held is not None:
            out = walk.rows(*held[0], held[1], True)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    ordered = strings.repartitionByRange("tree", "pre", "rep").sortWithinPartitions("tree", "pre", "rep")
    return ordered.mapInArrow(run, RUN)


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """The pairs whose signatures agree in ``least`` positions."""
    of = lambda c: classes.select(F.col("rep").alias(c), F.col("sig").alias(f"s{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).sum(1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """The pairs (a > b) whose full sets are alike enough.

    Only texts that occur in a pair are kept, and the texts, which are smaller than their sets, meet
    by a and by b; sets are made and compared in numpy.
    """
    wanted = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    own = cut(texts.join(wanted.hint("merge"), "doc", "left_semi"), f"{name}-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        made: dict[str, np.ndarray] = {}

        def of(text: str) -> np.ndarray:
            known = made.get(text)
            if known is None:
                if len(made) >= 32:  # the head of a node comes again and again
                    made.clear()
                known = made[text] = shingles(text, size, memo)
            return known

        for batch in batches:
            a, b, good = batch.column(0), batch.column(1), []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = of(y.as_py()), of(x.as_py())
                both = len(np.intersect1d(p, q, assume_unique=True)) if len(p) and len(q) and 100 * min(len(p), len(q)) >= percent * max(len(p), len(q)) else 0
                good.append(both > 0 and 100 * both >= percent * (len(p) + len(q) - both))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left = pairs.join(own.select(F.col("doc").alias("a"), F.col("text").alias("ta")), "a")
    met = left.join(own.select(F.col("doc").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    return cut(met.mapInArrow(compare, "a long, b long"), f"{name}-links")


#: Columns of a unit: a block of a region's members and a block (``second``) of those that its largest component does not hold (``other``).
UNIT = "key long, i int, j int, second boolean, other boolean, tree int, rep long, root long, n long, sig binary"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each unit; they come sorted by key, i, j."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(unit: list[tuple], prefixes: np.ndarray, percent: int, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Row x of a unit and the rows y that may be linked to it, each pair of different roots once.

    Signatures must agree in ``least`` positions.  A pair that shares a prefix in an earlier tree
    is left to that tree, where it is met in the same way.
    """
    column = lambda k, t: np.array([r[k] for r in unit], t)
    second, other, rep, root, n = column(3, bool), column(4, bool), column(6, np.int64), column(7, np.int64), column(8, np.int64)
    sig = np.frombuffer(b"".join(r[9] for r in unit), np.uint16).reshape(len(unit), -1)
    earlier, two = prefixes[: unit[0][5]], np.flatnonzero(~second)
    for x in np.flatnonzero(second):
        ok = (root[two] != root[x]) & (100 * np.minimum(n[two], n[x]) >= percent * np.maximum(n[two], n[x]))
        y = two[ok & (~other[two] | (rep[two] < rep[x]))]  # two that are both outside meet twice
        if not len(y):
            continue
        agree = sig[y] == sig[x]
        near = agree.sum(1) >= least
        y, agree = y[near], agree[near]
        if len(earlier) and len(y):
            y = y[~agree[:, earlier].all(2).any(1)]
        if len(y):
            yield x, y


def _by_unit(df: DataFrame) -> DataFrame:
    return df.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep", "second")


def _suspects(members: DataFrame, prefixes: np.ndarray, percent: int, least: float, size: int, mass: int) -> DataFrame:
    """The rows of units that have a candidate.

    ``members`` has key, count, mass, others, tree, rep, root, other, n, sig.  A region has so many blocks of members that none has
    much more than ``size`` of them or ``mass`` shingles, and so many blocks of others; each pair of blocks is one
    unit.  A member moves once for each block of others, one of the others also once for each block of members.
    """
    blocks = lambda n: F.greatest(F.ceil(F.col(n) / size), F.ceil(F.col("mass") / mass * F.col(n) / F.col("count")), F.lit(1)).cast("int")
    place = lambda salt, n: F.pmod(F.xxhash64("rep", F.lit(salt)), F.col(n).cast("long")).cast("int")
    at = lambda i, j, second: F.struct(i.alias("i"), j.alias("j"), F.lit(second).alias("second"))
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    none = F.array().cast("array<struct<i:int,j:int,second:boolean>>")
    placed = members.withColumns({"_b": blocks("count"), "_p": blocks("others")}).withColumns({"_own": place(1, "_b"), "_own2": place(2, "_p")})
    here = F.transform(span("_p"), lambda j: at(F.col("_own"), j, False))
    there = F.when(F.col("other"), F.transform(span("_b"), lambda i: at(i, F.col("_own2"), True))).otherwise(none)
    units = placed.withColumn("u", F.explode(F.concat(here, there))).select("key", "u.i", "u.j", "u.second", "other", "tree", "rep", "root", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [c.split()[0] for c in UNIT.split(", ")]
        for unit in _units(batches):
            met = np.zeros(len(unit), bool)
            for x, y in _candidates(unit, prefixes, percent, least):
                met[x] = True
                met[y] = True
            rows = [unit[k] for k in np.flatnonzero(met)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return _by_unit(units).mapInArrow(run, UNIT)


def _links(suspects: DataFrame, texts: DataFrame, prefixes: np.ndarray, size: int, percent: int, least: float, name: str) -> DataFrame:
    """``a, b`` (a > b): of the links within each unit a forest that connects what they connect.

    Candidates are confirmed on the full sets where their unit is; pairs that links of the unit have
    already joined are not compared again, and only links leave the task.
    """
    wanted = suspects.select(F.col("rep").alias("doc")).distinct()
    own = cut(texts.join(wanted.hint("merge"), "doc", "left_semi").dropDuplicates(["doc", "text"]), f"{name}-texts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for unit in _units(batches):
            sets = [shingles(r[10], size, memo) for r in unit]
            end = np.cumsum([len(s) for s in sets])
            names, code = np.unique(np.concatenate(sets), return_inverse=True)
            codes = np.split(code, end[:-1])
            own_set = np.zeros(len(names), bool)
            part = np.unique([r[7] for r in unit], return_inverse=True)[1]
            found = []
            for x, ys in _candidates(unit, prefixes, percent, least):
                own_set[codes[x]] = True
                for y in ys:
                    if part[x] == part[y]:
                        continue
                    both = np.count_nonzero(own_set[codes[y]])
                    if both and 100 * both >= percent * (len(codes[x]) + len(codes[y]) - both):
                        found.append((unit[x][6], unit[y][6]))
                        part[part == part[y]] = part[x]
                own_set[codes[x]] = False
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], ["a", "b"])

    met = suspects.join(own.withColumnRenamed("doc", "rep"), "rep").select(*[c.split()[0] for c in UNIT.split(", ")], "text")
    return cut(_by_unit(met).mapInArrow(run, "a long, b long"), f"{name}-links")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    positions: int = 128,
    block: int = 256,
    mass: int = 2_000_000,
    miss: float = 1e-5,
) -> DataFrame:
    """Return ``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents are linked if 100 * intersection >= ``percent`` * union of their shingle sets.
    ``component_id`` is the smallest key reachable by links and ``kept`` tells whether it is the
    row's own.  Texts that are null, empty or without words have no set and no links.  A text of
    fewer than ``size`` words has its word sequence as its one shingle.  Keys are integers; a
    null key is no candidate: its row gets a null component and is kept.  Rows that repeat a key with
    different texts are one document, linked wherever one of the texts is.  Other columns are not read; an empty table gives
    an empty result.

    ``forest`` gives the depth of regions and the trees such that a pair at the threshold is missed by all trees
    with a chance of ``miss`` at most (20 trees of 5 positions and 8.1e-6 for 85 percent, 22 of 4 and 9.2e-6 for
    80); what is nearer is met more surely.  A pair is given up before its full sets are compared only if its
    signatures agree 5.5 standard deviations less than those of a link would.  What is written on the way is removed at the end.
    """
    with scope(session(docs.sparkSession)):
        rows = docs.select(F.col(key).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        level = percent / 100
        trees, depth, positions = forest(level, positions, miss)
        every = cut(_sets(rows, size, positions), "near-sets")
        classes = cut(
            every.where(F.col("digest").isNotNull() & F.col("doc").isNotNull())
            .groupBy("digest")
            .agg(F.min(F.struct("doc", "n", "sig")).alias("m"))
            .select("digest", F.col("m.doc").alias("rep"), F.col("m.n").alias("n"), F.col("m.sig").alias("sig")),
            "near-classes",
        )
        orders = _orders(positions, trees, depth)
        least = positions * (level - 5.5 * (level * (1 - level) / positions) ** 0.5)
        walked = cut(_runs(cut(_strings(classes, orders), "near-strings"), depth, orders.shape[1]), "near-runs")
        paired = F.col("head").isNotNull() & (F.col("head") != F.col("rep")) & (100 * F.least("n", "head_n") >= percent * F.greatest("n", "head_n"))
        pair = lambda x, y: (F.greatest(x, y).alias("a"), F.least(x, y).alias("b"))
        # one pair for each member, with what it has most in common, settles most of a group of copies
        best = walked.where(paired).groupBy("rep").agg(F.max_by("head", F.struct("common", F.lit(0) - F.col("head"))).alias("head")).select(*pair("rep", "head"))
        marks = walked.where("mark").select("key", "rep").distinct()
        across = marks.join(marks.groupBy("key").agg(F.min("rep").alias("to")), "key").where("rep <> to").select(*pair("rep", "to"))
        first = cut(_likely(best.unionByName(across).distinct(), classes, least), "near-first")
        roots = _merge(None, _confirm(first, rows, size, percent, "near-1"), "near-c1")
        others = cut(_apart(walked.where(paired).select(*pair("rep", "head")).distinct(), roots).join(first, ["a", "b"], "left_anti"), "near-others")
        roots = _merge(roots, _confirm(cut(_likely(others, classes, least), "near-second"), rows, size, percent, "near-2"), "near-c2")
        placed = cut(
            walked.where("NOT mark").select("key", "tree", "rep", "n").join(roots.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep")),
            "near-placed",
        )
        parts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("m"))
        split = parts.groupBy("key").agg(
            F.sum("c").alias("count"), F.sum("m").alias("mass"), F.max_by("root", F.struct("c", F.lit(0) - F.col("root"))).alias("main"), F.max("c").alias("largest"), F.count(F.lit(1)).alias("parts")
        )
        split = split.where("parts > 1").select("key", "count", "mass", "main", (F.col("count") - F.col("largest")).alias("others"))
        members = placed.join(split, "key").withColumn("other", F.col("root") != F.col("main")).join(classes.select("rep", "sig"), "rep")
        prefixes = orders[:, :depth]
        suspects = cut(_suspects(members, prefixes, percent, least, block, mass), "near-suspects")
        final = _merge(roots, _links(suspects, rows, prefixes, size, percent, least, "near-3"), "near-c3")
        named = classes.select("digest", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("root", "rep").alias("root"))
        component = F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc"))
        kind = docs.schema[key].dataType
        result = (
            every.select("doc", "n", "digest")
            .join(named, "digest", "left")
            .select(
                F.col("doc").cast(kind).alias(key),
                F.col("n").alias("n_shingles"),
                component.cast(kind).alias("component_id"),
                F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"),
            )
        )
        return cut(result, "near-result", keep=True)
