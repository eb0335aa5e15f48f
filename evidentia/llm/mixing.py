"""Mixing sources to target weights with hash-threshold histograms, in DataFrame operations only.

Every document has a 60-bit hash.  A source that must give ``r`` times its words gives every
document ``floor(r)`` times; the rest of its budget goes to the documents whose hash is under a
threshold, so the documents of a smaller budget are a subset of those of a larger one.  The
threshold is found by histograms: words are summed by source and the next 12 bits of the hash,
and only the bucket in which the budget ends is refined.  No documents are sorted or collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.llm.common import WORD, cut, scope, unused

BITS = 12
LEVELS = 5


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of the key as text (a null key: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """``_s, source_size, target`` by source: the total is shared by weight and no target exceeds ``most`` times its source.

    The excess of sources at their limit is reshared by weight until none is above.  That is the
    level L at which the sum of min(limit, L * weight) is the total: sources reach their limit in
    the order of limit by weight, so running sums give L.  The table has a row for each source.
    """
    order = Window.orderBy(F.col("_s").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", F.col("_s").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    return (
        sizes.groupBy("_s")
        .agg(F.sum("_size").alias("source_size"))
        .withColumn("_w", weight)
        .withColumn("_limit", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_limit") / F.col("_w"))
        .withColumns({"_total": F.sum("source_size").over(every), "_ws": F.sum("_w").over(every)})
        .withColumns({"_before": F.coalesce(F.sum("_limit").over(by_ratio), F.lit(0.0)), "_wbefore": F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0))})
        .withColumn("_level", (F.col("_total") - F.col("_before")) / (F.col("_ws") - F.col("_wbefore")))
        .withColumn("_at", F.min(F.when(F.col("_ratio") >= F.col("_level"), F.struct("_ratio", "_level"))).over(every)["_level"])
        .select("_s", "source_size", F.least("_limit", F.coalesce(F.col("_at") * F.col("_w"), "_limit")).alias("target"))
    )


def plan(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[int] = (1, 2, 3), most: float = 3.0, name: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The sizes of all documents (``_k, _s, _size, _x``) and, by source ``_s``, what decides on its documents:
    ``source_size, target, _whole`` (times that every document is taken) and ``_low`` (the hash under which one is taken once more)."""
    with scope(docs.sparkSession):
        sizes = cut(
            docs.select(F.col(key).alias("_k"), F.col(source).alias("_s"), words(F.col(text)).alias("_size")).withColumn("_x", hash60(F.col("_k"))),
            name + "-sizes",
            keep=True,
        )
        plan = cut(
            source_targets(sizes, weights, most)
            .withColumn("_whole", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)))
            .withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
            .withColumns({"_low": F.lit(0).cast("long"), "_under": F.lit(0).cast("long")}),
            name + "-targets",
        )
        keep = ["_s", "source_size", "target", "_whole", "_rest"]
        for level in range(LEVELS):
            step = 1 << (BITS * (LEVELS - level - 1))
            span = step << BITS
            last = level == LEVELS - 1
            inside = (F.col("_x") >= F.col("_low")) & (F.col("_x") < F.col("_low") + span)
            bars = (
                sizes.join(plan.select(F.col("_s").alias("_ps"), "_low"), F.col("_s").eqNullSafe(F.col("_ps")))
                .where(inside)
                .select(F.col("_s").alias("_bs"), F.floor((F.col("_x") - F.col("_low")) / step).cast("long").alias("_b"), "_size")
                .groupBy("_bs", "_b")
                .agg(F.sum("_size").alias("_v"))
            )
            running = Window.partitionBy("_bs").orderBy("_b")
            bars = bars.withColumn("_c", F.sum("_v").over(running)).join(
                plan.select(F.col("_s").alias("_ps"), F.col("_rest").alias("_pr"), F.col("_under").alias("_pu")), F.col("_bs").eqNullSafe(F.col("_ps"))
            )
            full = F.col("_pu") + F.col("_c")
            if last:  # a bucket is one hash value now: it is taken if that ends nearer to the budget
                taken = (F.col("_v") > 0) & (F.abs(F.col("_pr") - full) <= F.abs(F.col("_pr") - (full - F.col("_v"))))
                edge = F.max(F.when(taken, F.struct((F.col("_b") + 1).alias("b"), F.col("_c").alias("c"))))
            else:  # the first bucket that goes beyond the budget is the one to refine
                edge = F.min(F.when(full > F.col("_pr"), F.struct(F.col("_b").alias("b"), (F.col("_c") - F.col("_v")).alias("c"))))
            edges = bars.groupBy("_bs").agg(edge.alias("_m"))
            beyond = F.lit(0 if last else 1 << BITS)  # no bucket goes beyond the budget
            plan = (
                plan.join(edges, F.col("_s").eqNullSafe(F.col("_bs")), "left")
                .select(
                    *keep,
                    (F.col("_low") + F.coalesce(F.col("_m.b"), beyond) * step).alias("_low"),
                    (F.col("_under") + F.coalesce("_m.c", F.lit(0))).alias("_under"),
                )
            )
            plan = cut(plan, f"{name}-level{level}", keep=last)
        return sizes, plan


def copies(x: Column, whole: Column, low: Column, filled: Column) -> Column:
    """How often a document with hash ``x`` is taken under its source's plan; once more than all only if it is ``filled``: has words."""
    return (whole + F.when((x < low) & filled, 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """Return ``key, size, source_size, target, copies, taken`` for every row of ``docs``.

    ``taken`` is ``copies`` times ``size``; the sum over a source ends at the document nearest to
    the target.  Empty texts have size 0 and take 0 words.  A null source is a source of its own.
    Repeated rows with one key share a hash and so a decision.  A null key is hashed as the empty
    text.  A source without words has target 0.  Other columns are not read; empty tables give
    empty results.  The same rows always give the same mix.
    """
    sizes, own = plan(docs, key, **options)
    times = copies(F.col("_x"), F.col("_whole"), F.col("_low"), F.col("_size") > 0)
    return sizes.join(own.withColumnRenamed("_s", "_ps"), F.col("_s").eqNullSafe(F.col("_ps"))).select(
        F.col("_k").alias(key),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        times.alias("copies"),
        (times * F.col("_size")).cast("long").alias("taken"),
    )


def take(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as the mix takes it; the texts stay where they are.

    Columns of ``docs`` may have any names.  A text without words is taken as often as all of its source are, never once more.
    """
    _, own = plan(docs, key, text, source, **options)
    s, whole, low, n = (unused(c, docs.columns) for c in ("_plan_source", "_plan_whole", "_plan_low", "_plan_copy"))
    own = own.select(F.col("_s").alias(s), F.col("_whole").alias(whole), F.col("_low").alias(low))
    filled = F.coalesce(F.col(text).rlike(WORD), F.lit(False))
    times = copies(hash60(F.col(key)), F.col(whole), F.col(low), filled)
    joined = docs.join(own, F.col(source).eqNullSafe(F.col(s))).withColumn(n, times).where(F.col(n) > 0)
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(docs.columns)


#: The mix in DuckDB SQL: a plain sort and running sum instead of histograms.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS x
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, 3.0 * source_size AS cap, 3.0 * source_size / w AS ratio,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS ws
  FROM s
), b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0.0) AS before, coalesce(sum(w) OVER o, 0.0) AS wbefore
  FROM r WINDOW o AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, (total - before) / (ws - wbefore) AS level FROM b
), t AS (
  SELECT source, source_size, CAST(least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * w, cap)) AS DOUBLE) AS target FROM l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), g AS (
  SELECT source, x, CAST(sum(size) AS BIGINT) AS v FROM d GROUP BY source, x
), c AS (
  SELECT g.*, CAST(sum(v) OVER (PARTITION BY source ORDER BY x) AS BIGINT) AS c FROM g
), k AS (
  SELECT c.source, max(c.x) AS edge
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
  WHERE c.v > 0 AND abs(target - whole * source_size - c.c) <= abs(target - whole * source_size - (c.c - c.v))
  GROUP BY c.source
)
SELECT d.doc_id, d.size, q.source_size, q.target,
       whole + CASE WHEN d.x <= k.edge AND d.size > 0 THEN 1 ELSE 0 END AS copies,
       (whole + CASE WHEN d.x <= k.edge AND d.size > 0 THEN 1 ELSE 0 END) * d.size AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
