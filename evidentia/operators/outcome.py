"""What becomes of a run: both gates together, modes, the judge's say, and rates over labelled runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIFFICULTIES = ["basic", "hard", "mixed"]
PROVENANCES = ["derived", "constructed"]


def run_outcomes(checked: DataFrame, verdicts: DataFrame, mode: str = "enforce", inbound_blocks: bool = True) -> DataFrame:
    """``run_id, would_block, stage, reason_code, outcome``: one row for each verdict.

    ``checked`` has run_id, ordinal, decision and reasons of chunks; ``verdicts`` run_id, decision and
    reasons (codes).  A refused chunk blocks the run, and so does an output that is blocked.  Without
    ``inbound_blocks``, as for callers that only leave a refused chunk out of the context, the output alone
    decides, and whatever is not allowed is blocked.  In the mode monitor everything is delivered and
    ``would_block`` keeps what enforcement would do.  One aggregate by run, pre-aggregated on the map side.
    """
    if mode not in ("enforce", "monitor"):
        raise ValueError(f"no such mode: {mode!r}")
    refused = F.col("decision") == "block"
    inbound = checked.where(refused).groupBy("run_id").agg(F.min_by(F.element_at("reasons.code", 1), "ordinal").alias("_in"))
    both = verdicts.select("run_id", F.col("decision").alias("_d"), F.col("reasons").alias("_r")).join(inbound, "run_id", "left")
    at_in, at_out = F.col("_in").isNotNull() & F.lit(inbound_blocks), F.col("_d") == "block" if inbound_blocks else F.col("_d") != "allow"
    would = at_in | at_out
    return both.select(
        "run_id",
        would.alias("would_block"),
        F.when(at_in, "inbound").when(at_out, "outbound").otherwise("none").alias("stage"),
        F.when(at_in, F.col("_in")).when(at_out, F.get("_r", F.lit(0))).alias("reason_code"),
        F.when(would & F.lit(mode == "enforce"), "block").otherwise("allow").alias("outcome"),
    )


def shape_flag(prepared: DataFrame) -> Column:
    """The shape baseline: empty, or like JSON but not to be parsed; ``prepared`` comes from ``classify.prepare``."""
    return prepared["_empty"] | ~F.coalesce(prepared["_json.parses"], F.lit(True))


def rates(results: DataFrame, kept: Column, axes: dict[str, list[str]]) -> DataFrame:
    """``axes..., numerator, denominator, percent, label`` over the full grid; empty cells have a null percent."""
    spark = results.sparkSession
    grids = [spark.createDataFrame([(v,) for v in values], f"{name} string") for name, values in axes.items()]
    grid = reduce(lambda a, b: a.crossJoin(b), grids)  # a few named values a side
    own = results.where(kept).groupBy(*axes).agg(F.count_if("would_block").alias("n"), F.count(F.lit(1)).alias("d"))
    n, d = F.coalesce("n", F.lit(0)), F.coalesce("d", F.lit(0))
    percent = F.when(d > 0, 100.0 * n / d)
    label = F.when(d == 0, "n/a (0 scenarios)").otherwise(F.format_string("%d/%d (%.1f%%)", n, d, percent))
    return grid.join(own, list(axes), "left").select(*axes, n.alias("numerator"), d.alias("denominator"), percent.alias("percent"), label.alias("label"))


def recall_rates(results: DataFrame) -> DataFrame:
    """Of the runs that should block, how many would, by difficulty and provenance."""
    return rates(results, F.col("expected") == "should_block", {"difficulty": DIFFICULTIES, "provenance": PROVENANCES})


def false_positive_rates(results: DataFrame) -> DataFrame:
    """Of the runs that should pass, how many would block, by difficulty."""
    return rates(results, F.col("expected") == "should_allow", {"difficulty": DIFFICULTIES})


def saturated(rate: DataFrame, least: int = 5) -> DataFrame:
    """Rates of 100 % over fewer than ``least`` rows, which say little; the mixed tier is not reported."""
    return rate.where((F.col("difficulty") != "mixed") & (F.col("percent") == 100.0) & (F.col("denominator") < least))


def gate_breakdown(results: DataFrame) -> DataFrame:
    """``expected, actual, n`` by expected gate, by actual gate, and by pair, in one pass."""
    sets = results.groupingSets([["expected"], ["actual"], ["expected", "actual"]], "expected", "actual")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("long").alias("level"))


def saturation_warnings(recall: DataFrame, false_positive: DataFrame, least: int = 5) -> list[str]:
    """A sentence for each rate of 100 % over too few scenarios: recall first, by difficulty and provenance."""
    order = {v: i for i, v in enumerate([*DIFFICULTIES, *PROVENANCES])}
    said = []
    for r in sorted(saturated(recall, least).collect(), key=lambda r: (order[r["difficulty"]], order[r["provenance"]])):
        said.append((f"{r['difficulty']} {r['provenance']} recall", r["denominator"]))
    for r in sorted(saturated(false_positive, least).collect(), key=lambda r: order[r["difficulty"]]):
        said.append((f"{r['difficulty']} false-positive rate", r["denominator"]))
    return [f"Saturation warning: {name} is 100% with only {n} scenarios; this result detects regressions but does not measure adequacy." for name, n in said]


def control_evidence(classified: DataFrame, outputs: DataFrame) -> DataFrame:
    """What a run without guards delivers: all its classified chunks in order, and its output.

    ``run_id, control, chunk_count, chunk_ids, content_hashes, labels, output_hash``; hashes are the first 16
    digits of a SHA-256.  Nothing is checked, no claim is made and nothing withheld.
    """
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    row = F.struct("ordinal", F.col("chunk_id").alias("id"), short(F.col("text")).alias("hash"), F.concat_ws(":", "channel", "tier").alias("label"))
    per = classified.groupBy("run_id").agg(F.sort_array(F.collect_list(row)).alias("c"))
    none = F.array().cast("array<string>")
    field = lambda name: F.coalesce(F.transform("c", lambda x: x[name]), none)
    both = outputs.select("run_id", "output").join(per, "run_id", "left")
    return both.select(
        "run_id", F.lit("delivered").alias("control"), F.size(F.coalesce(field("id"), none)).alias("chunk_count"), field("id").alias("chunk_ids"),
        field("hash").alias("content_hashes"), field("label").alias("labels"), short(F.col("output")).alias("output_hash"),
    )


def control_problems(evidence: DataFrame, chunks: DataFrame, outputs: DataFrame) -> DataFrame:
    """``run_id, problem`` of every control whose evidence is not what its run supplies; none if all is sound.

    ``chunks`` has run_id, ordinal, chunk_id and text.  Ids and texts must be those of the run, in its order, every label
    a channel and a tier, the output the run's, and nothing may be withheld.  A run without evidence is a problem too.
    """
    short = lambda c: F.substring(F.sha2(c, 256), 1, 16)
    listed = chunks.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", F.col("chunk_id").alias("id"), short(F.col("text")).alias("hash")))).alias("w"))
    none = F.array().cast("array<string>")
    want = lambda name: F.coalesce(F.transform("w", lambda x: x[name]), none)
    both = outputs.select("run_id", short(F.col("output")).alias("_out")).join(listed, "run_id", "left").join(evidence, "run_id", "full_outer")
    problem = (
        F.when(F.col("_out").isNull(), "evidence of a run that is not there")
        .when(F.col("control").isNull(), "no evidence")
        .when(F.col("chunk_count") != F.size(want("id")), "another number of chunks")
        .when(F.col("chunk_ids") != want("id"), "other chunk ids, or another order")
        .when(F.col("content_hashes") != want("hash"), "the content of a chunk was altered")
        .when((F.size("labels") != F.size(want("id"))) | F.exists("labels", lambda x: ~x.rlike(r"\A[A-Z_]+:T[1-5]\z")), "an unusable label")
        .when(F.col("output_hash") != F.col("_out"), "the output was altered")
        .when(F.col("control") != "delivered", "an unguarded run withheld something")
    )
    return both.select("run_id", problem.alias("problem")).where(F.col("problem").isNotNull())


def scenario_results(scenarios: DataFrame, outcomes: DataFrame, evidence: DataFrame, shape: DataFrame) -> DataFrame:
    """One row for each scenario: what was expected, what happened with guards and without, and what the shape baseline says.

    ``scenarios`` has run_id, provenance, difficulty, expected_gate and expectation; ``shape`` run_id and flagged.
    """
    both = scenarios.join(outcomes, "run_id").join(evidence.select("run_id", "control", F.col("chunk_count").alias("control_chunks")), "run_id").join(shape, "run_id")
    expected = F.when(F.col("expectation") == "should_block", "block").otherwise("allow")
    return both.select(
        "run_id", "difficulty", "provenance", F.col("expectation").alias("expected"), F.col("outcome").alias("actual"), (F.col("outcome") == expected).alias("passed"),
        "expected_gate", F.col("stage").alias("actual_gate"), "reason_code", "stage", "control", "control_chunks",
        F.when(F.col("would_block") == (F.col("control") == "withheld"), "none").otherwise("changed").alias("guard_effect"),
        F.when(F.col("flagged"), "catch").otherwise("miss").alias("shape_baseline"), "would_block",
    )


def bench_summary(results: DataFrame) -> DataFrame:
    """``metric, value`` of a bench in one aggregate: how many runs, stages and reasons of those that would block, and what the guard changed."""
    block, would = F.col("expected") == "should_block", F.col("would_block")
    whole = results.agg(
        F.count(F.lit(1)).alias("control_invocations"),
        F.count_if(block).alias("should_block"),
        F.count_if(block & (F.col("guard_effect") == "changed")).alias("guard_changed"),
        F.count_if(block & (F.col("shape_baseline") == "catch")).alias("shape_catches"),
        F.count_if(block & (F.col("expected_gate") == "outbound") & (F.col("actual_gate") == "outbound")).alias("outbound_validated"),
        F.count_if(would).alias("would_block"),
        F.count_if("passed").alias("passed"),
        *[F.count_if(would & (F.col("stage") == s)).alias(f"stage_{s}") for s in ("inbound", "outbound", "none")],
    )
    wide = whole.unpivot([], whole.columns, "metric", "value")
    reasons = results.where(would & F.col("reason_code").isNotNull()).groupBy(F.concat(F.lit("reason_"), "reason_code").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return wide.unionByName(reasons)
