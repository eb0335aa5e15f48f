"""The grounding ladder: claims against admitted chunks of their run, set-wise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.text import contains_phrase, content_of_tokens, entities, js_trim, normalize, numbers, strip_trailing, tokens_of_normalized
from evidentia.operators.claims import extract_claims

#: Tiers that cannot carry a claim, and the scores of the stages.
UNTRUSTED = ["T4", "T5"]
SCORES = {"exact": 1.0, "normalized": 0.9, "specifics": 0.75, "undecided": 0.5, "none": 0.0}
LOW_TIER = ", but every supporting chunk is tier T4 or T5"
UNDECIDED = "no deterministic check could confirm or refute this claim"


def untrusted_tier(tier: Column) -> Column:
    return tier.isin(UNTRUSTED)


def untrusted_support(tiers: Column) -> Column:
    """Whether there is support and all of it has a tier too low to count; ``tiers`` is an array."""
    return (F.size(tiers) > 0) & F.forall(tiers, untrusted_tier)


def _none() -> Column:
    return F.array().cast("array<string>")


def prepare_chunks(chunks: DataFrame) -> DataFrame:
    """Comparison forms, once for each chunk."""
    n = chunks.select("run_id", "ordinal", "chunk_id", "tier", F.col("text").alias("c_text"), normalize(F.col("text")).alias("c_norm"), numbers(F.col("text")).alias("c_numbers"))
    return n.withColumn("c_tokens", F.array_distinct(tokens_of_normalized(F.col("c_norm"))))


def prepare_claims(claims: DataFrame) -> DataFrame:
    t = F.col("text")
    own = claims.withColumns(
        {
            "_whole": js_trim(t),
            "_bare": strip_trailing(js_trim(t)),
            "_norm": normalize(strip_trailing(t)),
            "_entities": entities(t),
            "_numbers": numbers(t),
            "_content": content_of_tokens(tokens_of_normalized(normalize(t))),
        }
    )
    return own.withColumn("_phrases", F.transform("_entities", normalize)).withColumn("_specific", F.concat("_entities", "_numbers"))


def assess_claims(claims: DataFrame, chunks: DataFrame, min_overlap: float = 0.34) -> DataFrame:
    """Status, method, decided_by, score, supporting_chunk_ids, reason and detail of every claim.

    ``claims`` has run_id, claim_id, text and ``chunks`` run_id, ordinal, chunk_id, text, tier.  Claims meet the
    chunks of their run by an equi-join; a pair is reduced to what the stages need before pairs are
    gathered by claim, and a pair without any hit is not gathered.  Chunks keep their order; of chunks
    with one id each counts, but for support by specifics, which names an id once.
    """
    own = prepare_claims(claims)
    met = own.select("run_id", "claim_id", "_whole", "_bare", "_norm", "_phrases", "_numbers", "_content").join(prepare_chunks(chunks), "run_id")
    n, plain = F.size("_phrases"), F.size("_phrases") + F.size("_numbers") == 0
    phrase_hits = F.filter(F.sequence(F.lit(0), n), lambda i: (i < n) & contains_phrase(F.col("c_norm"), F.coalesce(F.get("_phrases", i), F.lit(""))))
    number_hits = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_numbers")), lambda i: (i < F.size("_numbers")) & F.array_contains("c_numbers", F.coalesce(F.get("_numbers", i), F.lit("")))),
        lambda i: i + n,
    )
    matched = F.size(F.filter("_content", lambda x: F.array_contains("c_tokens", x))) / F.size("_content")
    pairs = met.select(
        "run_id",
        "claim_id",
        F.struct("ordinal", "chunk_id", (~untrusted_tier(F.col("tier"))).alias("good")).alias("c"),
        (F.contains("c_text", "_whole") | ((F.col("_bare") != "") & F.contains("c_text", "_bare"))).alias("exact"),
        ((F.col("_norm") != "") & F.contains("c_norm", "_norm")).alias("norm"),
        F.when(plain & (F.size("_content") > 0), matched).alias("ratio"),
        F.concat(phrase_hits, number_hits).alias("spec"),
        F.when(plain, F.array_intersect("_content", "c_tokens")).alias("common"),
    ).where("exact OR norm OR ratio > 0 OR size(spec) > 0")
    listed = lambda when: F.sort_array(F.collect_list(F.when(when, F.col("c"))))
    per = pairs.groupBy("run_id", "claim_id").agg(
        listed(F.col("exact")).alias("_exact"),
        listed(F.col("norm")).alias("_normal"),
        listed(F.col("ratio") >= 0.9).alias("_cover"),
        F.max(F.when(F.col("ratio") >= 0.9, F.col("ratio"))).alias("_best"),
        F.sort_array(F.collect_list(F.when(F.size("spec") > 0, F.struct("c", "spec")))).alias("_named"),
        F.array_distinct(F.flatten(F.collect_set("common"))).alias("_seen"),
    )
    df = own.join(per, ["run_id", "claim_id"], "left")
    empty = {c: per.schema[c].dataType for c in ("_exact", "_normal", "_cover", "_named", "_seen")}
    df = df.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in empty.items()})
    specific = F.size("_specific")
    by_specific = F.flatten(
        F.transform(
            F.filter(F.sequence(F.lit(0), specific), lambda i: i < specific),
            lambda i: F.transform(F.filter("_named", lambda x: F.array_contains(x["spec"], i)), lambda x: x["c"]),
        )
    )
    seen = lambda want: F.filter("_content", lambda x: F.array_contains("_seen", x) == want)
    df = df.withColumns(
        {
            "_missing": F.filter("_specific", lambda s, i: ~F.exists("_named", lambda x: F.array_contains(x["spec"], i))),
            "_by": by_specific,
            "_in": F.size(seen(True)),
        }
    )
    all_found = (specific > 0) & (F.size("_missing") == 0)
    nothing = F.array().cast(per.schema["_exact"].dataType)
    df = df.withColumns({"_spec": F.when(all_found, F.col("_by")).otherwise(nothing), "_kind": F.when(F.size("_entities") > 0, "entity").otherwise("numeric")})
    covered = F.format_string("claim has %.1f%% normalized content-word coverage in a single chunk", F.col("_best") * 100)
    stages = [
        ("_exact", F.lit("exact"), SCORES["exact"], F.lit("claim appears verbatim in context")),
        ("_normal", F.lit("normalized"), SCORES["normalized"], F.lit("claim appears in context after normalizing case, whitespace and punctuation")),
        ("_cover", F.lit("normalized"), SCORES["normalized"], covered),
        ("_spec", F.col("_kind"), SCORES["specifics"], F.concat(F.lit("every specific in the claim appears in context: "), F.array_join("_specific", ", "))),
    ]
    ids = lambda c: F.transform(c, lambda x: x["chunk_id"])
    own_ids = lambda c: F.array_distinct(ids(c)) if c == "_spec" else ids(c)
    stage = lambda c, name, score, said: F.struct(name.alias("by"), F.lit(score).alias("score"), own_ids(c).alias("ids"), said.alias("said"))
    trusted = F.coalesce(*[F.when(F.exists(c, lambda x: x["good"]), stage(c, *rest)) for c, *rest in stages])
    tainted = F.coalesce(*[F.when(F.size(c) > 0, stage(c, *rest)) for c, *rest in stages])
    total = F.size("_content")
    lexical = (specific == 0) & (total > 0) & (F.col("_in") / total < min_overlap)
    df = df.withColumns({"_trusted": trusted, "_tainted": tainted, "_lacks": (specific > 0) & ~all_found, "_lexical": lexical})
    some = F.size("_missing") < specific
    lacking = F.concat(
        F.when(some, "claim mixes sourced and unsourced specifics; absent from context: ").otherwise("no specific in the claim appears in context: "), F.array_join("_missing", ", ")
    )
    has, bad = F.col("_trusted").isNotNull(), F.col("_tainted").isNotNull()
    decided = F.when(has, F.col("_trusted.by")).when(bad, F.col("_tainted.by")).when(F.col("_lacks"), F.col("_kind")).when(F.col("_lexical"), "lexical").otherwise("none")
    rejected = bad | F.col("_lacks") | F.col("_lexical")
    return df.select(
        *claims.columns,
        F.when(has, "grounded").when(rejected, "ungrounded").otherwise("unverifiable").alias("status"),
        F.when(decided == "exact", "exact").otherwise("fuzzy").alias("method"),
        decided.alias("decided_by"),
        F.when(has, F.col("_trusted.score")).when(rejected, SCORES["none"]).otherwise(SCORES["undecided"]).alias("score"),
        F.when(has, F.col("_trusted.ids"))
        .when(bad, F.col("_tainted.ids"))
        .when(F.col("_lacks") & some, F.array_distinct(ids("_by")))
        .otherwise(_none())
        .alias("supporting_chunk_ids"),
        F.when(has, F.lit(None)).when(bad, "CLAIM_SUPPORT_LOW_TIER").when(rejected, "CLAIM_UNGROUNDED").otherwise("CLAIM_UNVERIFIABLE").alias("reason"),
        F.when(has, F.col("_trusted.said"))
        .when(bad, F.concat(F.col("_tainted.said"), F.lit(LOW_TIER)))
        .when(F.col("_lacks"), lacking)
        .when(F.col("_lexical"), F.format_string("only %d of %d content words appear anywhere in context", "_in", total))
        .otherwise(UNDECIDED)
        .alias("detail"),
    )


def ground_claims(claims: DataFrame, chunks: DataFrame, min_overlap: float = 0.34) -> DataFrame:
    """``run_id, claim_id, status, supporting_chunk_ids, method, score``: the groundings alone."""
    return assess_claims(claims, chunks, min_overlap).select("run_id", "claim_id", "status", "supporting_chunk_ids", "method", "score")


def run_verdicts(outputs: DataFrame, assessed: DataFrame, unverifiable: str = "block") -> DataFrame:
    """``outputs`` with decision and reasons of every output; an output without claims is allowed.

    ``unverifiable`` is the decision for claims that nothing confirms or refutes: block or quarantine.
    """
    if unverifiable not in ("block", "quarantine"):
        raise ValueError(f"no such decision: {unverifiable!r}")
    per = assessed.groupBy("run_id").agg(
        F.max((F.col("status") == "ungrounded").cast("int")).alias("_u"),
        F.max((F.col("status") == "unverifiable").cast("int")).alias("_v"),
        F.sort_array(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("claim_seq", "reason")))).alias("_r"),
    )
    return outputs.join(per, "run_id", "left").select(
        *outputs.columns,
        F.when(F.col("_u") == 1, "block").when(F.col("_v") == 1, unverifiable).otherwise("allow").alias("decision"),
        F.coalesce(F.col("_r.reason"), _none()).alias("reasons"),
    )


def check_grounding(outputs: DataFrame, claims: DataFrame, chunks: DataFrame, unverifiable: str = "block", min_overlap: float = 0.34) -> tuple[DataFrame, DataFrame]:
    """Assessments of given claims, and the verdicts of ``outputs``."""
    assessed = assess_claims(claims, chunks, min_overlap)
    return assessed, run_verdicts(outputs, assessed, unverifiable)


def audit_outputs(outputs: DataFrame, chunks: DataFrame, unverifiable: str = "block", min_overlap: float = 0.34) -> tuple[DataFrame, DataFrame]:
    """Assessments of the claims that ``outputs`` (run_id, output) make, and the verdicts."""
    return check_grounding(outputs, extract_claims(outputs), chunks, unverifiable, min_overlap)
