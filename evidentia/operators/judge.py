"""A judge's advice on claims that no deterministic check decides: from fixtures or from a hook of the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.ids import json_string

#: The fixture that is known by its key.
FIXTURES = [("sha256:20be4d8a2ac355137c72bfd66b26569a9c7825a39e2f00381fcf96a82a60e392", "ungrounded", [], 0.0)]
FIXTURE_SCHEMA = "key string, judge_status string, judge_ids array<string>, judge_score double"
ADVICE = "run_id string, claim_id string, judge_status string, judge_ids array<string>, judge_score double, judge_error string"
STATUSES = ["grounded", "ungrounded", "unverifiable"]
UNSUPPORTED = "judge assessed this claim as unsupported by context"
UNUSABLE = "judge returned an unusable result"

Judge = Callable[[DataFrame, DataFrame], DataFrame]


def _chunk_json() -> Column:
    text = lambda name, c: F.concat(F.lit(f'"{name}":'), json_string(F.col(c)))
    parent = F.when(F.col("parent_source_id").isNotNull(), text("parentSourceId", "parent_source_id"))
    provenance = F.concat_ws(
        ",", text("sourceId", "source_id"), text("channel", "channel"), text("tier", "tier"), text("retrievedAt", "retrieved_at"), text("contentHash", "content_hash"),
        F.when(F.col("status").isNotNull(), F.concat(F.lit('"upstreamStatus":'), F.col("status").cast("string"))), parent,
    )
    return F.concat(F.lit("{"), text("id", "chunk_id"), F.lit(","), text("text", "text"), F.lit(',"provenance":{'), provenance, F.lit("}}"))


def fixture_keys(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """``run_id, claim_id, key``: the digest of a claim's text and span and of all chunks of its run, by id.

    Only runs of ``claims`` have their chunks gathered; a key names the whole context of a run, so its chunks meet in one row.
    """
    if "parent_source_id" not in chunks.columns:
        chunks = chunks.withColumn("parent_source_id", F.lit(None).cast("string"))
    own = chunks.join(claims.select("run_id").distinct(), "run_id", "left_semi")
    context = own.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_id", "ordinal", _chunk_json().alias("j")))), lambda x: x["j"]), ",").alias("_c"))
    span = lambda c: F.col(c).cast("string")
    head = F.concat(F.lit('{"claim":{"text":'), json_string(F.col("text")), F.lit(',"spanStart":'), span("span_start"), F.lit(',"spanEnd":'), span("span_end"), F.lit('},"chunks":['))
    whole = F.concat(head, F.coalesce("_c", F.lit("")), F.lit("]}"))
    return claims.join(context, "run_id", "left").select("run_id", "claim_id", F.concat(F.lit("sha256:"), F.sha2(whole, 256)).alias("key"))


def fixture_judge(fixtures: list[tuple] | None = None) -> Judge:
    """A judge that repeats what is on record under a claim's key, and else cannot tell."""
    known = FIXTURES if fixtures is None else fixtures

    def judge(asked: DataFrame, chunks: DataFrame) -> DataFrame:
        table = asked.sparkSession.createDataFrame(known, FIXTURE_SCHEMA)
        found = fixture_keys(asked, chunks).join(F.broadcast(table), "key", "left")  # the fixtures are a literal list
        return found.select(
            "run_id", "claim_id", F.coalesce("judge_status", F.lit("unverifiable")).alias("judge_status"), F.coalesce("judge_ids", F.array().cast("array<string>")).alias("judge_ids"),
            F.coalesce("judge_score", F.lit(0.0)).alias("judge_score"), F.lit(None).cast("string").alias("judge_error"),
        )

    return judge


def live_judge(hook: Callable[[dict, list[dict]], dict] | None) -> Judge:
    """A judge that asks ``hook`` with a claim and the chunks of its run; what it raises or answers wrongly is kept as an error."""
    if hook is None:
        raise ValueError("a live judge needs a hook")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                claim = {"id": r.claim_id, "text": r.text, "span_start": r.span_start, "span_end": r.span_end}
                try:
                    said = hook(claim, [dict(c) if isinstance(c, dict) else c.asDict() for c in r.context])
                    status = said.get("status") if isinstance(said, dict) else None
                    if status not in STATUSES:
                        raise ValueError(UNUSABLE)
                    ids, score = said.get("supporting_chunk_ids"), said.get("score")
                    rows.append((r.run_id, r.claim_id, status, list(ids) if isinstance(ids, list) else [], float(score) if isinstance(score, (int, float)) else 0.0, None))
                except Exception as e:  # whatever a hook does, the deterministic verdict stands
                    rows.append((r.run_id, r.claim_id, None, [], 0.0, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ADVICE.split(", ")])

    def judge(asked: DataFrame, chunks: DataFrame) -> DataFrame:
        own = chunks.join(asked.select("run_id").distinct(), "run_id", "left_semi")
        context = own.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id", "text", "channel", "tier"))).alias("context"))
        empty = F.array().cast(context.schema["context"].dataType)
        both = asked.select("run_id", "claim_id", "text", "span_start", "span_end").join(context, "run_id", "left").withColumn("context", F.coalesce("context", empty))
        return both.mapInPandas(ask, ADVICE)

    return judge


def create_judge(mode: str = "fixture", fixtures: list[tuple] | None = None, hook: Callable | None = None) -> Judge:
    if mode not in ("fixture", "live"):
        raise ValueError(f"no such mode: {mode!r}")
    return live_judge(hook) if mode == "live" else fixture_judge(fixtures)


def escalate(assessed: DataFrame, judged: DataFrame) -> DataFrame:
    """``assessed`` after a judge: only what is unverifiable is asked, and only its 'ungrounded' counts.

    ``judged`` has the columns of ADVICE.  ``advisory`` holds what the judge said and whether it was applied; an error, an
    unknown status or a missing answer leaves the verdict as it was.
    """
    j = judged.select(*[c.split()[0] for c in ADVICE.split(", ")])
    asked = F.col("status") == "unverifiable"
    usable = F.col("judge_error").isNull() & F.coalesce(F.col("judge_status").isin(STATUSES), F.lit(False))
    down = asked & usable & (F.col("judge_status") == "ungrounded")
    error = F.when(~usable, F.coalesce("judge_error", F.lit(UNUSABLE)))
    none = F.array().cast("array<string>")
    advisory = F.struct(
        F.when(usable, F.col("judge_status")).otherwise("unverifiable").alias("status"), F.when(usable, F.coalesce("judge_ids", none)).otherwise(none).alias("supporting_chunk_ids"),
        F.when(usable, F.coalesce("judge_score", F.lit(0.0))).otherwise(0.0).alias("score"), down.alias("applied"), error.alias("error"),
    )
    new = {
        "advisory": F.when(asked, advisory),
        "supporting_chunk_ids": F.when(down, F.coalesce("judge_ids", none)).otherwise(F.col("supporting_chunk_ids")),
        "method": F.when(down, "judge").otherwise(F.col("method")),
        "decided_by": F.when(down, "judge").otherwise(F.col("decided_by")),
        "score": F.when(down, 0.0).otherwise(F.col("score")),
        "reason": F.when(down, "CLAIM_UNGROUNDED").otherwise(F.col("reason")),
        "detail": F.when(down, UNSUPPORTED).otherwise(F.col("detail")),
        "status": F.when(down, "ungrounded").otherwise(F.col("status")),
    }
    return assessed.join(j, ["run_id", "claim_id"], "left").withColumns(new).drop("judge_status", "judge_ids", "judge_score", "judge_error")


def ask(assessed: DataFrame, chunks: DataFrame, judge: Judge) -> DataFrame:
    """``assessed`` after ``judge`` was asked about what is unverifiable."""
    return escalate(assessed, judge(assessed.where("status = 'unverifiable'"), chunks))
