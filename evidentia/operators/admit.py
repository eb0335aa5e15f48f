"""Admission of classified chunks to slots, with ordered reasons."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.classify import is_ok, is_suspicious, rank, signature

#: The default policy.
DEFAULT_POLICY = [
    ("signals", ["USER_MESSAGE", "RETRIEVED_DOC", "TOOL_RESULT", "AGENT_OUTPUT"], "T3"),
    ("evidence", ["RETRIEVED_DOC", "TOOL_RESULT"], "T3"),
    ("working_memory", ["USER_MESSAGE", "RETRIEVED_DOC", "TOOL_RESULT", "AGENT_OUTPUT"], "T3"),
]
Policy = list[tuple[str, list[str], str]]
DATA_CHANNELS = ["USER_MESSAGE", "RETRIEVED_DOC", "TOOL_RESULT", "AGENT_OUTPUT"]


class PolicyError(ValueError):
    """A slot that the policy does not declare."""


def policy_slots(spark: SparkSession, policy: Policy | None = None) -> DataFrame:
    return spark.createDataFrame(DEFAULT_POLICY if policy is None else policy, "slot string, allowed_channels array<string>, min_tier string")


def resolve_slot(slot: str, policy: Policy | None = None) -> tuple[str, list[str], str]:
    for row in DEFAULT_POLICY if policy is None else policy:
        if row[0] == slot:
            return row
    raise PolicyError(f"the policy declares no slot {slot!r}")


def policy_json(policy: Policy | None = None) -> str:
    """The policy as the compact JSON document that its digest is taken of."""
    slots = [{"name": name, "allowedChannels": channels, "minTier": tier} for name, channels, tier in (DEFAULT_POLICY if policy is None else policy)]
    return json.dumps({"slots": slots, "defaultRule": {"decision": "deny", "appliesWhen": "no_slot_match"}}, separators=(",", ":"), ensure_ascii=False)


def _reason(when: Column, code: str, message: Column) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))


def payload_reasons() -> list[Column]:
    status = F.col("status")
    return [
        _reason(F.col("_empty"), "PAYLOAD_EMPTY", F.lit("Payload is empty or whitespace-only.")),
        _reason(F.col("_truncated"), "PAYLOAD_TRUNCATED", F.lit("Payload appears to be truncated JSON.")),
        _reason(status.isNotNull() & ~is_ok(status), "UPSTREAM_STATUS_NOT_OK", F.format_string("Upstream status %s is not a 2xx status.", status.cast("string"))),
    ]


def label_reasons() -> list[Column]:
    """Reasons why a label disagrees with its payload, whose signature is taken with the status that the label declares."""
    sig, ok = F.col("signature"), is_ok(F.col("status"))
    data = F.col("channel").isin(DATA_CHANNELS) & (rank(F.col("tier")) <= 3)
    said = F.when(ok, F.format_string("status %s", F.col("status").cast("string"))).otherwise(F.format_string("channel %s at tier %s", "channel", "tier"))
    return [
        _reason(is_suspicious(sig) & (ok | data), "PROVENANCE_LABEL_MISMATCH", F.concat(F.lit("Payload is classified "), sig, F.lit(" but declares "), said, F.lit("."))),
        _reason(sig == "degraded_result", "RESULT_DEGRADED", F.lit("Payload reports success while carrying a fallback or placeholder result.")),
    ]


def check_slot(classified: DataFrame, slots: DataFrame | None) -> DataFrame:
    """A row for each slot and chunk with ``decision`` and ordered ``reasons``; slots are a handful of policy rows.

    Chunks that have a column slot are checked for that one; where they bring slot, allowed_channels and min_tier, as runs with
    policies of their own do, ``slots`` is None.

    ``classified`` comes from ``classify``, or from ``prepare`` with channel, tier and status set by hand: then
    it has no signature yet.  ``classify`` judged by the very status that it stores, so its signature holds.
    """
    df = classified if "signature" in classified.columns else classified.withColumn("signature", signature(F.col("status")))
    df = df.withColumn("_own", F.array(*payload_reasons(), *label_reasons()))
    if slots is not None:
        df = df.crossJoin(F.broadcast(slots)) if "slot" not in df.columns else df.join(F.broadcast(slots), "slot")
    channel = _reason(~F.array_contains("allowed_channels", F.col("channel")), "CHANNEL_NOT_PERMITTED", F.format_string("Channel %s is not permitted in slot %s.", "channel", "slot"))
    tier = _reason(
        rank(F.col("tier")) > rank(F.col("min_tier")), "TIER_BELOW_MINIMUM", F.format_string("Tier %s is below minimum %s for slot %s.", "tier", "min_tier", "slot")
    )
    df = df.withColumn("reasons", F.array_compact(F.concat(F.col("_own"), F.array(channel, tier))))
    return df.withColumn("decision", F.when(F.size("reasons") == 0, "allow").otherwise("block")).drop("_own")


def assemble_context(checked: DataFrame, slots: DataFrame) -> DataFrame:
    """``run_id, slot, admitted`` (chunk ids by ordinal); a slot that admits nothing has an empty array."""
    runs = checked.select("run_id").distinct().crossJoin(F.broadcast(slots.select("slot")))
    own = checked.where("decision = 'allow'").groupBy("run_id", "slot").agg(F.sort_array(F.collect_list(F.struct("ordinal", "chunk_id"))).alias("_a"))
    return runs.join(own, ["run_id", "slot"], "left").select("run_id", "slot", F.coalesce(F.col("_a.chunk_id"), F.array().cast("array<string>")).alias("admitted"))
