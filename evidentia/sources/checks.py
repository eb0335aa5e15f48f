"""Check inputs: a JSON document with chunks, an output, a slot and perhaps a policy for each run, one a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.jsonfacts import json_facts
from evidentia.operators.admit import DEFAULT_POLICY

DEFAULT_SLOT = "signals"
#: What is wrong with a document, by what is missing in it; all but the first are one code, INPUT_INVALID_CHECK.
MALFORMED = "INPUT_MALFORMED_JSON"


def _get(v: str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v), path, kind)


def _kind(v: Column) -> Column:
    """The outermost type of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), r"\A[A-Z]+", 0)


def _text(v: str, path: str) -> Column:
    """A member that is a string."""
    return F.when(_kind(F.try_variant_get(F.col(v), path, "variant")) == "STRING", _get(v, path))


def parse_checks(documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``chunks`` (run_id, ordinal, chunk_id, text, hints), ``outputs`` (run_id, slot, output, allowed_channels, min_tier) and ``rejected`` (run_id, code, error).

    ``documents`` has file and value.  A chunk is a text, or an object with text (or raw) and declared provenance.  The
    run is named by ``run_id`` or else by its file.  The slot is looked up in the document's own policy, or
    else in the default one.  A document that is rejected gives no chunks and no output.
    """
    doc = documents.select("file", json_facts(F.col("value"))["parses"].alias("ok"), F.try_parse_json("value").alias("v"))
    doc = doc.select("*", F.coalesce(_get("v", "$.run_id"), F.col("file")).alias("run_id"), _get("v", "$.chunks", "array<variant>").alias("items"))
    doc = doc.withColumns({"output": F.coalesce(_text("v", "$.output"), _text("v", "$.candidateOutput")), "slot": F.coalesce(_text("v", "$.slot"), F.lit(DEFAULT_SLOT))})
    string = lambda x, path: F.when(_kind(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    doc = doc.withColumn("texts", F.transform("items", lambda x: F.coalesce(string(x, "$"), string(x, "$.text"), string(x, "$.raw"))))
    slots = "array<struct<name: string, allowed_channels: array<string>, min_tier: string>>"
    own = _get("v", "$.policy.slots", "array<variant>")
    declared = F.transform(
        own,
        lambda x: F.struct(
            F.try_variant_get(x, "$.name", "string").alias("name"),
            F.try_variant_get(x, "$.allowedChannels", "array<string>").alias("allowed_channels"),
            F.try_variant_get(x, "$.minTier", "string").alias("min_tier"),
        ),
    ).cast(slots)
    default = F.array(*[F.struct(F.lit(n).alias("name"), F.array(*map(F.lit, c)).alias("allowed_channels"), F.lit(t).alias("min_tier")) for n, c, t in DEFAULT_POLICY]).cast(slots)
    doc = doc.withColumn("_slots", F.coalesce(declared, default))
    doc = doc.withColumn("_slot", F.get(F.filter("_slots", lambda s: s["name"] == F.col("slot")), F.lit(0)))
    kind = _kind(F.col("v"))
    doc = doc.withColumn(
        "error",
        F.when(~F.coalesce("ok", F.lit(True)) | F.col("v").isNull(), MALFORMED)
        .when(~kind.isin("OBJECT", "ARRAY"), "INPUT_NOT_AN_OBJECT")
        .when(F.col("items").isNull(), "INPUT_CHUNKS_MISSING")
        .when(F.col("output").isNull(), "INPUT_OUTPUT_MISSING")
        .when(F.exists("texts", lambda t: t.isNull()), "INPUT_CHUNK_WITHOUT_TEXT")
        .when(F.col("_slot").isNull(), "INPUT_SLOT_UNDECLARED"),
    )
    good = doc.where(F.col("error").isNull())
    outputs = good.select("run_id", "slot", "output", "_slot.allowed_channels", "_slot.min_tier")
    c = good.select("run_id", F.posexplode(F.arrays_zip("items", "texts")).alias("ordinal", "z")).select("run_id", "ordinal", F.col("z.items").alias("x"), F.col("z.texts").alias("text"))
    hint = lambda name, kind="string": _get("x", f"$.provenance.{name}", kind)
    chunks = c.select(
        "run_id", "ordinal", _get("x", "$.id").alias("chunk_id"), "text", hint("sourceId").alias("hint_source_id"), hint("channel").alias("hint_channel"), hint("tier").alias("hint_tier"),
        hint("retrievedAt").alias("hint_retrieved_at"), hint("contentHash").alias("hint_content_hash"), hint("upstreamStatus", "int").alias("hint_status"),
        hint("parentSourceId").alias("parent_source_id"),
    )
    code = F.when(F.col("error") == MALFORMED, MALFORMED).otherwise("INPUT_INVALID_CHECK").alias("code")
    return chunks, outputs, doc.where(F.col("error").isNotNull()).select("run_id", code, "error")


def read_checks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``parse_checks`` of the files at ``path``, one document each."""
    return parse_checks(spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name()))
