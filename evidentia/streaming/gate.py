"""The row-local inbound gate on a stream of chunks, and its verdicts kept once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.admit import check_slot, policy_slots
from evidentia.operators.classify import classify


def admit_stream(chunks: DataFrame, policy: list | None = None) -> DataFrame:
    """Verdicts of a stream of raw chunks; nothing is kept between batches, since the gate looks at one chunk at a time."""
    return check_slot(classify(chunks), policy_slots(chunks.sparkSession, policy))


def keep_verdicts(verdicts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append verdicts to Parquet, whose sink log makes each batch appear once; runs until the input at hand is used up."""
    rows = verdicts.select("chunk_id", "slot", "decision", "reasons", "channel", "tier", "content_hash")
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).partitionBy("slot").trigger(availableNow=True).start(path)
