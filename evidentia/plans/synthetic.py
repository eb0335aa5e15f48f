"""A lineage graph of any size from a range: strands of source, artifacts, chunk, claim and verdict under one run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.ids import assert_tenant, content_digest, derive_id, edge_id
from evidentia.operators.ledger import EDGE_COLUMNS, node_rows

AT = "2026-01-01T00:00:00.000Z"


def perf_graph(spark: SparkSession, strands: int, depth: int, tenant: str = "perf") -> tuple[DataFrame, DataFrame]:
    """4 + strands * (depth + 4) nodes and 2 + strands * (depth + 6) edges; the graph is valid."""
    t = F.lit(assert_tenant(tenant))
    run = derive_id(t, "Run", {"runKey": F.lit("perf-run")})
    policy = derive_id(t, "Policy", {"name": F.lit("perf"), "version": F.lit("1")})
    step = derive_id(t, "Step", {"runId": run, "index": F.lit(0)})
    text = F.lit("synthetic output")
    output = derive_id(t, "Output", {"runId": run, "contentHash": content_digest(text)})
    own = {"tenant_id": t, "observed_at": F.lit(AT)}
    in_run = own | {"run_id": run}
    one = spark.range(1)
    s = spark.range(strands).withColumn("body", F.concat(F.lit("strand "), F.col("id").cast("string")))
    source = derive_id(t, "Source", {"uri": F.concat(F.lit("perf://"), F.col("id").cast("string")), "sourceKind": F.lit("retrieval")})
    artifact = lambda k: derive_id(t, "Artifact", {"runId": run, "contentHash": content_digest(F.concat(F.col("body"), F.lit(" artifact "), k.cast("string")))})
    s = s.withColumns({"source": source, "chunk": derive_id(t, "Chunk", {"runId": run, "contentHash": content_digest(F.col("body")), "ordinal": F.col("id")})})
    s = s.withColumn("claim", derive_id(t, "Claim", {"runId": run, "outputRef": output, "spanStart": F.col("id") * 10, "spanEnd": F.col("id") * 10 + 9}))
    s = s.withColumn("verdict", derive_id(t, "Verdict", {"runId": run, "targetRef": F.col("claim"), "policyRef": policy}))
    a = s.select("id", "body", "source", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("k")).withColumn("artifact", artifact(F.col("k")))
    nodes = [
        node_rows(one, "Run", **own, id=run, run_key=F.lit("perf-run"), started_at=F.lit(AT)),
        node_rows(one, "Policy", **own, id=policy, name=F.lit("perf"), version=F.lit("1"), content_hash=content_digest(F.lit("perf")), mode=F.lit("enforce")),
        node_rows(one, "Step", **in_run, id=step, step_index=F.lit(0), name=F.lit("generate"), step_kind=F.lit("generate")),
        node_rows(one, "Output", **in_run, id=output, content_hash=content_digest(text), text=text, delivered=F.lit(True)),
        node_rows(s, "Source", **own, id=F.col("source"), uri=F.concat(F.lit("perf://"), F.col("id").cast("string")), source_kind=F.lit("retrieval")),
        node_rows(a, "Artifact", **in_run, id=F.col("artifact"), content_hash=content_digest(F.concat(F.col("body"), F.lit(" artifact "), F.col("k").cast("string")))),
        node_rows(
            s, "Chunk", **in_run, id=F.col("chunk"), content_hash=content_digest(F.col("body")), ordinal=F.col("id"), text=F.col("body"), channel=F.lit("RETRIEVED_DOC"),
            tier=F.lit("T3"), retrieved_at=F.lit(AT), admitted=F.lit(True), slot=F.lit("evidence"),
        ),
        node_rows(
            s, "Claim", **in_run, id=F.col("claim"), output_ref=output, text=F.col("body"), span_start=F.col("id") * 10, span_end=F.col("id") * 10 + 9, material=F.lit(True),
        ),
        node_rows(
            s, "Verdict", **in_run, id=F.col("verdict"), target_ref=F.col("claim"), policy_ref=policy, decision=F.lit("allow"), reason_codes=F.array().cast("array<string>"),
            method=F.lit("deterministic"), monitored=F.lit(False), decided_at=F.lit(AT), input_hash=content_digest(F.col("body")),
        ),
    ]
    e = lambda df, kind, x, y: df.select(F.lit(kind).alias("type"), x.alias("from_id"), y.alias("to_id"))
    edges = [
        e(one, "PRODUCED", run, step),
        e(one, "PRODUCED", step, output),
        e(a.where("k = 0"), "PRODUCED", F.col("source"), F.col("artifact")),
        e(a.where("k > 0"), "DERIVED_FROM", F.col("artifact"), artifact(F.col("k") - 1)),
        e(s, "SPLIT_INTO", artifact(F.lit(depth - 1)), F.col("chunk")),
        e(s, "INCLUDED_IN", F.col("chunk"), step),
        e(s, "EXTRACTED_FROM", F.col("claim"), output),
        e(s, "SUPPORTED_BY", F.col("claim"), F.col("chunk")),
        e(s, "EVALUATED_BY", F.col("claim"), policy),
        e(s, "DECIDES", F.col("verdict"), F.col("claim")),
    ]
    made = reduce(DataFrame.unionByName, edges).withColumns(
        {"tenant_id": t, "schema_version": F.lit(1), "observed_at": F.lit(AT), "note": F.lit(None).cast("string")}
    )
    made = made.withColumn("id", edge_id(t, F.col("type"), F.col("from_id"), F.col("to_id")))
    return reduce(DataFrame.unionByName, nodes), made.select(*EDGE_COLUMNS)
