"""The lineage ledger: two tables, nodes and edges, built from runs, chunks, outputs and claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.ids import assert_tenant, content_digest, derive_id, edge_id, expected_node_id, json_string
from evidentia.staging import cut

NODE_SCHEMA = (
    "tenant_id string, id string, kind string, schema_version int, observed_at string, run_id string, uri string, source_kind string, run_key string, "
    "started_at string, step_index int, name string, step_kind string, content_hash string, media_type string, byte_length int, upstream_status int, "
    "ordinal int, text string, channel string, tier string, retrieved_at string, admitted boolean, slot string, output_ref string, span_start int, "
    "span_end int, material boolean, version string, mode string, target_ref string, policy_ref string, decision string, reason_codes array<string>, "
    "method string, monitored boolean, decided_at string, input_hash string, delivered boolean"
)
NODE_COLUMNS = [c.strip().split()[0] for c in NODE_SCHEMA.split(",")]
EDGE_COLUMNS = ["tenant_id", "id", "type", "schema_version", "from_id", "to_id", "observed_at", "note"]

#: Which edge types join which kinds, which must be acyclic, and which stay within a run.
MATRIX = {
    "PRODUCED": [("Run", "Step"), ("Step", "Artifact"), ("Step", "Output"), ("Source", "Artifact")],
    "CONSUMED": [("Step", "Chunk"), ("Step", "Artifact")],
    "DERIVED_FROM": [("Artifact", "Artifact"), ("Artifact", "Source"), ("Chunk", "Chunk")],
    "SPLIT_INTO": [("Artifact", "Chunk")],
    "EXTRACTED_FROM": [("Claim", "Output")],
    "SUPPORTED_BY": [("Claim", "Chunk")],
    "CONTRADICTED_BY": [("Claim", "Chunk")],
    "EVALUATED_BY": [("Chunk", "Policy"), ("Claim", "Policy"), ("Output", "Policy")],
    "DECIDES": [("Verdict", "Chunk"), ("Verdict", "Claim"), ("Verdict", "Output")],
    "INCLUDED_IN": [("Chunk", "Step")],
}
ACYCLIC = ["DERIVED_FROM", "SPLIT_INTO"]
RUN_LOCAL = [t for t in MATRIX if t not in ("DERIVED_FROM", "EVALUATED_BY")]
SOURCE_KINDS = {"RETRIEVED_DOC": "retrieval", "TOOL_RESULT": "tool", "USER_MESSAGE": "user", "CACHE": "cache", "SYSTEM_ALERT": "system", "DIAGNOSTIC_LOG": "system"}
STEPS = [("retrieve", 0, "retrieve"), ("assemble-context", 1, "assemble"), ("generate-output", 2, "generate")]


def source_kind(channel: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SOURCE_KINDS.items() for x in kv])
    return F.coalesce(F.element_at(known, channel), F.lit("unknown"))


def node_rows(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
    """Rows of the node table; columns that are not given are null."""
    types = {c.strip().split()[0]: c.strip().split()[1] for c in NODE_SCHEMA.split(",")}
    columns |= {"kind": F.lit(kind), "schema_version": F.lit(1)}
    return df.select(*[columns.get(n, F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def strip_credentials(uri: Column) -> Column:
    """A URL without user and password; anything else as it is.

    Only a URL that had them is written anew, in the normal form of its kind: scheme and host in lower
    case, without the default port, and with a path.  Other characters of it are kept.
    """
    part = lambda i: F.regexp_extract(uri, r"(?s)\A([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)@([^/?#@]*)(.*)\z", i)
    scheme, rest = F.lower(part(1)), part(4)
    known = scheme.isin("http", "https", "ftp", "ws", "wss")
    port = F.when(scheme.isin("http", "ws"), ":80").when(scheme == "ftp", ":21").otherwise(":443")
    host = F.lower(part(3))
    host = F.when(F.endswith(host, port), F.substring(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
    host = F.regexp_replace(host, r":\z", "")
    normal = F.concat(scheme, F.lit("://"), host, F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest)))
    valid = host.rlike(r"\A(?:[^\s%:<>\[\]\\^|]+|\[[0-9A-Fa-f:.]+\])(?::[0-9]{1,5})?\z")
    return F.when(part(1) == "", uri).when(known & valid, normal).when(known, uri).otherwise(F.concat(scheme, F.lit("://"), part(3), rest))


def create_nodes(df: DataFrame, kind: str) -> DataFrame:
    """Rows of the node table with derived ids and the schema version, from identity and attribute columns of one kind."""
    for name in NODE_COLUMNS:
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None))
    if kind == "Source":
        df = df.withColumn("uri", strip_credentials(F.col("uri")))
    made = node_rows(df, kind, **{n: F.col(n) for n in NODE_COLUMNS if n not in ("id", "kind", "schema_version")})
    return made.withColumn("id", expected_node_id())


def create_edges(df: DataFrame) -> DataFrame:
    """Rows of the edge table with derived ids, from tenant_id, type, from_id, to_id, observed_at and perhaps note."""
    if "note" not in df.columns:
        df = df.withColumn("note", F.lit(None).cast("string"))
    return df.withColumns({"schema_version": F.lit(1), "id": edge_id(F.col("tenant_id"), F.col("type"), F.col("from_id"), F.col("to_id"))}).select(*EDGE_COLUMNS)


def build_graph(runs: DataFrame, chunks: DataFrame, claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables.

    ``runs``: tenant_id, run_key, started_at, observed_at, policy_name, policy_version, policy_hash, mode, output, delivered; one row a run.
    ``chunks``: run_key, ordinal, chunk_id, text, content_hash, source_uri, channel, tier, retrieved_at, status, slot, admitted, decision, reasons,
    and perhaps source_kind, which else follows from the channel; one row an ordinal.
    ``claims``: run_key, text, span_start, span_end, status, method, reason_codes, supporting_chunk_ids, material; one row a span.

    Each input is joined once with the runs, given its ids and written to the shared folder, so what is
    before it runs once for all kinds of nodes and edges.  Ids are expressions.  Only sources, policies and
    artifacts can come up more than once: of these the first by time, run and ordinal stays.  A chunk id that
    a run uses twice names the last of its chunks.
    """
    t = F.col("tenant_id")
    base = runs.withColumn("run", derive_id(t, "Run", {"runKey": F.col("run_key")}))
    base = base.withColumn("policy", derive_id(t, "Policy", {"name": F.col("policy_name"), "version": F.col("policy_version")}))
    for name, i, _ in STEPS:
        base = base.withColumn(name.split("-")[0], derive_id(t, "Step", {"runId": F.col("run"), "index": F.lit(i)}))
    base = base.withColumn("output_hash", content_digest(F.col("output")))
    base = cut(base.withColumn("out", derive_id(t, "Output", {"runId": F.col("run"), "contentHash": F.col("output_hash")})), "ledger-runs")
    keys = ["tenant_id", "run_key", "observed_at", "mode", "run", "policy", "retrieve", "assemble", "generate", "out"]
    if "source_kind" not in chunks.columns:
        chunks = chunks.withColumn("source_kind", F.lit(None).cast("string"))
    c = chunks.join(base.select(*keys), "run_key").withColumns(
        {"uri": strip_credentials(F.col("source_uri")), "skind": F.coalesce("source_kind", source_kind(F.col("channel"))), "text_hash": content_digest(F.col("text"))}
    )
    c = c.withColumns(
        {
            "source": derive_id(t, "Source", {"uri": F.col("uri"), "sourceKind": F.col("skind")}),
            "artifact": derive_id(t, "Artifact", {"runId": F.col("run"), "contentHash": F.col("content_hash")}),
            "chunk": derive_id(t, "Chunk", {"runId": F.col("run"), "contentHash": F.col("content_hash"), "ordinal": F.col("ordinal")}),
        }
    )
    c = cut(c.withColumn("verdict", derive_id(t, "Verdict", {"runId": F.col("run"), "targetRef": F.col("chunk"), "policyRef": F.col("policy")})), "ledger-chunks")
    k = claims.join(base.select(*keys), "run_key").withColumn("text_hash", content_digest(F.col("text")))
    k = k.withColumn("claim", derive_id(t, "Claim", {"runId": F.col("run"), "outputRef": F.col("out"), "spanStart": F.col("span_start"), "spanEnd": F.col("span_end")}))
    k = cut(k.withColumn("verdict", derive_id(t, "Verdict", {"runId": F.col("run"), "targetRef": F.col("claim"), "policyRef": F.col("policy")})), "ledger-claims")

    own = {"tenant_id": t, "observed_at": F.col("observed_at")}
    in_run = own | {"run_id": F.col("run")}
    monitored = F.col("mode") == "monitor"
    verdict = in_run | {"id": F.col("verdict"), "policy_ref": F.col("policy"), "monitored": monitored, "decided_at": F.col("observed_at"), "input_hash": F.col("text_hash")}
    grounded = F.when(F.col("status") == "grounded", "allow").when(F.col("status") == "unverifiable", "quarantine").otherwise("block")
    first = lambda df, id_, order: df.groupBy("tenant_id", F.col(id_)).agg(F.min_by(F.struct(*[x for x in df.columns if x not in ("tenant_id", id_)]), F.struct(*order)).alias("_f")).select("tenant_id", id_, "_f.*")
    policies = first(base.select("tenant_id", "policy", "observed_at", "run_key", "policy_name", "policy_version", "policy_hash", "mode"), "policy", ["observed_at", "run_key"])
    by_time = ["observed_at", "run_key", "ordinal"]
    sources = first(c.select("tenant_id", "source", "observed_at", "run_key", "ordinal", "uri", "skind"), "source", by_time)
    artifacts = first(c.select("tenant_id", "artifact", "observed_at", "run_key", "ordinal", "run", "content_hash", "status"), "artifact", by_time)
    nodes = [
        node_rows(base, "Run", **own, id=F.col("run"), run_key=F.col("run_key"), started_at=F.col("started_at")),
        node_rows(policies, "Policy", **own, id=F.col("policy"), name=F.col("policy_name"), version=F.col("policy_version"), content_hash=F.col("policy_hash"), mode=F.col("mode")),
        *[node_rows(base, "Step", **in_run, id=F.col(n.split("-")[0]), step_index=F.lit(i), name=F.lit(n), step_kind=F.lit(kind)) for n, i, kind in STEPS],
        node_rows(sources, "Source", **own, id=F.col("source"), uri=F.col("uri"), source_kind=F.col("skind")),
        node_rows(artifacts, "Artifact", **in_run, id=F.col("artifact"), content_hash=F.col("content_hash"), upstream_status=F.col("status")),
        node_rows(
            c, "Chunk", **in_run, id=F.col("chunk"), content_hash=F.col("content_hash"), ordinal=F.col("ordinal"), text=F.col("text"), channel=F.col("channel"),
            tier=F.col("tier"), retrieved_at=F.col("retrieved_at"), admitted=F.col("admitted"), slot=F.col("slot"), upstream_status=F.col("status"),
        ),
        node_rows(
            c.where(F.col("decision").isNotNull()), "Verdict", **verdict, target_ref=F.col("chunk"), decision=F.col("decision"), reason_codes=F.col("reasons"),
            method=F.lit("deterministic"),
        ),
        node_rows(base, "Output", **in_run, id=F.col("out"), content_hash=F.col("output_hash"), text=F.col("output"), delivered=F.col("delivered")),
        node_rows(
            k, "Claim", **in_run, id=F.col("claim"), output_ref=F.col("out"), text=F.col("text"), span_start=F.col("span_start"), span_end=F.col("span_end"),
            material=F.col("material"),
        ),
        node_rows(
            k, "Verdict", **verdict, target_ref=F.col("claim"), decision=grounded, reason_codes=F.col("reason_codes"),
            method=F.when(F.col("method") == "judge", "judge").otherwise("deterministic"),
        ),
    ]

    e = lambda kind, a, b, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("type"), F.col(a).alias("from_id"), F.col(b).alias("to_id")))
    every = lambda df, *made: df.select("tenant_id", "observed_at", F.explode(F.array_compact(F.array(*made))).alias("e")).select("tenant_id", "e.*", "observed_at")
    support = k.select("tenant_id", "run_key", "observed_at", "claim", F.explode("supporting_chunk_ids").alias("chunk_id"))
    support = support.join(c.groupBy("run_key", "chunk_id").agg(F.max_by("chunk", "ordinal").alias("chunk")), ["run_key", "chunk_id"])
    decided = F.col("decision").isNotNull()
    edges = [
        every(base, *[e("PRODUCED", "run", n) for n in ("retrieve", "assemble", "generate")], e("PRODUCED", "generate", "out"), e("EVALUATED_BY", "out", "policy")),
        every(c, e("PRODUCED", "source", "artifact"), e("PRODUCED", "retrieve", "artifact")).distinct(),
        every(
            c, e("SPLIT_INTO", "artifact", "chunk"), e("EVALUATED_BY", "chunk", "policy"), e("CONSUMED", "assemble", "chunk", F.col("admitted")),
            e("INCLUDED_IN", "chunk", "assemble", F.col("admitted")), e("DECIDES", "verdict", "chunk", decided),
        ),
        every(k, e("EXTRACTED_FROM", "claim", "out"), e("EVALUATED_BY", "claim", "policy"), e("DECIDES", "verdict", "claim")),
        support.select("tenant_id", F.lit("SUPPORTED_BY").alias("type"), F.col("claim").alias("from_id"), F.col("chunk").alias("to_id"), "observed_at").distinct(),
    ]
    return reduce(DataFrame.unionByName, nodes), create_edges(reduce(DataFrame.unionByName, edges))


def run_audit(
    outputs: DataFrame, checked: DataFrame, assessed: DataFrame, outcomes: DataFrame, tenant: str = "local", observed_at: str = "1970-01-01T00:00:00.000Z",
    mode: str = "enforce", policy_version: str = "1", with_hashes: bool = True, policy_hash: str | None = None, policy_name: str = "default",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``runs, chunks, claims`` for ``build_graph`` from what both gates said of runs.

    ``outputs`` has run_id, slot and output, ``checked`` the chunks as ``check_slot`` returns them, ``assessed``
    the claims, and ``outcomes`` run_id and would_block.  A run is named by the digest of its output, its slot
    and its chunks in order (id and content hash; ids alone without ``with_hashes``).  In the mode monitor
    every output is delivered.  All claims are material: extraction leaves out what asserts nothing.
    """
    assert_tenant(tenant)
    pair = F.concat(F.lit("["), json_string(F.col("chunk_id")), F.lit(","), json_string(F.col("content_hash")), F.lit("]")) if with_hashes else json_string(F.col("chunk_id"))
    listed = checked.groupBy("run_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", pair.alias("p")))), lambda x: x["p"]), ",").alias("_chunks"))
    document = F.concat(F.lit("["), json_string(F.col("output")), F.lit(","), json_string(F.col("slot")), F.lit(",["), F.coalesce("_chunks", F.lit("")), F.lit("]]"))
    runs = outputs.select("run_id", "slot", "output").join(listed, "run_id", "left").join(outcomes.select("run_id", "would_block"), "run_id").withColumn("run_key", content_digest(document))
    runs = cut(runs.drop("_chunks"), "audit-runs")
    named = runs.groupBy("run_key").agg(F.min("run_id").alias("run_id"))  # equal runs are one run
    runs = runs.join(named.select("run_id"), "run_id", "left_semi")
    whole = runs.select(
        F.lit(tenant).alias("tenant_id"), "run_id", "run_key", F.lit(observed_at).alias("started_at"), F.lit(observed_at).alias("observed_at"), F.lit(policy_name).alias("policy_name"),
        F.lit(policy_version).alias("policy_version"), (F.lit(policy_hash) if policy_hash else content_digest(F.concat(F.lit("slot-policy:"), "slot"))).alias("policy_hash"),
        F.lit(mode).alias("mode"), "output", (~F.col("would_block") | F.lit(mode == "monitor")).alias("delivered"),
    )
    chunks = checked.join(named, "run_id").select(
        "run_key", "ordinal", "chunk_id", "text", "content_hash", F.col("source_id").alias("source_uri"), "channel", "tier", "retrieved_at", "status", "slot",
        (F.col("decision") == "allow").alias("admitted"), "decision", F.col("reasons.code").alias("reasons"),
    )
    made = assessed.join(named, "run_id").select(
        "run_key", "text", "span_start", "span_end", "status", "method", F.array_compact(F.array("reason")).alias("reason_codes"), "supporting_chunk_ids", F.lit(True).alias("material"),
    )
    return whole, chunks, made


def redact(nodes: DataFrame) -> DataFrame:
    """Texts of chunks, claims and outputs replaced by a mark."""
    return nodes.withColumn("text", F.when(F.col("kind").isin("Chunk", "Claim", "Output"), F.lit("[redacted]")).otherwise(F.col("text")))


def adjacency(edges: DataFrame, steps: dict[str, str]) -> DataFrame:
    """``tenant_id, src, dst, edge_id`` along ``steps``: type to ``out`` (from, to) or ``in`` (to, from)."""
    outward = [t for t, d in steps.items() if d == "out"]
    inward = [t for t, d in steps.items() if d == "in"]
    go = lambda a, b, types: edges.where(F.col("type").isin(types)).select("tenant_id", F.col(a).alias("src"), F.col(b).alias("dst"), F.col("id").alias("edge_id"))
    return go("from_id", "to_id", outward).unionByName(go("to_id", "from_id", inward))


BACKWARD = {"EXTRACTED_FROM": "in", "SUPPORTED_BY": "out", "SPLIT_INTO": "in", "DERIVED_FROM": "out", "PRODUCED": "in"}
FORWARD = {"PRODUCED": "out", "SPLIT_INTO": "out", "DERIVED_FROM": "in", "SUPPORTED_BY": "in", "EXTRACTED_FROM": "out"}
