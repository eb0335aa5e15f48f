"""Inputs of the engine's queries, made from the driver's tables.

The tables hold almost no errors, JSON or traces, so every document is put whole into one of sixteen
shapes by its id, and every conversation's output gets some lines that claims are made of.  ``oracles`` has the same
shapes in SQL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.ids import content_digest, derive_id
from evidentia.operators import admit, classify, ground, ledger, outcome
from evidentia.operators.claims import extract_claims
from evidentia.staging import cut

CHANNELS = ["USER_MESSAGE", "RETRIEVED_DOC", "TOOL_RESULT", "SYSTEM_ALERT", "DIAGNOSTIC_LOG", "AGENT_OUTPUT", "CACHE", "UNLABELED"]
AT = "2026-01-01T00:00:00.000Z"
#: Before and after a document's text, by ``doc_id % 16``; ``#`` is the id, and in a shape that begins like JSON the text is escaped.
SHAPES = [
    ("", ""), ("HTTP/1.1 503 Service Unavailable\nserver: edge\n", ""), ('{"id": #, "status": 200, "body": "', '"}'), ('{"id": #, "items": [1, "', '", 2'),
    ('{"id": #, "note": "fallback", "body": "', '"}'), ("Traceback (most recent call last):\n", ""), ("bash: run: command not found\n", ""), ("502 Bad Gateway\n", ""),
    ("<html><head><title>404 Not Found</title></head><body>", "</body></html>"), ("Content-Type: text/plain\n", ""),
    ("date: today\nfailed timeout error refused denied\n", ""), ('{"error": {"code": 429.0, "message": "', '"}}'),
    ('{"response": {"status": 500}, "error": null, "body": "', '"}'), ("stale partial results\n", ""), ("", "\n    at run (app.js:10:5)"), ("", " and so on ..."),
]
#: Lines after the turns of an output; ``#`` is the conversation's id and ``@`` the text of its first other turn.
LINES = [
    "- @",
    "> 1. Office ledger 7: Smith paid 1,024 euros on day #.",
    "We chose plan B! The team agreed on it etc... The rest follows. Costs rose 3.5 percent in v1.2.3.",
    "| One cell here today | This might be so. | Is it so now? |",
    "|---|---|",
    "```",
    "Hidden words stand in a block here.",
    "```",
    "THE SECOND ledger says smith PAID 1024 euros",
    "Payment of 1024 euros went to Smith and Jones.",
    "payments made by office order are listed there",
    "some other matter was brought forward by nobody",
    "\U0001f600 After it nothing else was said.",
]
LEDGER = "Office ledger 7: Smith paid 1,024 euros on day #. The second ledger says: Smith paid 1024 euros. Payments are made by office order and listed."


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def escaped(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def varied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of ``documents``, each whole in one of the shapes, and beside every sixteenth an empty one (part 1)."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    k, text = i % 16, F.coalesce("text", F.lit(""))
    shaped = F.lit("")
    for n, (before, after) in enumerate(SHAPES):
        body = escaped(text) if before.startswith("{") else text
        shaped = F.when(k == n, F.concat(F.replace(F.lit(before), F.lit("#"), i.cast("string")), body, F.lit(after))).otherwise(shaped)
    j = F.floor(i / 16)
    rows = d.select(
        i,
        F.concat(F.lit("store:"), "source").alias("hint_source_id"),
        F.element_at(F.array(*map(F.lit, CHANNELS)), (j % 8 + 1).cast("int")).alias("hint_channel"),
        F.when(i % 5 != 4, F.concat(F.lit("T"), (i % 5 + 1).cast("string"))).alias("hint_tier"),
        F.when(i % 7 == 0, 200).when(i % 7 == 1, 404).alias("hint_status"),
        F.posexplode(F.when(k == 0, F.array(shaped, F.lit(" \n"))).otherwise(F.array(shaped))).alias("part", "text"),
    )
    return rows


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.classify(varied(spark, sf_dir))


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Outputs (run_id, slot, output) and chunks of the conversations.

    Assistant turns and LINES are the candidate output; the other turns and an office ledger, whose channel,
    tier and status go by the id, are its context.
    """
    c = table(spark, sf_dir, "conversations").withColumn("run_id", F.col("conv_id").cast("string"))
    spoken = F.col("role") == "assistant"
    say = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(spoken, F.struct("turn", "text")))), lambda x: x["text"]), "\n")
    whole = c.groupBy("run_id").agg(say.alias("_say"), F.coalesce(F.min_by(F.when(~spoken, F.col("text")), F.when(~spoken, F.col("turn"))), F.lit("")).alias("_first"))
    added = F.replace(F.replace(F.lit("\n".join(LINES)), F.lit("#"), F.col("run_id")), F.lit("@"), F.col("_first"))
    outputs = whole.select("run_id", F.lit("signals").alias("slot"), F.concat("_say", F.lit("\n"), added).alias("output"))
    channel = F.when(F.col("role") == "system", "SYSTEM_ALERT").otherwise("USER_MESSAGE")
    turns = c.where(~spoken).select("run_id", F.col("turn").cast("int").alias("ordinal"), "text", channel.alias("hint_channel"), F.lit("T1").alias("hint_tier"), F.lit(None).cast("int").alias("hint_status"))
    k = F.col("run_id").cast("long") % 4
    pick = lambda *values: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    office = whole.select(
        "run_id", F.lit(1000).alias("ordinal"), F.replace(F.lit(LEDGER), F.lit("#"), F.col("run_id")).alias("text"),
        pick("RETRIEVED_DOC", "TOOL_RESULT", "CACHE", "RETRIEVED_DOC").alias("hint_channel"), pick("T3", "T2", "T4", "T1").alias("hint_tier"),
        F.when(k == 1, 200).when(k == 3, 404).alias("hint_status"),
    )
    return outputs, turns.unionByName(office).withColumn("hint_source_id", F.concat(F.lit("conversation:"), "run_id"))


def audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outputs, checked chunks and assessed claims of the conversations; the latter two are cut, as several plans read them."""
    outputs, raw = runs(spark, sf_dir)
    checked = cut(admit.check_slot(classify.classify(raw), admit.policy_slots(spark, [admit.resolve_slot("signals")])).drop("_json", "_low"), "audited-chunks", keep=True)
    found = extract_claims(outputs)
    return outputs, checked, cut(ground.assess_claims(found, checked.where("decision = 'allow'")), "audited-claims", keep=True)


def lineage(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The ledger of all conversations."""
    outputs, checked, assessed = audited(spark, sf_dir)
    outcomes = outcome.run_outcomes(checked, ground.run_verdicts(outputs, assessed))
    return ledger.build_graph(*ledger.run_audit(outputs, checked, assessed, outcomes, observed_at=AT))


def count_of(spark: SparkSession, sf_dir: str) -> int:
    """How many strands the made graphs have: one for each supplier."""
    return table(spark, sf_dir, "supplier").count()


def damaged(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """``n`` small lineages, each with one thing wrong or nearly wrong by its number mod 20; 0 is sound.

    1 a tier that is none, 2 the chunk missing, 3 the output missing, 4 an edge the wrong way round, 5 a claim of another tenant, 6 support from
    another run, 7 an artifact from itself, 8 a ring of three artifacts, 9 support by a refused chunk, 10 a delivered claim that rests on nothing, 11 the policy
    missing, 12 an altered chunk, 13 two chunks with one id.  Nearly wrong: 14 derived from another run's artifact, 15 not material,
    16 not delivered, 17 excused by a verdict, 18 a monitored block without support, 19 a monitored block of an admitted chunk.
    """
    s = spark.range(n).select(F.col("id").alias("i"), (F.col("id") % 20).alias("m"), F.lit("acme").alias("tenant_id"), F.lit(AT).alias("observed_at"))
    m, text = F.col("m"), F.concat(F.lit("Line "), F.col("i").cast("string"), F.lit(" grew 12% in May."))
    tag = lambda word, c=F.col("i"): F.concat(F.lit(f"sha256:{word}-"), c.cast("string"))
    t, run_key = F.col("tenant_id"), F.concat(F.lit("run-"), F.col("i").cast("string"))
    ids = lambda i: derive_id(t, "Run", {"runKey": F.concat(F.lit("run-"), i.cast("string"))})
    artifact_of = lambda i, k=0: derive_id(t, "Artifact", {"runId": ids(i), "contentHash": F.concat(F.lit(f"sha256:artifact{k}-"), i.cast("string"))})
    chunk_of = lambda i: derive_id(t, "Chunk", {"runId": ids(i), "contentHash": F.concat(F.lit("sha256:chunk-"), i.cast("string")), "ordinal": F.lit(0)})
    s = s.withColumns({"run_id": ids(F.col("i")), "base": F.col("i") - m})
    s = s.withColumns(
        {
            "policy": derive_id(t, "Policy", {"name": F.concat(F.lit("p"), F.col("i").cast("string")), "version": F.lit("1")}),
            "source": derive_id(t, "Source", {"uri": F.concat(F.lit("store://"), F.col("i").cast("string")), "sourceKind": F.lit("retrieval")}),
            "step": derive_id(t, "Step", {"runId": F.col("run_id"), "index": F.lit(0)}), "artifact": artifact_of(F.col("i")), "chunk": chunk_of(F.col("i")),
            "out": derive_id(t, "Output", {"runId": F.col("run_id"), "contentHash": tag("output")}),
        }
    )
    claim = lambda tenant: derive_id(tenant, "Claim", {"runId": F.col("run_id"), "outputRef": F.col("out"), "spanStart": F.lit(0), "spanEnd": F.lit(9)})
    s = s.withColumns({"claim": claim(t), "stranger": claim(F.lit("globex"))})
    decided = lambda target: derive_id(t, "Verdict", {"runId": F.col("run_id"), "targetRef": target, "policyRef": F.col("policy")})
    s = cut(s.withColumns({"verdict": decided(F.col("claim")), "second": decided(F.col("chunk"))}), "damaged")
    i = F.col("i")
    own = {"tenant_id": F.col("tenant_id"), "observed_at": F.col("observed_at")}
    inside = own | {"run_id": F.col("run_id")}
    none = F.array().cast("array<string>")
    no_support = m.isin(10, 15, 16, 17, 18)
    verdict = inside | {"policy_ref": F.col("policy"), "reason_codes": none, "method": F.lit("deterministic"), "decided_at": F.lit(AT), "input_hash": tag("input", i)}
    claimed = inside | {"output_ref": F.col("out"), "text": text, "span_start": F.lit(0), "span_end": F.lit(9), "material": m != 15}
    chunk = inside | {
        "id": F.col("chunk"), "content_hash": F.when(m == 12, "sha256:altered").otherwise(tag("chunk", i)), "ordinal": F.lit(0), "channel": F.lit("RETRIEVED_DOC"),
        "tier": F.when(m == 1, "T9").otherwise("T3"), "retrieved_at": F.lit(AT), "admitted": m != 9, "slot": F.lit("evidence"),
    }
    rows = ledger.node_rows
    ring = s.where("m = 8").select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    nodes = [
        rows(s, "Run", **own, id=F.col("run_id"), run_key=run_key, started_at=F.lit(AT)),
        rows(s.where(m != 11), "Policy", **own, id=F.col("policy"), name=F.concat(F.lit("p"), i.cast("string")), version=F.lit("1"), content_hash=F.lit("sha256:p"), mode=F.lit("enforce")),
        rows(s, "Source", **own, id=F.col("source"), uri=F.concat(F.lit("store://"), i.cast("string")), source_kind=F.lit("retrieval")),
        rows(s, "Step", **inside, id=F.col("step"), step_index=F.lit(0), name=F.lit("retrieve"), step_kind=F.lit("retrieve")),
        rows(s, "Artifact", **inside, id=F.col("artifact"), content_hash=tag("artifact0", i)),
        rows(
            ring, "Artifact", **inside, id=F.when(F.col("k") == 1, artifact_of(i, 1)).otherwise(artifact_of(i, 2)),
            content_hash=F.concat(F.lit("sha256:artifact"), F.col("k").cast("string"), F.lit("-"), i.cast("string")),
        ),
        rows(s.where(m != 2), "Chunk", **chunk, text=text), rows(s.where(m == 13), "Chunk", **chunk, text=F.lit("A different body.")),
        rows(s.where(m != 3), "Output", **inside, id=F.col("out"), content_hash=tag("output", i), text=text, delivered=m != 16),
        rows(s, "Claim", **claimed, id=F.col("claim")), rows(s.where(m == 5), "Claim", **(claimed | {"tenant_id": F.lit("globex")}), id=F.col("stranger")),
        rows(
            s.where(~m.isin(10, 15, 16)), "Verdict", **verdict, id=F.col("verdict"), target_ref=F.col("claim"), decision=F.when(m == 18, "block").otherwise("allow"),
            monitored=m == 18,
        ),
        rows(s.where(m == 19), "Verdict", **verdict, id=F.col("second"), target_ref=F.col("chunk"), decision=F.lit("block"), monitored=F.lit(True)),
    ]
    e = lambda kind, a, b, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id")))
    c = F.col
    made = F.array_compact(
        F.array(
            e("PRODUCED", c("run_id"), c("step")), e("PRODUCED", c("step"), c("artifact")), e("PRODUCED", c("source"), c("artifact")), e("DERIVED_FROM", c("artifact"), c("source")),
            e("SPLIT_INTO", c("artifact"), c("chunk")), e("INCLUDED_IN", c("chunk"), c("step")), e("CONSUMED", c("step"), c("chunk")), e("PRODUCED", c("step"), c("out"), m != 3),
            e("EXTRACTED_FROM", c("claim"), c("out"), m != 3), e("SUPPORTED_BY", c("claim"), c("chunk"), ~no_support & (m != 6)), e("EVALUATED_BY", c("claim"), c("policy"), m != 11),
            e("DECIDES", c("verdict"), c("claim"), ~m.isin(10, 15, 16)), e("SUPPORTED_BY", c("chunk"), c("claim"), m == 4), e("SUPPORTED_BY", c("stranger"), c("chunk"), m == 5),
            e("SUPPORTED_BY", c("claim"), chunk_of(c("base")), m == 6), e("DERIVED_FROM", c("artifact"), c("artifact"), m == 7),
            e("DERIVED_FROM", c("artifact"), artifact_of(i, 1), m == 8), e("DERIVED_FROM", artifact_of(i, 1), artifact_of(i, 2), m == 8), e("DERIVED_FROM", artifact_of(i, 2), c("artifact"), m == 8),
            e("DERIVED_FROM", c("artifact"), artifact_of(c("base")), m == 14),
        )
    )
    edges = s.select("tenant_id", "observed_at", F.explode(made).alias("e")).select("tenant_id", "e.*", "observed_at")
    return reduce(DataFrame.unionByName, nodes).select(ledger.NODE_COLUMNS), ledger.create_edges(edges.select("tenant_id", "type", "from_id", "to_id", "observed_at"))


def braid(spark: SparkSession, n: int) -> tuple[DataFrame, DataFrame]:
    """``n`` strands with a diamond each, five to a run: sources are shared by every seventh, and a claim also rests on the next strand's chunk.

    Ids are plain names, since traversals do not look into them: s<source>, a<strand>.<0-3>, c<strand>, k<strand>, v<strand>, o<run>, r<run>.
    """
    s = spark.range(n).select(F.col("id").alias("i"), F.floor(F.col("id") / 5).alias("r"), F.lit("acme").alias("tenant_id"), F.lit(AT).alias("observed_at"))
    name = lambda p, c, tail="": F.concat(F.lit(p), c.cast("string"), F.lit(tail))
    i, r = F.col("i"), F.col("r")
    own = {"tenant_id": F.col("tenant_id"), "observed_at": F.col("observed_at")}
    inside = own | {"run_id": name("r", r)}
    per_run = s.where(i % 5 == 0)
    rows = ledger.node_rows
    nodes = [
        rows(s.where(i < 7), "Source", **own, id=name("s", i), uri=name("store://", i), source_kind=F.lit("retrieval")),
        rows(per_run, "Run", **own, id=name("r", r), run_key=name("run-", r), started_at=F.lit(AT)),
        rows(per_run, "Output", **inside, id=name("o", r), content_hash=name("sha256:o", r), text=F.lit("said"), delivered=r % 2 == 0),
        *[rows(s, "Artifact", **inside, id=name("a", i, f".{k}"), content_hash=name("sha256:a", i, f".{k}")) for k in range(4)],
        rows(s, "Chunk", **inside, id=name("c", i), content_hash=name("sha256:c", i), ordinal=i % 5, text=F.lit("read"), channel=F.lit("RETRIEVED_DOC"), tier=F.lit("T3"), admitted=F.lit(True)),
        rows(s, "Claim", **inside, id=name("k", i), output_ref=name("o", r), text=F.lit("said"), span_start=i % 5, span_end=i % 5 + 1, material=F.lit(True)),
        rows(
            s.where(i % 3 != 0), "Verdict", **inside, id=name("v", i), target_ref=name("k", i), policy_ref=F.when(i % 3 == 1, "p").otherwise("q"),
            decision=F.when(i % 2 == 0, "allow").otherwise("block"), reason_codes=F.array().cast("array<string>"), method=F.lit("deterministic"), monitored=i % 4 == 0,
        ),
        rows(s.where(i == 0), "Policy", **own, id=F.lit("p"), name=F.lit("default"), version=F.lit("1"), content_hash=F.lit("sha256:p"), mode=F.lit("enforce")),
    ]
    e = lambda kind, a, b, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(kind).alias("type"), a.alias("from_id"), b.alias("to_id")))
    a = lambda k: name("a", i, f".{k}")
    made = F.array(
        e("PRODUCED", name("s", i % 7), a(0)), e("DERIVED_FROM", a(1), a(0)), e("DERIVED_FROM", a(2), a(0)), e("DERIVED_FROM", a(3), a(1)), e("DERIVED_FROM", a(3), a(2)),
        e("SPLIT_INTO", a(3), name("c", i)), e("SUPPORTED_BY", name("k", i), name("c", i)), e("SUPPORTED_BY", name("k", i), name("c", i + 1), (i % 5 < 4) & (i + 1 < n)),
        e("EXTRACTED_FROM", name("k", i), name("o", r)), e("DECIDES", name("v", i), name("k", i), i % 3 != 0),
    )
    edges = s.select("tenant_id", F.explode(F.array_compact(made)).alias("e")).select("tenant_id", "e.*")
    edges = edges.withColumns({"id": F.concat_ws("-", "type", "from_id", "to_id"), "schema_version": F.lit(1), "observed_at": F.lit(AT), "note": F.lit(None).cast("string")})
    return reduce(DataFrame.unionByName, nodes), edges.select(ledger.EDGE_COLUMNS)


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with tenant, digest and source."""
    return table(spark, sf_dir, "documents").select("doc_id", F.lit("local").alias("t"), content_digest(F.coalesce("text", F.lit(""))).alias("h"), "source")
