"""Queries of the engine over the driver's tables; ``oracles`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import ids
from evidentia.functions import text as T
from evidentia.operators import admit, claims, classify, ground, judge, ledger, outcome, traverse, validate
from evidentia.operators.guard import Guard
from evidentia.plans import scenarios, tables
from evidentia.plans.oracles import ORACLE
from evidentia.plans.synthetic import perf_graph
from evidentia.plans.tables import table, varied
from evidentia.sources import checks, graph_files
from evidentia.staging import cut

__all__ = ["ORACLE", "QUERIES", "slot_admission"]

SIGNALS = [admit.resolve_slot("signals")]


# -- what a chunk is, and where it may go


def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.classified(spark, sf_dir).select("doc_id", "part", "chunk_id", "source_id", "content_hash", "retrieved_at")


def text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(T.normalize(t), 256).alias("normalized_sha256"),
        F.size(T.tokenize(t)).cast("long").alias("n_tokens"),
        F.size(T.content_tokens(t)).cast("long").alias("n_content_tokens"),
        F.array_join(T.numbers(F.concat(F.col("doc_id").cast("string"), F.lit(",000 v1.2.3 "), t)), "|").alias("numbers"),
    )


def text_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("See `code_"), F.col("doc_id").cast("string"), F.lit('` and "two words" at www.shop.com, x.py or NASA. '), F.coalesce("text", F.lit("")))
    found = table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).withColumn("e", T.entities(F.col("t")))
    return found.select(
        "doc_id", F.sha2(F.array_join("e", "|"), 256).alias("entities_sha256"), F.size("e").cast("long").alias("n_entities"), (T.strip_trailing(F.col("t")) == F.col("t")).alias("bare"),
        T.contains_phrase(T.normalize(F.col("t")), F.lit("of the")).alias("has_phrase"), T.is_identifier(F.substring("t", 1, 3)).alias("acronym"),
    )


def error_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.coalesce(F.col("_json.error_found"), F.lit(False))
    return classify.prepare(varied(spark, sf_dir)).select(
        "doc_id", "part", F.col("_lead").alias("lead"), F.col("_bare").alias("bare"), F.col("_page").alias("page"), F.col("_head").alias("head"), found.alias("found"),
        F.col("_error").alias("error"), F.col("_status").alias("detected"),
    )


def json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = classify.prepare(varied(spark, sf_dir)).where(F.col("_json.parses").isNotNull())
    return facts.select("doc_id", "part", "_json.parses", "_json.error_found", "_json.error_status", "_json.degraded", "_json.unclosed", F.col("_truncated").alias("truncated"))


def signature_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.classified(spark, sf_dir).select("doc_id", "part", "signature", F.col("status").cast("long").alias("status"), "channel", "tier")


def _checked(spark: SparkSession, sf_dir: str, policy: admit.Policy | None = None) -> DataFrame:
    return admit.check_slot(tables.classified(spark, sf_dir), admit.policy_slots(spark, policy))


def slot_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir).select("doc_id", "part", "slot", "decision", F.array_join("reasons.code", "|").alias("reason_codes"))


def slot_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _checked(spark, sf_dir, SIGNALS).select("doc_id", "part", F.array_join("reasons.message", " ").alias("messages"))


def admission_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why chunks were refused, by slot."""
    code = F.explode_outer("reasons.code").alias("reason_code")
    return _checked(spark, sf_dir).select("slot", "decision", code).groupBy("slot", "decision", "reason_code").agg(F.count(F.lit(1)).alias("n"))


def assembled_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each slot of a run of fifty documents holds."""
    checked = _checked(spark, sf_dir).withColumns({"run_id": F.floor(F.col("doc_id") / 50), "ordinal": F.struct("doc_id", "part")})
    held = admit.assemble_context(checked, admit.policy_slots(spark))
    return held.select("run_id", "slot", F.size("admitted").cast("long").alias("n_admitted"), F.sha2(F.array_join("admitted", ","), 256).alias("admitted_sha256"))


def check_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Check documents made of ``documents``, three of eight of them usable."""
    e, k, i = tables.escaped(F.coalesce("text", F.lit(""))), F.col("doc_id") % 8, F.col("doc_id").cast("string")
    chunks = F.concat(F.lit(', "chunks": [{"id": "c", "raw": "'), e, F.lit('", "provenance": {"channel": "TOOL_RESULT", "upstreamStatus": 200}}, "plain"]'))
    said, policy = F.concat(F.lit(', "output": "'), e, F.lit('"')), F.lit(', "slot": "own", "policy": {"slots": [{"name": "own", "allowedChannels": ["CACHE"], "minTier": "T5"}]}')
    tail = (
        F.when(k == 1, F.concat(chunks, said, F.lit(","))).when(k == 2, said).when(k == 3, chunks).when(k == 4, F.concat(F.lit(', "chunks": [{"id": "c"}]'), said))
        .when(k == 5, F.concat(chunks, said, F.lit(', "slot": "nowhere"'))).when(k == 6, F.concat(chunks, F.replace(said, F.lit('"output"'), F.lit('"candidateOutput"')), F.lit(', "slot": "evidence"')))
        .when(k == 7, F.concat(chunks, said, policy)).otherwise(F.concat(chunks, said))
    )
    documents = table(spark, sf_dir, "documents").select(i.alias("file"), F.concat(F.lit('{"run_id": "'), i, F.lit('"'), tail, F.lit("}")).alias("value"))
    made, outputs, rejected = checks.parse_checks(documents)
    texts = made.groupBy("run_id").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "|"), 256).alias("chunks_sha256"))
    good = outputs.join(texts, "run_id").select("run_id", F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("error"), "slot", "min_tier", F.sha2("output", 256).alias("output_sha256"), "chunks_sha256")
    return good.unionByName(rejected, allowMissingColumns=True).withColumn("doc_id", F.col("run_id").cast("long")).drop("run_id")


# -- what an output claims, and what that rests on


def claims_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.extract_claims(tables.runs(spark, sf_dir)[0])


def _said(assessed: DataFrame, *more: str) -> DataFrame:
    return assessed.select("run_id", "claim_id", "status", "decided_by", "score", F.array_join("supporting_chunk_ids", "|").alias("supporting"), "reason", *more)


def ground_assess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(tables.audited(spark, sf_dir)[2], "method", "detail")


def ground_ungated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims against all chunks as they are declared, without the inbound gate."""
    outputs, raw = tables.runs(spark, sf_dir)
    declared = classify.classify(raw).withColumn("tier", F.col("hint_tier"))
    return _said(ground.audit_outputs(outputs, declared)[0])


def audit_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, _, assessed = tables.audited(spark, sf_dir)
    return ground.run_verdicts(outputs, assessed).select("run_id", "decision", F.array_join("reasons", "|").alias("reasons"))


def pipeline_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both gates over the conversations."""
    outputs, checked, assessed = tables.audited(spark, sf_dir)
    return outcome.run_outcomes(checked, ground.run_verdicts(outputs, assessed))


def judge_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A judge that lowers every third claim that it is asked about, and does not answer about the next."""
    assessed = tables.audited(spark, sf_dir)[2]
    k = F.col("claim_seq") % 3
    said = F.when(k == 0, "ungrounded").when(k == 2, "grounded")
    advice = assessed.select("run_id", "claim_id", said.alias("judge_status"), F.array().cast("array<string>").alias("judge_ids"), F.lit(0.0).alias("judge_score"), F.when(k == 1, "timeout").alias("judge_error"))
    return judge.escalate(assessed, advice).select("run_id", "claim_id", "status", "decided_by", "score", "reason", "advisory.applied", "advisory.error")


def judge_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, checked, assessed = tables.audited(spark, sf_dir)
    return judge.fixture_keys(assessed.where("status = 'unverifiable'"), checked.where("decision = 'allow'"))


def guard_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a guard delivers in either mode, with what its first span reports."""
    outputs, raw = tables.runs(spark, sf_dir)
    made = []
    for mode in ("enforce", "monitor"):
        run = Guard(mode).run(raw, outputs)
        n = lambda name: F.col("attributes")[name].cast("long")
        span = run.spans.where("span = 'guard.inbound'").select("run_id", n("chunks.candidates").alias("candidates"), n("chunks.admitted").alias("admitted"), n("chunks.would_refuse").alias("would_refuse"))
        made.append(run.delivery.join(span, "run_id").select("mode", "run_id", "decision", "delivered", "candidates", "admitted", "would_refuse"))
    return made[0].unionByName(made[1])


# -- the ledger


def run_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, raw = tables.runs(spark, sf_dir)
    checked = admit.check_slot(classify.classify(raw), admit.policy_slots(spark, SIGNALS))
    none = ground.assess_claims(claims.extract_claims(outputs), checked).limit(0)
    runs, _, _ = ledger.run_audit(outputs, checked, none, outputs.select("run_id", F.lit(False).alias("would_block")))
    return runs.select("run_id", "run_key", ids.derive_id(F.col("tenant_id"), "Run", {"runKey": F.col("run_key")}).alias("run"))


def ledger_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.redact(tables.lineage(spark, sf_dir)[0]).drop("reason_codes")


def ledger_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lineage(spark, sf_dir)[1]


def ledger_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of runs, sources and chunks with each document a run of one chunk."""
    d = tables.document_ids(spark, sf_dir).withColumn("run_id", ids.derive_id(F.col("t"), "Run", {"runKey": F.col("doc_id").cast("string")}))
    return d.select(
        "doc_id",
        "run_id",
        ids.derive_id(F.col("t"), "Source", {"uri": F.col("source"), "sourceKind": F.lit("retrieval")}).alias("source_id"),
        ids.derive_id(F.col("t"), "Chunk", {"runId": F.col("run_id"), "contentHash": F.col("h"), "ordinal": F.lit(0)}).alias("chunk_id"),
    )


def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids taken apart, and what is none."""
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 6
    digest = F.sha2(i, 256)
    short = lambda head, n: F.concat(F.lit(head), F.substring(digest, 1, n))
    id_ = (
        F.when(k == 0, ids.derive_id(F.lit("local"), "Run", {"runKey": i})).when(k == 1, F.concat(F.lit("run-"), i)).when(k == 2, short("pg:acme:Run:", 31)).when(k == 3, short("pg:ACME:Run:", 32))
        .when(k == 4, short("pg:acme:edge.PRODUCED:", 32)).otherwise("")
    )
    d = table(spark, sf_dir, "documents").select("doc_id", id_.alias("id"))
    return d.select("doc_id", ids.id_parts(F.col("id")).alias("p"), ids.is_id_for_tenant(F.col("id"), F.lit("acme")).alias("of_acme")).select("doc_id", "p.*", "of_acme")


def source_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs without the credentials that two of three are given."""
    p = table(spark, sf_dir, "pages").where(F.col("url").rlike(r"\Ahttps?://[A-Za-z0-9.-]+(?:/|[?#]|\z)"))
    shown = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace("url", "://", "://user:secret@"))
    return p.select("page_id", ledger.strip_credentials(shown).alias("uri"))


def redacted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources and chunks of a graph as they are exported."""
    nodes, _ = tables.braid(spark, tables.count_of(spark, sf_dir))
    shown = ledger.redact(nodes.where("kind IN ('Source', 'Chunk')"))
    return shown.select(graph_files.element_json(ledger.NODE_SCHEMA).alias("element"))


def validate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the conversations' ledger: none."""
    return validate.validate(*(cut(x, "validated", keep=True) for x in tables.lineage(spark, sf_dir))).drop("message")


def validate_damaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of graphs that are wrong in every way, counted; graphs that are nearly wrong add nothing."""
    nodes, edges = tables.damaged(spark, tables.count_of(spark, sf_dir))
    return validate.validate(cut(nodes, "validated", keep=True), cut(edges, "validated", keep=True)).groupBy("code", "element_type").agg(F.count(F.lit(1)).alias("n"))


# -- traversals


def _perf(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A synthetic graph with a strand for each supplier."""
    return tuple(cut(x, "perf", keep=True) for x in perf_graph(spark, tables.count_of(spark, sf_dir), 3))


def perf_fixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = perf_graph(spark, tables.count_of(spark, sf_dir), 3)
    count = lambda df, kind: df.groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return count(nodes, "kind").unionByName(count(edges, "type"))


def impact_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rests on each source, by kind and distance."""
    nodes, edges = _perf(spark, sf_dir)
    origins = nodes.where("kind = 'Source'").select("tenant_id", F.col("id").alias("origin"))
    return traverse.impact(nodes, edges, origins).groupBy("kind", "distance").agg(F.count(F.lit(1)).alias("n"))


def _braid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(cut(x, "braid", keep=True) for x in tables.braid(spark, tables.count_of(spark, sf_dir)))


def _of(nodes: DataFrame, where: str, name: str) -> DataFrame:
    return nodes.where(where).select("tenant_id", F.col("id").alias(name))


def impact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that rests on each source and chunk, however much it is."""
    nodes, edges = _braid(spark, sf_dir)
    found = traverse.impact(nodes, edges, _of(nodes, "kind IN ('Source', 'Chunk')", "origin"), max_nodes=None, require=True)
    return traverse.impact_groups(found, nodes).drop("tenant_id")


def impact_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is three steps away at most."""
    nodes, edges = _braid(spark, sf_dir)
    return traverse.impact(nodes, edges, _of(nodes, "kind IN ('Source', 'Chunk')", "origin"), max_nodes=None, max_depth=3).where("id IS NOT NULL").select("origin", "id", "distance", "truncated")


def trace_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward paths of every claim, by length and kind of their end."""
    nodes, edges = _perf(spark, sf_dir)
    paths = traverse.trace(nodes, edges, _of(nodes, "kind = 'Claim'", "target")).withColumn("id", F.element_at("path_nodes", -1))
    return paths.join(nodes.select("id", "kind"), "id").groupBy(F.size("path_nodes").cast("long").alias("length"), "kind").agg(F.count(F.lit(1)).alias("n"))


_ENDS = "kind = 'Claim' OR id LIKE 'a%.3'"


def trace_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three paths of claims, some of which have four, and of artifacts."""
    nodes, edges = _braid(spark, sf_dir)
    p = traverse.trace(nodes, edges, _of(nodes, _ENDS, "target"), max_paths=3, require=True)
    return p.select("target", F.array_join("path_nodes", ">").alias("nodes"), F.array_join("path_edges", ">").alias("edges"), "truncated", "path_rank")


def trace_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of four nodes at most."""
    nodes, edges = _braid(spark, sf_dir)
    p = traverse.trace(nodes, edges, _of(nodes, _ENDS, "target"), max_depth=4)
    return p.select("target", F.array_join("path_nodes", ">").alias("nodes"), "truncated")


def trace_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _braid(spark, sf_dir)
    return traverse.trace_sources(traverse.trace(nodes, edges, _of(nodes, "kind IN ('Claim', 'Output')", "target"), max_paths=1000), nodes).drop("tenant_id")


def explain_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _braid(spark, sf_dir)
    e = traverse.explain(nodes, edges, _of(nodes, "kind = 'Claim'", "target"))
    return e.select(
        "target", "verdict", "decision", "monitored", "policy_name", F.size("decision_paths").cast("long").alias("n_shortest"), F.size(F.get("decision_paths", F.lit(0))).cast("long").alias("length"),
        F.array_join(F.array_sort("sources"), "|").alias("sources"),
    )


# -- what becomes of runs, and rates over labelled ones


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk a run of its own in the slot signals, without claims, labelled by doc_id."""
    checked = _checked(spark, sf_dir, SIGNALS).withColumns({"run_id": F.struct("doc_id", "part"), "ordinal": F.lit(0)})
    checked = cut(checked.select("run_id", "ordinal", "decision", "reasons"), "signals", keep=True)
    none = checked.select("run_id", F.lit("allow").alias("decision"), F.array().cast("array<string>").alias("reasons"))
    i = F.col("run_id.doc_id")
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), (k + 1).cast("int"))
    labels = {
        "difficulty": pick(outcome.DIFFICULTIES[:2], i % 2), "provenance": pick(outcome.PROVENANCES, F.floor(i / 2) % 2), "should_block": i % 9 < 7,
        "expected": F.when(i % 9 < 7, "inbound").otherwise("either"),
    }
    return outcome.run_outcomes(checked, none, "monitor").withColumns(labels).withColumn("actual", F.col("stage"))


def monitor_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _signals(spark, sf_dir).select("run_id.doc_id", "run_id.part", "would_block", "stage", "reason_code", "outcome")


def recall_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    axes = {"difficulty": outcome.DIFFICULTIES, "provenance": outcome.PROVENANCES}
    return outcome.rates(_signals(spark, sf_dir), F.col("should_block"), axes).select("difficulty", "provenance", "numerator", "denominator")


def false_positive_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.rates(_signals(spark, sf_dir), ~F.col("should_block"), {"difficulty": outcome.DIFFICULTIES}).select("difficulty", "numerator", "denominator")


def gate_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.gate_breakdown(_signals(spark, sf_dir))


def shape_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = classify.prepare(varied(spark, sf_dir))
    return d.select("doc_id", "part", outcome.shape_flag(d).alias("flagged"))


def bench_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixed corpus with guards and without."""
    return scenarios.bench(spark).select("run_id", "actual", "passed", "stage", "reason_code", "control", "guard_effect")


def bench_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcome.bench_summary(scenarios.bench(spark))


def bench_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = scenarios.bench(spark)
    fp = outcome.false_positive_rates(results).select(F.lit("false_positive").alias("kind"), "difficulty", F.lit("").alias("provenance"), "numerator", "denominator", "label")
    return outcome.recall_rates(results).select(F.lit("recall").alias("kind"), "difficulty", "provenance", "numerator", "denominator", "label").unionByName(fp)


def control_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs, raw = tables.runs(spark, sf_dir)
    e = outcome.control_evidence(classify.classify(raw), outputs)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return e.select("run_id", "control", F.col("chunk_count").cast("long").alias("chunk_count"), joined("chunk_ids"), joined("content_hashes"), joined("labels"), "output_hash")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        chunk_identity, text_forms, text_entities, error_evidence, json_facts, signature_classify, slot_admission, slot_reasons, admission_counts, assembled_context, check_inputs,
        claims_extract, ground_assess, ground_ungated, audit_verdict, pipeline_outcome, judge_escalation, judge_keys, guard_delivery, run_keys, ledger_nodes, ledger_edges,
        ledger_chunk_ids, id_parts, source_uris, redacted_lines, validate_ledger, validate_damaged, perf_fixture, impact_kinds, impact_groups, impact_limits, trace_lengths,
        trace_paths, trace_limits, trace_sources, explain_claims, monitor_outcome, recall_rates, false_positive_rates, gate_breakdown, shape_baseline, bench_results,
        bench_summary, bench_rates, control_evidence,
    )
}
