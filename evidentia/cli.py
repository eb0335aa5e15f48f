"""Commands: check a file, run the bench, and ask a graph document.  ``python -m evidentia.cli`` prints the usage."""

from __future__ import annotations

import datetime
import json
import sys
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.errors import EXIT_USAGE, GraphError, InputError, as_input_error
from evidentia.operators import admit, classify, ground, ledger, outcome, traverse, validate
from evidentia.plans import reports, scenarios
from evidentia.sources import checks, files, graph_files
from evidentia.sources.store import FrameStore
from evidentia.staging import cut

USAGE = """Usage:
  check <file.json> [--monitor] [--json] [--graph <out.json>] [--unredacted]
  bench [--monitor] [--json]
  trace <graph.json> <node-id> [--json] [--tenant <id>]
  explain <graph.json> <node-id> [--json] [--tenant <id>]
  impact <graph.json> <node-id> [--json] [--tenant <id>]
  graph validate <graph.json> [--json]

Common flags:
  --tenant <id>        tenant to read (default: local)
  --observed-at <iso>  pin the ledger observation time for reproducible output
  --unredacted         include raw chunk, claim and output text in an exported graph"""


@dataclass
class Arguments:
    positional: list[str] = field(default_factory=list)
    monitor: bool = False
    json: bool = False
    unredacted: bool = False
    debug: bool = False
    tenant: str = "local"
    graph: str | None = None
    observed_at: str | None = None


def parse_arguments(argv: list[str]) -> Arguments:
    """Flags anywhere; a flag that needs a value and has none is an error, an unknown one counts as a word."""
    out, rest = Arguments(), list(argv)
    while rest:
        word = rest.pop(0)
        if word in ("--monitor", "--json", "--unredacted", "--debug"):
            setattr(out, word[2:], True)
        elif word in ("--tenant", "--graph", "--observed-at"):
            if not rest or rest[0].startswith("--"):
                raise ValueError(f"{word} requires a value.")
            setattr(out, word[2:].replace("-", "_"), rest.pop(0))
        else:
            out.positional.append(word)
    return out


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("evidentia").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def check_file(spark: SparkSession, path: str, monitor: bool = False) -> tuple[dict, tuple[DataFrame, DataFrame, DataFrame, DataFrame]]:
    """The result of one check document, and the tables (outputs, checked, assessed, outcomes) it came from."""
    text = files.read_input(spark, path, "check input")
    files.parse_json(text, path, "check input")
    chunks, outputs, rejected = checks.parse_checks(spark.createDataFrame([(path, text)], "file string, value string"))
    wrong = rejected.first()
    if wrong is not None:
        raise InputError("INPUT_INVALID_CHECK", f"the check input is refused: {wrong['error']}", "Check the command arguments and input file.")
    outputs = cut(outputs, "check-outputs", keep=True)
    own = classify.classify(chunks).join(outputs.select("run_id", "slot", "allowed_channels", "min_tier"), "run_id")
    checked = cut(admit.check_slot(own, None).drop("_json"), "check-checked", keep=True)
    assessed, verdicts = ground.audit_outputs(outputs.select("run_id", "output"), checked.where("decision = 'allow'"))
    assessed = cut(assessed, "check-assessed", keep=True)
    outcomes = cut(outcome.run_outcomes(checked, verdicts, "monitor" if monitor else "enforce"), "check-outcomes", keep=True)
    run, out, verdict = outcomes.first(), outputs.first(), verdicts.first()
    rows = [r.asDict(recursive=True) for r in checked.orderBy("ordinal").collect()]  # one document's chunks
    claims = [r.asDict(recursive=True) for r in assessed.orderBy("claim_seq").collect()]
    has = lambda d: {k: v for k, v in d.items() if v is not None}
    chunk = lambda r: {
        "id": r["chunk_id"], "text": r["text"],
        "provenance": has({"sourceId": r["source_id"], "channel": r["channel"], "tier": r["tier"], "retrievedAt": r["retrieved_at"], "contentHash": r["content_hash"], "upstreamStatus": r["status"], "parentSourceId": r["parent_source_id"]}),
    }
    inbound = [{"chunkId": r["chunk_id"], "verdict": {"decision": r["decision"], "reasons": [{**x, "chunkId": r["chunk_id"]} for x in r["reasons"]]}} for r in rows]
    outbound = [{"code": c["reason"], "message": c["detail"], "claimId": c["claim_id"]} for c in claims if c["reason"]]
    result = {
        "outcome": run["outcome"], "wouldBlock": run["would_block"], "monitor": monitor, "stage": run["stage"], "reasonCode": run["reason_code"],
        "reasons": [x for v in inbound for x in v["verdict"]["reasons"]] + outbound, "classifiedChunks": [chunk(r) for r in rows],
        "deliveredChunks": [chunk(r) for r in rows if r["decision"] == "allow"], "inboundVerdicts": inbound, "outboundVerdict": {"decision": verdict["decision"], "reasons": outbound},
        "groundings": [{"claimId": c["claim_id"], "status": c["status"], "supportingChunkIds": c["supporting_chunk_ids"], "method": c["method"], "score": c["score"]} for c in claims],
        "claims": [{"id": c["claim_id"], "text": c["text"], "spanStart": c["span_start"], "spanEnd": c["span_end"]} for c in claims], "output": out["output"], "slotName": out["slot"],
    }
    return result, (outputs, checked, assessed, outcomes)


def _check(spark: SparkSession, a: Arguments) -> int:
    if len(a.positional) < 2:
        raise ValueError("check requires <file.json>.")
    result, tables = check_file(spark, a.positional[1], a.monitor)
    if a.graph is not None:
        at = a.observed_at or datetime.datetime.now(datetime.UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        nodes, edges = ledger.build_graph(*ledger.run_audit(*tables, tenant=a.tenant, observed_at=at, mode="monitor" if a.monitor else "enforce"))
        files.write_text(spark, a.graph, graph_files.canonical_json(nodes, edges, not a.unredacted).first()["value"] + "\n")
    print(json.dumps(result, indent=2, ensure_ascii=False) if a.json else reports.check_text(result))
    return 1 if result["wouldBlock"] and not a.monitor else 0


def _bench(spark: SparkSession, a: Arguments) -> int:
    table = scenarios.bench(spark, "monitor" if a.monitor else "enforce")
    place = {s.id: i for i, s in enumerate(scenarios.SCENARIOS)}
    results = sorted((r.asDict() for r in table.collect()), key=lambda r: place[r["run_id"]])
    recall, false_positive = outcome.recall_rates(table), outcome.false_positive_rates(table)
    rates = [[r.asDict() for r in t.collect()] for t in (recall, false_positive)]
    warnings = outcome.saturation_warnings(recall, false_positive)
    print(reports.bench_table(results, *rates, warnings))
    if a.json:
        summary = {"recall": rates[0], "falsePositiveRate": rates[1], "metrics": {r["metric"]: r["value"] for r in outcome.bench_summary(table).collect()}, "saturationWarnings": warnings}
        files.write_text(spark, "bench-results.json", json.dumps({"monitor": a.monitor, "scenarios": results, "summary": summary}, indent=2) + "\n")
    return 0 if all(r["passed"] or r["difficulty"] != "basic" for r in results) else 1


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    text = files.read_input(spark, path, "graph")
    try:
        files.parse_json(text, path, "graph")
        return graph_files.read_canonical(spark, path)
    except InputError:
        raise
    except Exception as e:
        raise InputError("INPUT_INVALID_GRAPH", f"graph file is not a valid graph document: {path}", str(e).split("\n")[0] or "Check the file contents.", e) from e


def _traverse(spark: SparkSession, a: Arguments) -> int:
    command = a.positional[0]
    if len(a.positional) < 3:
        raise ValueError(f"{command} requires <graph.json> <node-id>.")
    path, id_ = a.positional[1:3]
    graph = read_graph(spark, path)
    try:
        store = FrameStore(spark, *graph)
    except GraphError as e:
        raise InputError("INPUT_INVALID_GRAPH", f"graph file was refused: {path}", str(e), e) from e
    target = store.require_node(a.tenant, id_)
    nodes, edges = store.snapshot(a.tenant)
    one = spark.createDataFrame([(a.tenant, id_, id_)], "tenant_id string, target string, origin string")
    named = lambda ids: {r["id"]: r.asDict() for r in nodes.join(F.broadcast(spark.createDataFrame([(i,) for i in ids], "id string")), "id", "left_semi").collect()} if ids else {}
    if command == "trace":
        table = traverse.trace(nodes, edges, one)
        paths = [r.asDict() for r in table.orderBy("path_rank").collect()]
        sources = [r["uri"] for r in traverse.trace_sources(table, nodes).orderBy("source").collect()]
        cut_short = any(p["truncated"] for p in paths)
        known = {e for p in paths for e in p["path_edges"]}
        types = {r["id"]: r["type"] for r in edges.where(F.col("id").isin(list(known))).collect()} if known else {}
        shown = {"target": id_, "paths": [{"nodes": p["path_nodes"], "edges": p["path_edges"]} for p in paths], "sources": sources, "truncated": cut_short}
        text = reports.trace_text(target, paths, named({i for p in paths for i in p["path_nodes"]}), types, sources, cut_short)
    elif command == "explain":
        shown = traverse.explain(nodes, edges, one).first().asDict()
        text = reports.explain_text(target, shown, named({i for p in shown["decision_paths"] or [] for i in p}))
    else:
        table = traverse.impact(nodes, edges, one)
        groups: dict[str, list[dict]] = {}
        delivered = nodes.select("tenant_id", "id", "delivered")
        for r in traverse.impact_groups(table, nodes).join(delivered, ["tenant_id", "id"]).orderBy("group", "place").collect():
            groups.setdefault(r["group"], []).append({"id": r["id"], "distance": r["distance"], "delivered": r["delivered"]})
        cut_short = table.first()["truncated"]
        shown = {"origin": id_, **groups, "truncated": cut_short}
        text = reports.impact_text(target, groups, cut_short)
    print(json.dumps(shown, indent=2, ensure_ascii=False) if a.json else text)
    return 0


def _graph(spark: SparkSession, a: Arguments) -> int:
    if len(a.positional) < 2 or a.positional[1] != "validate":
        raise ValueError("graph supports one subcommand: validate.")
    if len(a.positional) < 3:
        raise ValueError("graph validate requires <graph.json>.")
    found = [r.asDict() for r in validate.validate(*read_graph(spark, a.positional[2])).orderBy(*validate.ROW).collect()]
    print(json.dumps({"valid": not found, "violations": found}, indent=2) if a.json else reports.validation_text(found))
    return 1 if found else 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command and return its exit code: 0, 1 for what was blocked or is invalid, 2 for usage and unusable inputs."""
    argv = sys.argv[1:] if argv is None else argv
    try:
        a = parse_arguments(argv)
        run = {"check": _check, "bench": _bench, "trace": _traverse, "explain": _traverse, "impact": _traverse, "graph": _graph}.get(a.positional[0] if a.positional else "")
        if run is None:
            print(USAGE, file=sys.stderr)
            return EXIT_USAGE
        return run(spark or _session(), a)
    except Exception as e:
        error = as_input_error(e, "INPUT_INVALID_CHECK", "Check the command arguments and input file.")
        print(error.to_json() if "--json" in argv else error.to_text("--debug" in argv), file=sys.stderr)
        return EXIT_USAGE


if __name__ == "__main__":
    sys.exit(main())
