import json

import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia import cli
from evidentia.functions.errors import GraphError
from evidentia.operators import ledger, outcome
from evidentia.plans import queries
from evidentia.plans.synthetic import perf_graph
from evidentia.sources import checks, graph_files
from evidentia.sources.store import FrameStore, ParquetStore, resolve_raw_text
from evidentia.staging import cut
from evidentia.streaming import gate

SF = "/root/testdata/sf0.001"
TABLES = ["documents", "supplier", "conversations"]


@pytest.mark.parametrize("name", ["gate_breakdown", "check_inputs"])
def test_outcomes_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet{'/*.parquet' if __import__('os').path.isdir(f'{SF}/{t}.parquet') else ''}')")
    found = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in found.description]
    got = [tuple(r[c] for c in columns) for r in queries.QUERIES[name](spark, SF).collect()]
    assert sorted(map(str, got)) == sorted(map(str, found.fetchall()))


def test_graph_files_round_trip(spark, tmp_path):
    nodes, edges = perf_graph(spark, 3, 2)
    rows = lambda df: sorted(map(str, df.collect()))
    graph_files.write_jsonl(nodes, edges, str(tmp_path / "lines"), redacted=False)
    n, e = graph_files.read_jsonl(spark, str(tmp_path / "lines"))
    assert rows(n) == rows(nodes.select(n.columns)) and rows(e) == rows(edges.select(e.columns))
    value = graph_files.canonical_json(nodes, edges).first()["value"]
    doc = json.loads(value)
    assert list(doc) == ["schemaVersion", "redacted", "nodes", "edges"]
    assert json.dumps(doc, separators=(",", ":"), ensure_ascii=False) == value and all(list(x) == sorted(x) for x in doc["nodes"] + doc["edges"])
    for n_, e_ in ((nodes, edges), (nodes, edges.limit(0)), (nodes.limit(0), edges), (nodes.limit(0), edges.limit(0))):
        path = tmp_path / f"canonical-{n_ is nodes}-{e_ is edges}"
        graph_files.write_canonical(n_, e_, str(path))
        assert "".join(f.read_text() for f in sorted(path.glob("part-*"))) == graph_files.canonical_json(n_, e_).first()["value"]
    assert [x["id"] for x in doc["nodes"]] == sorted(r["id"] for r in nodes.collect())
    assert {x["text"] for x in doc["nodes"] if x["kind"] == "Chunk"} == {"[redacted]"}
    (tmp_path / "one.json").write_text(value)
    n, e = graph_files.read_canonical(spark, str(tmp_path / "one.json"))
    assert rows(n) == rows(ledger.redact(nodes).select(n.columns)) and e.count() == edges.count()
    for text in ('{"type":"node","element":{}}\n', '{"type":"header","schemaVersion":2}\n', '{"type":"other"}\n'):
        (tmp_path / "bad.jsonl").write_text(text)
        with pytest.raises(graph_files.GraphFormatError):
            graph_files.read_jsonl(spark, str(tmp_path / "bad.jsonl"))


def test_check_inputs(spark, tmp_path):
    good = {"run_id": "r", "output": "It opened.", "chunks": ["plain", {"id": "c", "raw": "x", "provenance": {"channel": "TOOL_RESULT", "tier": "T2", "upstreamStatus": 200}}]}
    bad = ["3", "[1]", '{"output": "x"}', '{"chunks": []}', '{"chunks": [{}], "output": "x"}', '{"chunks": [}']
    for i, t in enumerate([json.dumps(good), *bad]):
        (tmp_path / f"{i}.json").write_text(t)
    chunks, outputs, rejected = checks.read_checks(spark, str(tmp_path))
    got = [(r["ordinal"], r["text"], r["hint_channel"], r["hint_status"]) for r in chunks.orderBy("ordinal").collect()]
    assert got == [(0, "plain", None, None), (1, "x", "TOOL_RESULT", 200)]
    assert [(r["run_id"], r["slot"], r["output"], r["min_tier"]) for r in outputs.collect()] == [("r", "signals", "It opened.", "T3")]
    want = ["INPUT_CHUNKS_MISSING", "INPUT_CHUNKS_MISSING", "INPUT_CHUNK_WITHOUT_TEXT", "INPUT_MALFORMED_JSON", "INPUT_NOT_AN_OBJECT", "INPUT_OUTPUT_MISSING"]
    assert sorted(r["error"] for r in rejected.collect()) == want


INCIDENT = {
    "slot": "signals",
    "chunks": [
        {
            "id": "d1:stdout",
            "raw": "HTTP/1.1 400 Bad Request\ncontent-type: application/json\n\n{\"error\":{\"type\":\"invalid_request_error\",\"message\":\"Unknown parameter: sector_growth. "
            "Expected one of: industry, market, compliance, forecast, risk.\"}}",
            "provenance": {"sourceId": "shell-stdout", "upstreamStatus": 400},
        }
    ],
    "output": "Battery suppliers are shifting from raw growth messaging toward compliance-led forecasting, framing the sector around regulatory readiness rather than pure expansion.",
}


def test_commands_and_golden_ids(spark, tmp_path, capsys):
    """The published check with its ids, and the commands that read its graph."""
    check, graph = str(tmp_path / "check.json"), str(tmp_path / "graph.json")
    (tmp_path / "check.json").write_text(json.dumps(INCIDENT))
    assert cli.main(["check", check, "--graph", graph, "--observed-at", "2026-01-01T00:00:00.000Z"], spark) == 1
    said = capsys.readouterr().out
    assert "inbound d1:stdout: block [UPSTREAM_STATUS_NOT_OK, CHANNEL_NOT_PERMITTED, TIER_BELOW_MINIMUM]" in said and "outbound: block [CLAIM_UNGROUNDED]" in said
    doc = json.loads(open(graph).read())
    by = {n["kind"]: n for n in doc["nodes"]}
    assert by["Source"]["id"] == "pg:local:Source:c6a617861b7b8b2cc074764ac8cdea65" and by["Run"]["id"] == "pg:local:Run:f0a311bc78be67eb004cb69838260d1f"
    assert by["Chunk"]["id"] == "pg:local:Chunk:a1ded9d1231109acd1d5c86ecb04e830" and by["Claim"]["id"] == "pg:local:Claim:9d35d987d9037af3f1207f6dbd8f6247"
    assert by["Policy"]["contentHash"] == "sha256:6bdb1ef0c4dd82247ec84db591d299f3d5521521d57cf40164b298e3d2b49e0b"
    assert list(doc) == ["schemaVersion", "redacted", "nodes", "edges"] and by["Chunk"]["text"] == "[redacted]"
    assert cli.main(["trace", graph, by["Chunk"]["id"]], spark) == 0
    said = capsys.readouterr().out
    assert "paths: 2" in said and "-[SPLIT_INTO]-> Artifact sha256:19777f0e1b57fc2e72290e835f32b07ec0c33a7a44fec7763b65b390ea0fd3b7" in said and "sources: shell-stdout" in said
    assert cli.main(["explain", graph, by["Claim"]["id"]], spark) == 0
    said = capsys.readouterr().out
    assert "decision: block" in said and "policy: default@1 (sha256:6bdb" in said and f"  Claim {by['Claim']['id']}" in said
    assert cli.main(["impact", graph, by["Source"]["id"]], spark) == 0
    assert f"affected runs: 1\n  {by['Run']['id']} (distance 1)" in capsys.readouterr().out
    assert cli.main(["graph", "validate", graph], spark) == 0 and "no violations" in capsys.readouterr().out
    (tmp_path / "bad.json").write_text("{")
    (tmp_path / "list.json").write_text('{"schemaVersion": 1, "nodes": 3}')
    for argv, code in (
        (["check", str(tmp_path / "none.json"), "--json"], "INPUT_NOT_FOUND"), (["check", str(tmp_path), "--json"], "INPUT_IS_DIRECTORY"), (["check", str(tmp_path / "bad.json"), "--json"], "INPUT_MALFORMED_JSON"),
        (["trace", str(tmp_path / "list.json"), "x", "--json"], "INPUT_INVALID_GRAPH"), (["check", "--json", "--tenant"], "INPUT_INVALID_CHECK"), (["check", "--json"], "INPUT_INVALID_CHECK"),
    ):
        assert cli.main(argv, spark) == 2 and json.loads(capsys.readouterr().err)["error"]["code"] == code
    assert cli.main([], spark) == 2 and "Usage" in capsys.readouterr().err


@pytest.mark.parametrize("kind", ["frame", "parquet"])
def test_store_conformance(spark, tmp_path, kind):
    """What every store must do: declare itself, keep every fact, be idempotent and atomic, and keep tenants apart."""
    make = {"frame": lambda: FrameStore(spark), "parquet": lambda: ParquetStore(spark, str(tmp_path / "store"), persist_raw_text=True)}[kind]
    nodes, edges = (cut(x, "conformance", keep=True) for x in perf_graph(spark, 2, 1, "acme"))
    whole = lambda pair: graph_files.canonical_json(*pair, redacted=False).first()["value"]
    store = make()
    assert store.name == kind and isinstance(store.capabilities["transactions"], bool) and store.snapshot("acme")[0].isEmpty()
    store.ingest("acme", nodes, edges)
    assert whole(store.snapshot("acme")) == whole((nodes, edges)) and store.tenants() == ["acme"]
    store.ingest("acme", nodes.orderBy(F.desc("id")), edges)
    assert whole(store.snapshot("acme")) == whole((nodes, edges))
    corrupt = nodes.limit(1).withColumn("kind", F.lit("Wormhole"))
    newcomer = ledger.create_nodes(spark.createDataFrame([("acme", "2026-03-04T10:00:00.000Z", "probe", "1", "sha256:p", "enforce")], "tenant_id string, observed_at string, name string, version string, content_hash string, mode string"), "Policy")
    for tenant, n in (("acme", newcomer.unionByName(corrupt)), ("globex", nodes), ("Not OK", nodes)):
        with pytest.raises(GraphError):
            store.ingest(tenant, n, edges.limit(0))
    assert whole(store.snapshot("acme")) == whole((nodes, edges))
    one = edges.where("type = 'SUPPORTED_BY'").first()
    assert store.nodes("globex").isEmpty() and store.edges("globex").isEmpty() and store.node("globex", one["from_id"]) is None and store.outgoing("globex", one["from_id"]).isEmpty()
    assert {r["kind"] for r in store.nodes("acme", "Chunk").collect()} == {"Chunk"} and {r["type"] for r in store.edges("acme", "SUPPORTED_BY").collect()} == {"SUPPORTED_BY"}
    assert one["id"] in {r["id"] for r in store.outgoing("acme", one["from_id"], one["type"]).collect()} & {r["id"] for r in store.incoming("acme", one["to_id"], one["type"]).collect()}
    with pytest.raises(GraphError):
        store.require_node("acme", "nothing")
    if kind == "parquet":
        assert ParquetStore(spark, str(tmp_path / "store")).size() == store.size()
        store.clear("acme")
        assert store.size() == {"nodes": 0, "edges": 0}
        for wrong in ("yes", 1):
            with pytest.raises(GraphError):
                resolve_raw_text(wrong)


def test_stream_gives_the_batch_verdicts(spark, tmp_path):
    chunks = queries.varied(spark, SF).withColumn("chunk_id", F.lit(None).cast("string"))
    chunks.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))
    gate.keep_verdicts(gate.admit_stream(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    key = lambda df: sorted((r["chunk_id"], r["slot"], r["decision"]) for r in df.select("chunk_id", "slot", "decision").collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(gate.admit_stream(chunks))
