import duckdb
import pytest
from pyspark.sql import functions as F

from evidentia.functions import ids, text
from evidentia.functions.errors import GraphError
from evidentia.functions.jsonfacts import facts, parse, parse_nested
from evidentia.operators import admit, claims, classify, ground, judge, ledger, outcome, traverse, validate
from evidentia.operators.guard import Guard, emit
from evidentia.plans import queries, scenarios, tables
from evidentia.plans.synthetic import perf_graph
from evidentia.staging import cut

RAW = "run_id string, ordinal int, chunk_id string, text string, hint_channel string, hint_tier string, hint_status int"


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_text_forms(spark):
    d = spark.createDataFrame([("Café  “OK”… x", '1.2.3 cost 1,024, or 1024 and 5. The `a_b` and "two words" at Acme. However API')], "x string, y string")
    r = d.select(text.normalize(F.col("x")), text.numbers(F.col("y")), text.entities(F.col("y")), text.strip_trailing(F.lit('end ).” ')), text.js_trim(F.lit("﻿\t a  "))).first()
    assert list(r) == ["caf ok x", ["1.2.3", "1.2", "3", "1024", "5"], ["a_b", "two words", "Acme", "API"], "end", "a"]


CASES = [
    (" \t", None, None, None, ("UNLABELED", "T5"), ["PAYLOAD_EMPTY", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("fine text", "RETRIEVED_DOC", "T1", 503, ("SYSTEM_ALERT", "T5"), ["UPSTREAM_STATUS_NOT_OK", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("﻿ HTTP/1.1 502 Bad Gateway\nServer: x\n", None, None, None, ("SYSTEM_ALERT", "T5"), ["UPSTREAM_STATUS_NOT_OK", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("some words\r\n 404 Not Found \r\nmore", None, None, None, ("SYSTEM_ALERT", "T5"), ["UPSTREAM_STATUS_NOT_OK", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("it said 404 Not Found in the middle", "RETRIEVED_DOC", "T3", None, ("RETRIEVED_DOC", "T3"), []),
    ('{"statusCode": 429}', None, None, None, ("SYSTEM_ALERT", "T5"), ["UPSTREAM_STATUS_NOT_OK", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("<HTML><h1 id=x> 400  Wrong </h1>", "RETRIEVED_DOC", "T1", None, ("SYSTEM_ALERT", "T5"), ["UPSTREAM_STATUS_NOT_OK", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("server: edge\nerror timeout denied", "RETRIEVED_DOC", "T3", None, ("SYSTEM_ALERT", "T5"), ["CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("server: edge\n" + "plain words of a runbook " * 9 + "error", "RETRIEVED_DOC", "T3", None, ("RETRIEVED_DOC", "T3"), []),
    ('{"rows": [1, 2', None, None, None, ("UNLABELED", "T5"), ["PAYLOAD_TRUNCATED", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("The harbour opened in 1911.", "RETRIEVED_DOC", None, 200, ("RETRIEVED_DOC", "T3"), []),
    ("Please book it.", "USER_MESSAGE", "T4", None, ("USER_MESSAGE", "T4"), ["TIER_BELOW_MINIMUM"]),
    ("Please book it.", "USER_MESSAGE", "T1", 200, ("USER_MESSAGE", "T5"), ["TIER_BELOW_MINIMUM"]),
    ('{"value": "placeholder"}', "TOOL_RESULT", "T2", 200, ("DIAGNOSTIC_LOG", "T5"), ["PROVENANCE_LABEL_MISMATCH", "RESULT_DEGRADED", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ('{"note": "best-effort, last_known"}', "TOOL_RESULT", "T2", 200, ("TOOL_RESULT", "T2"), []),
    ("partial result, circuit open", "TOOL_RESULT", "T2", None, ("DIAGNOSTIC_LOG", "T5"), ["RESULT_DEGRADED", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ('{"error": null, "rows": 2}', "TOOL_RESULT", "T2", 200, ("TOOL_RESULT", "T2"), []),
    ("bash: go: command not found", None, None, None, ("DIAGNOSTIC_LOG", "T5"), ["CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("x\n   at run (a.js:3:4)\ny", "CACHE", "T1", None, ("DIAGNOSTIC_LOG", "T5"), ["CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("éPermission denied", "RETRIEVED_DOC", "T3", None, ("DIAGNOSTIC_LOG", "T5"), ["CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    ("old copy", "CACHE", "T1", None, ("CACHE", "T4"), ["CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
    (None, "CACHE", "T1", None, ("UNLABELED", "T5"), ["PAYLOAD_EMPTY", "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM"]),
]


def test_classification_and_admission(spark):
    raw = spark.createDataFrame([("r", i, f"c{i}", *c[:4]) for i, c in enumerate(CASES)], RAW)
    signals = admit.policy_slots(spark, [admit.resolve_slot("signals")])
    got = {r["ordinal"]: r for r in admit.check_slot(classify.classify(raw), signals).collect()}
    for i, (payload, *_, want, reasons) in enumerate(CASES):
        assert ((got[i]["channel"], got[i]["tier"]), [r["code"] for r in got[i]["reasons"]]) == (want, reasons), payload
    # a chunk that somebody labelled by hand is judged by its text
    hand = classify.prepare(spark.createDataFrame([("c", "HTTP/1.1 500 x", "TOOL_RESULT", "T2")], "chunk_id string, text string, channel string, tier string")).withColumn("status", F.lit(None).cast("int"))
    assert [r["code"] for r in admit.check_slot(hand, signals).first()["reasons"]] == ["PROVENANCE_LABEL_MISMATCH"]
    with pytest.raises(admit.PolicyError):
        admit.resolve_slot("nowhere")


def test_strict_json():
    assert facts('{"a":1} x')[0] is False and facts('{"a":1,"a":2}')[0] is True and facts("[NaN]")[0] is False
    assert facts('{"a": ["x"')[4] is True and facts('{"a": ]')[4] is False
    assert facts('{"code": 4e2}')[1:3] == (True, 400) and facts('{"status": true}')[1] is False
    assert facts('{"n": ' + "9" * 6000 + "}")[0] is True
    deep = "[" * 50_000 + "]" * 50_000
    assert facts(deep)[0] is True and facts(deep[:-1])[0] is False
    for t in ('{"a":[1,{"b":"x\\n"}],"c":{}}', "[]", "[1,]", '{"a"}', "{,}", "[1 2]", "[01]", "[-0.5e3,null]"):
        results = []
        for f in (parse, parse_nested):
            try:
                results.append(f(t))
            except ValueError:
                results.append("no")
        assert results[0] == results[1], t


def test_claims(spark):
    def texts(output):
        found = claims.raw_claims(output)
        assert all(output.encode("utf-16-le")[2 * a : 2 * b].decode("utf-16-le") == t and output[c : c + len(t)] == t for t, c, a, b in found)
        return [r[0] for r in found]

    assert texts("We chose plan B! The team agreed. Iron, tin etc... The rest follows.") == ["We chose plan B! The team agreed.", "Iron, tin etc... The rest follows."]
    assert texts("Dr. Lee \U0001f600 paid 3.5 euros. Then i.e. all. no break") == ["Dr. Lee \U0001f600 paid 3.5 euros.", "Then i.e. all. no break"]
    assert texts("a b\n```\ncode here.\n```\n  ~~~\nstill code") == ["a b"]
    assert texts("| One cell. Two. | b |\n|---|\n> - quoted\n# x\n# two words\n1. item") == ["One cell.", "Two.", "b", "quoted", "two words", "item"]
    assert len(texts("word word. and more, " * 40_000)) == 1  # a megabyte on a line without a break
    output = "Alpha built 3 bridges. Is it so? This might be wrong. Two words. Then Beta closed two."
    got = claims.extract_claims(spark.createDataFrame([("r", output)], "run_id string, output string"))
    assert rows(got, "claim_id", "text") == [("claim-0", "Alpha built 3 bridges."), ("claim-1", "Then Beta closed two.")]


GROUND = [
    ("Acme opened 3 ports.", [("Acme opened 3 ports.", "T2")], ("grounded", "exact", 1.0, ["c0"], None, "claim appears verbatim in context")),
    ("ACME OPENED, 3 ports!", [("Acme opened 3 ports", "T2")], ("grounded", "normalized", 0.9, ["c0"], None, "claim appears in context after normalizing case, whitespace and punctuation")),
    ("every small harbour crane stopped", [("crane in every small harbour, it stopped", "T3")], ("grounded", "normalized", 0.9, ["c0"], None, "claim has 100.0% normalized content-word coverage in a single chunk")),
    ("Acme bought Globex in 2019.", [("Acme grew in 2019", "T2"), ("Globex was sold", "T3")], ("grounded", "entity", 0.75, ["c0", "c1"], None, "every specific in the claim appears in context: Acme, Globex, 2019")),
    ("it rose by 1,024 units", [("1024 units", "T2")], ("grounded", "numeric", 0.75, ["c0"], None, "every specific in the claim appears in context: 1024")),
    ("Acme bought Initech.", [("Acme grew", "T2")], ("ungrounded", "entity", 0.0, ["c0"], "CLAIM_UNGROUNDED", "claim mixes sourced and unsourced specifics; absent from context: Initech")),
    ("Acme bought Initech.", [], ("ungrounded", "entity", 0.0, [], "CLAIM_UNGROUNDED", "no specific in the claim appears in context: Acme, Initech")),
    ("the weather stayed calm there", [("storms and weather", "T2"), ("stayed inside", "T2")], ("unverifiable", "none", 0.5, [], "CLAIM_UNVERIFIABLE", ground.UNDECIDED)),
    ("the weather stayed calm there", [("nothing alike", "T2")], ("ungrounded", "lexical", 0.0, [], "CLAIM_UNGROUNDED", "only 0 of 3 content words appear anywhere in context")),
    ("Acme opened 3 ports.", [("Acme opened 3 ports.", "T5")], ("ungrounded", "exact", 0.0, ["c0"], "CLAIM_SUPPORT_LOW_TIER", "claim appears verbatim in context" + ground.LOW_TIER)),
    ("Acme opened 3 ports.", [("Acme opened 3 ports.", "T5"), ("Acme has 3", "T2")], ("grounded", "entity", 0.75, ["c0", "c1"], None, "every specific in the claim appears in context: Acme, 3")),
]


def test_grounding_and_judge(spark):
    c = spark.createDataFrame([(str(k), i, f"c{i}", t, tier) for k, (_, chunks, _) in enumerate(GROUND) for i, (t, tier) in enumerate(chunks)], "run_id string, ordinal int, chunk_id string, text string, tier string")
    k = spark.createDataFrame([(str(k), "claim-0", 0, g[0], 0, 9) for k, g in enumerate(GROUND)], "run_id string, claim_id string, claim_seq int, text string, span_start int, span_end int")
    outputs = spark.createDataFrame([(str(k),) for k in range(len(GROUND) + 1)], "run_id string")
    assessed, verdicts = ground.check_grounding(outputs, k, c, unverifiable="quarantine")
    assessed = cut(assessed, "test", keep=True)
    got = {r["run_id"]: r for r in assessed.collect()}
    for i, g in enumerate(GROUND):
        r = got[str(i)]
        assert (r["status"], r["decided_by"], r["score"], r["supporting_chunk_ids"], r["reason"], r["detail"]) == g[2], g[0]
    decided = {r["run_id"]: r["decision"] for r in verdicts.collect()}
    assert (decided["0"], decided["5"], decided["7"], decided[str(len(GROUND))]) == ("allow", "block", "quarantine", "allow")

    def hook(claim, context):
        if len(context) != 2:
            raise RuntimeError("unreachable")
        return {"status": "ungrounded", "score": 0.2}

    asked = judge.ask(assessed, c.withColumns({"channel": F.lit("USER_MESSAGE")}), judge.create_judge("live", hook=hook))
    r = {x["run_id"]: x for x in asked.collect()}
    assert (r["7"]["status"], r["7"]["decided_by"], r["7"]["reason"], r["7"]["advisory"]["applied"]) == ("ungrounded", "judge", "CLAIM_UNGROUNDED", True) and r["0"]["advisory"] is None
    unusable = assessed.select("run_id", "claim_id", F.lit("perhaps").alias("judge_status"), F.array().cast("array<string>").alias("judge_ids"), F.lit(0.0).alias("judge_score"), F.lit(None).cast("string").alias("judge_error"))
    r = {x["run_id"]: x for x in judge.escalate(assessed, unusable).collect()}
    assert (r["7"]["status"], r["7"]["advisory"]["error"]) == ("unverifiable", judge.UNUSABLE)
    with pytest.raises(ValueError):
        judge.create_judge("live")


def test_golden_judge_key(spark):
    """The published key of a claim with its context, and what is on record under it."""
    body = "Incident 5512 was closed on 12 May. A separate configuration change was deployed on 12 May."
    at, name = "2026-08-17T00:00:00.000Z", "hard-split-conjunction"
    chunk = spark.createDataFrame(
        [("r", 0, f"{name}:chunk:0", body, f"{name}:source:incident-log", "RETRIEVED_DOC", "T3", at, f"sha256:{name}-00000000000000000000", None)],
        "run_id string, ordinal int, chunk_id string, text string, source_id string, channel string, tier string, retrieved_at string, content_hash string, status int",
    )
    claim = spark.createDataFrame([("r", "claim-1", "The configuration change deployed that day is what resolved it.", 36, 99)], "run_id string, claim_id string, text string, span_start int, span_end int")
    assert judge.fixture_keys(claim, chunk).first()["key"] == judge.FIXTURES[0][0]
    assert judge.create_judge()(claim, chunk).first()["judge_status"] == "ungrounded"
    assert judge.create_judge(fixtures=[("sha256:0", "grounded", [], 1.0)])(claim, chunk).first()["judge_status"] == "unverifiable"


def test_ids(spark):
    with pytest.raises(GraphError):
        ids.assert_tenant("Not OK")
    assert ids.parse_graph_id("pg:local:Source:c6a617861b7b8b2cc074764ac8cdea65") == ("local", "Source", "c6a617861b7b8b2cc074764ac8cdea65")
    for wrong in ("", "run-1", "pg:acme:Run", "pg:acme:Run:nothex", "x:acme:Run:" + "a" * 32):
        with pytest.raises(GraphError):
            ids.parse_graph_id(wrong)
    uris = ["https://u:p@Shop.test:443?a=1", "http://u@x.test/r?q=1#f", "https://vendor.test/report", "not a url", "ftp://u:p@h.test/x", "https://u:p@bad host/x"]
    d = spark.createDataFrame([(u,) for u in uris], "uri string").select(ledger.strip_credentials(F.col("uri")).alias("u"))
    assert [r["u"] for r in d.collect()] == ["https://shop.test/?a=1", "http://x.test/r?q=1#f", "https://vendor.test/report", "not a url", "ftp://h.test/x", "https://u:p@bad host/x"]


@pytest.fixture(scope="module")
def damaged(spark):
    return tuple(cut(x, "damaged", keep=True) for x in tables.damaged(spark, 20))


def test_every_violation_and_no_near_miss(spark, damaged):
    nodes, edges = damaged
    found = validate.validate(nodes, edges)
    got = {(r["code"], r["element_type"]): r["n"] for r in found.groupBy("code", "element_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    want = {
        ("GRAPH_SCHEMA_INVALID", "node"): 1, ("GRAPH_EDGE_ENDPOINT_MISSING", "edge"): 4, ("GRAPH_REFERENCE_MISSING", "node"): 1, ("GRAPH_EDGE_TYPE_NOT_PERMITTED", "edge"): 1,
        ("GRAPH_TENANT_MISMATCH", "edge"): 1, ("GRAPH_RUN_MISMATCH", "edge"): 1, ("GRAPH_CYCLE_DETECTED", "node"): 4, ("GRAPH_SUPPORT_FROM_BLOCKED_CHUNK", "edge"): 1,
        ("GRAPH_CLAIM_UNSUPPORTED_DELIVERY", "node"): 1, ("GRAPH_VERDICT_POLICY_MISSING", "node"): 1, ("GRAPH_ID_MISMATCH", "node"): 1, ("GRAPH_DUPLICATE_ID", "node"): 1,
    }
    assert got == want
    again = validate.validate(nodes.orderBy("text").repartition(3), edges.orderBy(F.desc("id")))
    assert rows(again, *validate.ROW) == rows(found, *validate.ROW)
    with pytest.raises(GraphError):
        validate.assert_loadable(nodes, edges)
    assert validate.validate(nodes.limit(0), edges.limit(0)).count() == 0
    junk = nodes.limit(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in nodes.schema])
    assert {r["code"] for r in validate.validate(junk, edges.limit(0)).collect()} == {"GRAPH_SCHEMA_INVALID"}


def test_cycles(spark):
    def of(pairs, **options):
        e = spark.createDataFrame([("DERIVED_FROM", str(a), str(b)) for a, b in pairs], "type string, from_id string, to_id string")
        return {r["id"] for r in validate.cycles(e, **options).collect()}

    chain = [(i, i + 1) for i in range(5000)]
    braid = [(1, 2), (1, 3), (2, 4), (3, 4)]
    tangle = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y"), ("s", "s"), ("t", "s")]
    assert of(chain) == set() and of(braid) == set()
    assert of([*chain, (4000, 10)]) == {str(i) for i in range(10, 4001)}
    for most in (1_000_000, 2):
        assert of(tangle, most=most) == {"a", "b", "c", "d", "e", "s"}


def test_traversals_against_plain_walks(spark):
    nodes, edges = (cut(x, "braid", keep=True) for x in tables.braid(spark, 12))
    near: dict[str, list] = {}
    for r in ledger.adjacency(edges, ledger.BACKWARD).collect():
        near.setdefault(r["src"], []).append((r["edge_id"], r["dst"]))

    def walk(target, max_paths, max_depth):
        paths, cut_short = [], []

        def go(trail, via):
            if len(paths) >= max_paths or len(trail) > max_depth:
                cut_short.append(1)
                return
            ahead = [x for x in sorted(near.get(trail[-1], [])) if x[1] not in trail]
            if not ahead:
                paths.append((tuple(trail), tuple(via)))
            for e, b in ahead:
                go([*trail, b], [*via, e])

        go([target], [])
        return sorted(paths, key=lambda p: (len(p[0]), ">".join(p[0]))), bool(cut_short)

    targets = nodes.where("kind IN ('Claim', 'Output')").select("tenant_id", F.col("id").alias("target"))
    for max_paths, max_depth in ((100, 64), (2, 64), (3, 6)):
        got: dict[str, list] = {}
        flags = {}
        for r in traverse.trace(nodes, edges, targets, max_paths, max_depth).collect():
            got.setdefault(r["target"], []).append((r["path_rank"], (tuple(r["path_nodes"]), tuple(r["path_edges"]))))
            flags[r["target"]] = r["truncated"]
        for t in (r["target"] for r in targets.collect()):
            paths, cut_short = walk(t, max_paths, max_depth)
            assert [p for _, p in sorted(got.get(t, []))] == paths
            assert flags.get(t, cut_short) == cut_short
    ahead: dict[str, list] = {}
    for r in ledger.adjacency(edges, ledger.FORWARD).collect():
        ahead.setdefault(r["src"], []).append(r["dst"])
    origins = nodes.where("kind = 'Source'").select("tenant_id", F.col("id").alias("origin")).unionByName(spark.createDataFrame([("acme", "o0")], "tenant_id string, origin string"))
    for most in (10_000, 6):
        found: dict[str, dict] = {}
        for r in traverse.impact(nodes, edges, origins, max_nodes=most).collect():
            found.setdefault(r["origin"], {"cut": r["truncated"]})[r["id"]] = r["distance"]
        for o in (r["origin"] for r in origins.collect()):
            seen, queue, depth, over = {o: 0}, [o], 0, False
            while queue and not over:
                depth, following = depth + 1, []
                for x in queue:
                    for y in sorted(ahead.get(x, [])):
                        if y not in seen and not over:
                            over = len(seen) >= most
                            if not over:
                                seen[y] = depth
                                following.append(y)
                queue = following
            del seen[o]
            assert {k: v for k, v in found[o].items() if k not in ("cut", None)} == seen and found[o]["cut"] == over
    with pytest.raises(GraphError):
        traverse.trace(nodes, edges, spark.createDataFrame([("acme", "nothing")], "tenant_id string, target string"), require=True)


@pytest.mark.parametrize("name", ["impact_groups", "impact_limits"])
def test_impact_without_a_limit_against_sql(spark, tmp_path, name):
    """Sources on which more than the 10,000 nodes rest that are the operator's own limit."""
    n, path = 18_000, str(tmp_path / "supplier.parquet")
    spark.range(n).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{path}/*.parquet')")
    got = cut(queries.QUERIES[name](spark, str(tmp_path)), "test", keep=True)
    want = con.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


def test_perf_graph_is_valid(spark):
    nodes, edges = perf_graph(spark, 5, 3)
    assert (nodes.count(), edges.count()) == (4 + 5 * 7, 2 + 5 * 9)
    assert validate.validate(nodes, edges).count() == 0


def test_bench_corpus(spark):
    """The published outcomes of the corpus, and controls that must not pass."""
    results = scenarios.bench(spark)
    recall = {(r["difficulty"], r["provenance"]): r["label"] for r in outcome.recall_rates(results).collect()}
    assert recall == {
        ("basic", "derived"): "6/6 (100.0%)", ("basic", "constructed"): "2/2 (100.0%)", ("hard", "derived"): "n/a (0 scenarios)", ("hard", "constructed"): "3/8 (37.5%)",
        ("mixed", "derived"): "n/a (0 scenarios)", ("mixed", "constructed"): "2/8 (25.0%)",
    }
    assert [r["label"] for r in outcome.false_positive_rates(results).orderBy("difficulty").collect()] == ["0/2 (0.0%)", "0/4 (0.0%)", "1/2 (50.0%)"]
    got = {r["metric"]: r["value"] for r in outcome.bench_summary(results).collect()}
    assert (got["guard_changed"], got["should_block"], got["would_block"], got["stage_inbound"], got["stage_outbound"], got["outbound_validated"]) == (13, 24, 14, 12, 2, 1)
    some = [scenarios.get_scenario("clean-labeled-retrieval"), scenarios.get_scenario("stale-cache")]
    spoil = [
        lambda e: e.withColumn("control", F.lit("withheld")), lambda e: e.withColumn("output_hash", F.lit("0")), lambda e: e.withColumn("labels", F.array(F.lit("none"))),
        lambda e: e.where("run_id <> 'stale-cache'"), lambda e: e.withColumn("chunk_ids", F.array(F.lit("other"))),
    ]
    for s in spoil:
        with pytest.raises(ValueError, match="without guards"):
            scenarios.bench(spark, scenarios=some, control=lambda c, o, s=s: s(outcome.control_evidence(c, o)))


def test_guard_modes(spark):
    chunks = spark.createDataFrame(
        [("r", 0, "a", "Acme opened 3 ports.", "RETRIEVED_DOC", "T3", None), ("r", 1, "b", "old copy", "CACHE", "T4", None), ("s", 0, "c", "Acme opened 3 ports.", "CACHE", "T4", None)], RAW
    )
    outputs = spark.createDataFrame([("r", "Acme opened 3 ports."), ("s", "Acme opened 3 ports.")], "run_id string, output string")
    for mode, delivered in (("enforce", {"r": True, "s": False}), ("monitor", {"r": True, "s": True})):
        run = Guard(mode, observed_at="2026-01-01T00:00:00.000Z").run(chunks, outputs)
        got = {r["run_id"]: r for r in run.delivery.collect()}
        assert {k: r["decision"] for k, r in got.items()} == {"r": "allow", "s": "block"} and {k: r["delivered"] for k, r in got.items()} == delivered
        assert rows(run.checked, "chunk_id", "would_refuse", "refused") == [("a", False, False), ("b", True, mode == "enforce"), ("c", True, mode == "enforce")]
    assert validate.validate(run.nodes, run.edges).count() == 0

    class Broken:
        taken = 0

        def span(self, name, attributes):
            self.taken += 1
            raise RuntimeError(name)

    tracer = Broken()
    assert emit(run.spans, tracer) == 0 and tracer.taken == 4 and emit(run.spans, None) == 0
