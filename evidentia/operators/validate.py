"""The ledger's validator: every violation of a graph as rows of code, element type, element id and message."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.errors import GraphError
from evidentia.functions.ids import IDENTITY, edge_id, expected_node_id
from evidentia.operators.components import components
from evidentia.operators.ledger import ACYCLIC, MATRIX, RUN_LOCAL
from evidentia.staging import cut, scope

#: What each code says.
MESSAGES = {
    "GRAPH_SCHEMA_INVALID": "the element does not have the shape of its kind",
    "GRAPH_EDGE_ENDPOINT_MISSING": "an end of the edge is not in the graph",
    "GRAPH_REFERENCE_MISSING": "the node refers to a node that is not in the graph",
    "GRAPH_EDGE_TYPE_NOT_PERMITTED": "edges of this type do not join these kinds",
    "GRAPH_TENANT_MISMATCH": "the element crosses tenants",
    "GRAPH_RUN_MISMATCH": "the edge joins two runs",
    "GRAPH_CYCLE_DETECTED": "the node descends from itself",
    "GRAPH_SUPPORT_FROM_BLOCKED_CHUNK": "the claim is supported by a chunk that was refused",
    "GRAPH_CLAIM_UNSUPPORTED_DELIVERY": "a material claim was delivered without support or exception",
    "GRAPH_VERDICT_POLICY_MISSING": "the policy of the verdict is not in the graph",
    "GRAPH_ID_MISMATCH": "the id does not follow from the element's own fields",
    "GRAPH_DUPLICATE_ID": "different elements share the id",
}
#: Codes with which a graph cannot be loaded, and those with which not even one element of it is taken.
REJECTING = ["GRAPH_SCHEMA_INVALID", "GRAPH_ID_MISMATCH", "GRAPH_DUPLICATE_ID", "GRAPH_TENANT_MISMATCH", "GRAPH_RUN_MISMATCH", "GRAPH_EDGE_TYPE_NOT_PERMITTED", "GRAPH_CYCLE_DETECTED"]
MALFORMED = ["GRAPH_SCHEMA_INVALID", "GRAPH_ID_MISMATCH"]
# The shapes of nodes.
CHANNELS = ["USER_MESSAGE", "RETRIEVED_DOC", "TOOL_RESULT", "SYSTEM_ALERT", "DIAGNOSTIC_LOG", "AGENT_OUTPUT", "CACHE", "UNLABELED"]
REASONS = [
    "CHANNEL_NOT_PERMITTED", "TIER_BELOW_MINIMUM", "UPSTREAM_STATUS_NOT_OK", "PAYLOAD_EMPTY", "PAYLOAD_TRUNCATED", "CLAIM_UNGROUNDED", "CLAIM_SUPPORT_LOW_TIER",
    "CLAIM_UNVERIFIABLE", "PROVENANCE_LABEL_MISMATCH", "RESULT_DEGRADED",
]
REQUIRED = {
    "Source": "uri source_kind", "Run": "run_key started_at", "Step": "run_id step_index name step_kind", "Artifact": "run_id content_hash",
    "Chunk": "run_id content_hash ordinal text channel tier retrieved_at admitted", "Claim": "run_id output_ref text span_start span_end material",
    "Policy": "name version content_hash mode", "Verdict": "run_id target_ref policy_ref decision reason_codes method monitored decided_at input_hash",
    "Output": "run_id content_hash text delivered",
}
#: Kinds whose text may be empty; every other string that is there is not.
MAY_BE_EMPTY = ["Chunk", "Output"]
STRINGS = "id tenant_id uri run_key run_id name content_hash media_type slot output_ref version target_ref policy_ref input_hash".split()
CHOICES = {
    "source_kind": ["tool", "retrieval", "user", "cache", "system", "unknown"], "step_kind": ["retrieve", "tool_call", "transform", "assemble", "generate"], "channel": CHANNELS,
    "tier": ["T1", "T2", "T3", "T4", "T5"], "mode": ["monitor", "enforce"], "decision": ["allow", "quarantine", "block"], "method": ["deterministic", "judge"],
}
TIMES = ["observed_at", "started_at", "retrieved_at", "decided_at"]
TIME = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})\z"
COUNTS = ["step_index", "ordinal", "byte_length", "span_start", "span_end"]

ROW = ["code", "element_type", "element_id", "message"]


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), tests, F.lit(False))


def bad_node() -> Column:
    """Whether a row of the node table breaks the schema of its kind."""
    c = F.col
    tests = [c(n).isNull() for n in ("id", "tenant_id", "kind", "observed_at")] + [~c("kind").isin(list(IDENTITY)), ~c("schema_version").eqNullSafe(1)]
    for kind, names in REQUIRED.items():
        tests.append((c("kind") == kind) & _any([c(n).isNull() for n in names.split()]))
    tests += [c(n) == "" for n in STRINGS] + [(c("text") == "") & ~c("kind").isin(MAY_BE_EMPTY)]
    tests += [~c(n).isin(values) for n, values in CHOICES.items()] + [~c(n).rlike(TIME) for n in TIMES] + [c(n) < 0 for n in COUNTS]
    return _any(tests + [~c("upstream_status").between(100, 599), c("span_end") < c("span_start"), F.exists("reason_codes", lambda r: ~F.coalesce(r.isin(REASONS), F.lit(False)))])


def bad_edge() -> Column:
    c = F.col
    tests = [c(n).isNull() | (c(n) == "") for n in ("id", "tenant_id", "from_id", "to_id")] + [c("type").isNull(), ~c("type").isin(list(MATRIX)), ~c("schema_version").eqNullSafe(1)]
    return _any([*tests, c("observed_at").isNull(), ~c("observed_at").rlike(TIME), c("note") == ""])


def _found(df: DataFrame, element: str, tests: dict[str, Column]) -> DataFrame:
    """A row for each test that an element of ``df`` does not pass, in one scan."""
    codes = F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(False)), code) for code, t in tests.items()]))
    return df.select(F.explode(codes).alias("code"), F.lit(element).alias("element_type"), F.col("id").alias("element_id"))


def _rings(component: pd.DataFrame) -> list[int]:
    """The nodes of one component that lie on a cycle, by strongly connected components with a stack of our own."""
    ahead: dict[int, list[int]] = {}
    for a, b in zip(component["a"].tolist(), component["b"].tolist(), strict=True):
        ahead.setdefault(a, []).append(b)
    order: dict[int, int] = {}
    low: dict[int, int] = {}
    open_: list[int] = []
    inside: set[int] = set()
    found: list[int] = []
    for start in ahead:
        if start in order:
            continue
        walk = [(start, iter(ahead.get(start, ())))]
        order[start] = low[start] = len(order)
        open_.append(start)
        inside.add(start)
        while walk:
            node, rest = walk[-1]
            for b in rest:
                if b not in order:
                    order[b] = low[b] = len(order)
                    open_.append(b)
                    inside.add(b)
                    walk.append((b, iter(ahead.get(b, ()))))
                    break
                if b in inside:
                    low[node] = min(low[node], order[b])
            else:
                walk.pop()
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[node])
                if low[node] == order[node]:
                    group = []
                    while not group or group[-1] != node:
                        group.append(open_.pop())
                    inside.difference_update(group)
                    if len(group) > 1 or node in ahead.get(node, ()):
                        found += group
    return found


def _peeled(e: DataFrame) -> DataFrame:
    """Edges whose beginning something leads to and whose end leads on."""
    into = e.select("type", F.col("b").alias("a")).distinct()
    out = e.select("type", F.col("a").alias("b")).distinct()
    return e.join(into, ["type", "a"], "left_semi").join(out, ["type", "b"], "left_semi")


def _large(e: DataFrame) -> DataFrame:
    """``type, id`` on cycles of components too large for a task: peeled until stable, then coloured by the greatest node that reaches a node."""
    found = []
    while True:
        size = -1
        while size != (n := e.count()):
            size, e = n, cut(_peeled(e), "cycles-peel")
        if not size:
            break
        color = cut(e.select("type", F.col("a").alias("id")).unionByName(e.select("type", F.col("b").alias("id"))).distinct().withColumn("c", F.col("id")), "cycles-color")
        while True:  # the greatest color goes forward until nothing changes
            sent = e.join(color.select("type", F.col("id").alias("a"), "c"), ["type", "a"]).groupBy("type", F.col("b").alias("id")).agg(F.max("c").alias("got"))
            new = cut(color.join(sent, ["type", "id"], "left").select("type", "id", F.greatest("c", "got").alias("c"), (F.coalesce("got", "c") > F.col("c")).alias("moved")), "cycles-color")
            color = new.select("type", "id", "c")
            if new.where("moved").isEmpty():
                break
        core = cut(color.where("id = c"), "cycles-core")
        while True:  # back from each color's own node, within the color
            back = e.join(core.select("type", F.col("id").alias("b"), "c"), ["type", "b"]).select("type", F.col("a").alias("id"), "c").join(color, ["type", "id", "c"], "left_semi")
            more = cut(back.distinct().join(core, ["type", "id"], "left_anti"), "cycles-more")
            if more.isEmpty():
                break
            core = cut(core.unionByName(more), "cycles-core")
        many = core.groupBy("type", "c").count().where("count > 1").select("type", "c")
        found.append(core.join(many, ["type", "c"], "left_semi").select("type", "id"))
        gone = core.select("type", "id")
        e = e.join(gone.withColumnRenamed("id", "a"), ["type", "a"], "left_anti").join(gone.withColumnRenamed("id", "b"), ["type", "b"], "left_anti")
    return reduce(DataFrame.unionByName, found) if found else e.select("type", F.col("a").alias("id"))


def cycles(edges: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``type, id`` of the nodes that lie on a cycle of edges of one of the types that must be acyclic.

    Nodes that nothing leads to, or that lead to nothing, are peeled off twice, which leaves nothing of most
    lineages.  What is left is split into connected components, and each is searched in a task of its own; a
    component of more than ``most`` edges is peeled and coloured by distributed rounds, whose number grows with its depth.
    """
    e = edges.where(F.col("type").isin(ACYCLIC) & F.col("from_id").isNotNull() & F.col("to_id").isNotNull()).select("type", F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct()
    left = cut(_peeled(_peeled(e)), "cycles-left")
    if left.isEmpty():
        return left.select("type", F.col("a").alias("id"))
    ends = left.select("type", F.col("a").alias("id")).unionByName(left.select("type", F.col("b").alias("id"))).distinct()
    names = cut(ends.withColumn("n", F.monotonically_increasing_id()), "cycles-names")
    of = lambda c: names.select("type", F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    numbered = cut(left.join(of("a"), ["type", "a"]).join(of("b"), ["type", "b"]).select("type", F.col("na").alias("a"), F.col("nb").alias("b")), "cycles-edges")
    parts = components(numbered.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cycles-parts")
    placed = numbered.join(parts.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    sizes = cut(placed.groupBy("root").count(), "cycles-sizes")

    def search(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"n": pd.Series(_rings(group), dtype="int64")})

    small = placed.join(sizes.where(F.col("count") <= most), "root").select("root", "a", "b").groupBy("root").applyInPandas(search, "n long")
    found = names.join(small, "n").select("type", "id")
    if not sizes.where(F.col("count") > most).isEmpty():
        loops = left.where("a = b").select("type", F.col("a").alias("id"))
        big = placed.join(sizes.where(F.col("count") > most), "root", "left_semi").select("type", "a", "b").where("a <> b")
        wide = _large(big).withColumnRenamed("id", "n").join(names, ["type", "n"]).select("type", "id")
        found = found.unionByName(wide).unionByName(loops).distinct()
    return found


def validate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``code, element_type, element_id, message``, one row each; an empty result is a valid graph.

    Every violation is reported and none raises.  Cyclic nodes are reported one by one; equal copies of an element
    are no duplicates; references to another tenant's node are the tenant code's business; a verdict excuses a claim
    by its edge or by its target.  Rows have no order; by ROW they are the same for any order of the input.
    """
    with scope(nodes.sparkSession):
        run_of = F.when(F.col("kind") == "Run", F.col("id")).when(~F.col("kind").isin("Source", "Policy"), F.col("run_id"))
        verdicts = nodes.where("kind = 'Verdict'")
        blocked = verdicts.where("decision = 'block' AND NOT monitored").select(F.col("target_ref").alias("id")).distinct().withColumn("_blocked", F.lit(True))
        slim = nodes.select("id", "tenant_id", "kind", run_of.alias("run"), F.when(F.col("kind") == "Chunk", F.col("admitted")).alias("admitted")).distinct()
        ends = cut(slim.join(blocked, "id", "left"), "validate-ends")
        side = lambda p: ends.select(*[F.col(c).alias(f"{p}_{c}") for c in ("id", "tenant_id", "kind", "run")])
        refused = (~ends["admitted"] | F.coalesce("_blocked", F.lit(False))).alias("t_refused")
        to_side = ends.select(*[F.col(c).alias(f"t_{c}") for c in ("id", "tenant_id", "kind", "run")], refused)
        joined = edges.join(side("f"), F.col("from_id") == F.col("f_id"), "left").join(to_side, F.col("to_id") == F.col("t_id"), "left")
        lone = F.col("f_id").isNull() | F.col("t_id").isNull()
        allowed = F.array(*[F.lit(f"{t}|{a}|{b}") for t, pairs in MATRIX.items() for a, b in pairs])
        edge_tests = {
            "GRAPH_SCHEMA_INVALID": bad_edge(),
            "GRAPH_EDGE_ENDPOINT_MISSING": lone,
            "GRAPH_EDGE_TYPE_NOT_PERMITTED": ~lone & ~F.array_contains(allowed, F.concat_ws("|", "type", "f_kind", "t_kind")),
            "GRAPH_TENANT_MISMATCH": ~lone & ((F.col("f_tenant_id") != F.col("tenant_id")) | (F.col("t_tenant_id") != F.col("tenant_id"))),
            "GRAPH_RUN_MISMATCH": ~lone & F.col("type").isin(RUN_LOCAL) & (F.col("f_run") != F.col("t_run")),
            "GRAPH_SUPPORT_FROM_BLOCKED_CHUNK": ~lone & (F.col("type") == "SUPPORTED_BY") & F.col("t_refused"),
            "GRAPH_ID_MISMATCH": edge_id(F.col("tenant_id"), F.col("type"), F.col("from_id"), F.col("to_id")) != F.col("id"),
        }
        owner = F.regexp_extract("id", r"\Apg:([^:]*):", 1)
        node_tests = {
            "GRAPH_SCHEMA_INVALID": bad_node(),
            "GRAPH_TENANT_MISMATCH": (owner != "") & (owner != F.col("tenant_id")),
            "GRAPH_ID_MISMATCH": expected_node_id() != F.col("id"),
        }
        refs = nodes.select("id", "tenant_id", F.explode(F.array_distinct(F.array_compact(F.array("run_id", "output_ref", "target_ref")))).alias("ref"))
        refs = refs.where(F.regexp_extract("ref", r"\Apg:([^:]*):", 1) == F.col("tenant_id")).join(ends.select(F.col("id").alias("ref")).distinct(), "ref", "left_anti")
        delivered = nodes.where("kind = 'Output' AND delivered").select(F.col("id").alias("output_ref")).distinct()
        exempt = verdicts.where("decision = 'allow' OR monitored")
        by_edge = edges.where("type = 'DECIDES'").join(exempt.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi").select(F.col("to_id").alias("id"))
        supported = edges.where("type = 'SUPPORTED_BY'").select(F.col("from_id").alias("id"))
        excused = supported.unionByName(exempt.select(F.col("target_ref").alias("id"))).unionByName(by_edge)
        claims = nodes.where("kind = 'Claim' AND material").select("id", "output_ref").join(delivered, "output_ref", "left_semi").join(excused, "id", "left_anti")
        policies = nodes.where("kind = 'Policy'").select(F.col("id").alias("policy_ref"))
        orphans = verdicts.where(F.col("policy_ref").isNotNull()).select("id", "policy_ref").join(policies, "policy_ref", "left_anti")
        shape = lambda df: df.select("id", F.xxhash64(*[F.col(c) for c in df.columns]).alias("h")).groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi")
        one = lambda df, element, code: _found(df, element, {code: F.lit(True)})
        found = [
            _found(nodes, "node", node_tests),
            _found(joined, "edge", edge_tests),
            one(refs, "node", "GRAPH_REFERENCE_MISSING"),
            one(cycles(edges), "node", "GRAPH_CYCLE_DETECTED"),
            one(claims, "node", "GRAPH_CLAIM_UNSUPPORTED_DELIVERY"),
            one(orphans, "node", "GRAPH_VERDICT_POLICY_MISSING"),
            one(shape(nodes), "node", "GRAPH_DUPLICATE_ID"),
            one(shape(edges), "edge", "GRAPH_DUPLICATE_ID"),
        ]
        said = F.element_at(F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv]), F.col("code"))
        return cut(reduce(DataFrame.unionByName, found).distinct().withColumn("message", said), "violations", keep=True)


def _first(found: DataFrame, codes: list[str], most: int) -> Iterator[str]:
    for r in found.where(F.col("code").isin(codes)).orderBy(*ROW).limit(most).collect():
        yield f"{r['code']} {r['element_id']}: {r['message']}"


def refuse(nodes: DataFrame, edges: DataFrame, codes: list[str], doing: str) -> None:
    """Raise the first of the violations with one of ``codes``, naming ten."""
    found = validate(nodes, edges)
    count = found.where(F.col("code").isin(codes)).count()
    if count:
        details = list(_first(found, codes, 10))
        raise GraphError(details[0].split(" ")[0], f"refusing to {doing}: {count} violations", details)


def assert_loadable(nodes: DataFrame, edges: DataFrame) -> None:
    """Raise on the violations that loading does not allow."""
    refuse(nodes, edges, REJECTING, "load the graph")


def assert_tenant_scoped(nodes: DataFrame, edges: DataFrame, tenant: str) -> None:
    """Raise if an element belongs to another tenant, naming five."""
    foreign = lambda df: df.where(~F.col("tenant_id").eqNullSafe(F.lit(tenant))).select("id", "tenant_id")
    found = foreign(nodes).unionByName(foreign(edges)).orderBy("id").limit(5).collect()
    if found:
        raise GraphError("GRAPH_TENANT_MISMATCH", "refusing elements that belong to another tenant", [f"{r['id']} is in {r['tenant_id']}" for r in found])


def assert_sound(nodes: DataFrame) -> None:
    """Raise if a node has no id or no known kind: the least that a store needs."""
    found = nodes.where(F.col("id").isNull() | (F.col("id") == "") | ~F.coalesce(F.col("kind").isin(list(IDENTITY)), F.lit(False))).limit(5).collect()
    if found:
        raise GraphError("GRAPH_SCHEMA_INVALID", "refusing malformed nodes", [f"{r['id']} is a {r['kind']}" for r in found])
