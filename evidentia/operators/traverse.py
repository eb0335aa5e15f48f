"""Traversals of the ledger for many starting points at once: backward paths, explanations, and what rests on a node."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.errors import GraphError
from evidentia.operators.ledger import BACKWARD, FORWARD, adjacency
from evidentia.staging import cut, scope


def require_nodes(nodes: DataFrame, wanted: DataFrame, column: str) -> None:
    """Raise if a node named in ``wanted`` (tenant_id, ``column``) is not in its tenant."""
    lost = wanted.join(nodes.select("tenant_id", F.col("id").alias(column)), ["tenant_id", column], "left_anti").orderBy("tenant_id", column).limit(10).collect()
    if lost:
        raise GraphError("GRAPH_REFERENCE_MISSING", "nodes are not present in their tenant", [f"{r[column]} in {r['tenant_id']}" for r in lost])


def trace(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_paths: int = 100, max_depth: int = 64, require: bool = False) -> DataFrame:
    """The simple backward paths of each target: ``tenant_id, target, path_nodes, path_edges, path_rank, truncated``.

    ``targets`` has tenant_id and target.  A path ends where it cannot go on; one of more than ``max_depth``
    nodes is left out.  Of a target the first ``max_paths`` paths in the order of their edge ids are given,
    ranked by length and then by their joined nodes; ``truncated`` tells whether there were more, or longer ones.

    Paths grow by one join a round.  A round keeps the first ``max_paths`` + 1 beginnings of a target, which is
    limited before the shuffle, so what is held grows with the targets and not with the number of paths.  A beginning
    that is kept leads to a path unless it grows too long: targets that run short for that are done again
    with a wider limit.
    """
    if require:
        require_nodes(nodes, targets, "target")
    with scope(nodes.sparkSession):
        back = cut(adjacency(edges, BACKWARD), "trace-adjacency")
        todo, width, done = cut(targets.select("tenant_id", "target").distinct(), "trace-targets"), max_paths + 1, []
        while True:
            paths, flags = _grow(back, todo, width, max_depth)
            both = flags.join(paths.groupBy("tenant_id", "target").agg(F.count(F.lit(1)).alias("n")), ["tenant_id", "target"], "left")
            again = cut(both.where(F.col("dropped") & (F.coalesce("n", F.lit(0)) < max_paths)).select("tenant_id", "target"), "trace-again")
            settled = both.join(again, ["tenant_id", "target"], "left_anti").select("tenant_id", "target", (F.col("dropped") | F.col("long") | (F.col("n") > max_paths)).alias("truncated"))
            done.append(paths.join(settled, ["tenant_id", "target"]))
            if again.isEmpty():
                break
            todo, width = again, width * 8
        order = Window.partitionBy("tenant_id", "target").orderBy("e")
        first = reduce(DataFrame.unionByName, done).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= max_paths)
        shown = Window.partitionBy("tenant_id", "target").orderBy(F.size("n"), F.array_join("n", ">"), "e")
        ranked = first.withColumn("path_rank", F.row_number().over(shown))
        return cut(ranked.select("tenant_id", "target", F.col("n").alias("path_nodes"), F.col("e").alias("path_edges"), "path_rank", "truncated"), "trace", keep=True)


def _grow(back: DataFrame, targets: DataFrame, width: int, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """Whole paths of each target (``n`` nodes, ``e`` edges), and by target whether beginnings were ``dropped`` and whether some were too ``long``."""
    state = targets.select("tenant_id", "target", F.array("target").alias("n"), F.array().cast("array<string>").alias("e"), F.lit("live").alias("state"))
    near = back.select(F.col("tenant_id").alias("_t"), F.col("src").alias("_s"), "dst", "edge_id")
    every, tables = Window.partitionBy("tenant_id", "target"), []
    for _ in range(max_depth + 1):
        going = state.where("state = 'live'").withColumn("src", F.element_at("n", -1))
        met = going.join(near, (F.col("tenant_id") == F.col("_t")) & (F.col("src") == F.col("_s")) & ~F.array_contains("n", F.col("dst")), "left")
        on = F.col("dst").isNotNull()
        grown = met.select(
            "tenant_id",
            "target",
            F.when(on, F.concat("n", F.array("dst"))).otherwise(F.col("n")).alias("n"),
            F.when(on, F.concat("e", F.array("edge_id"))).otherwise(F.col("e")).alias("e"),
            F.when(~on, "whole").when(F.size("n") >= max_depth, "long").otherwise("live").alias("state"),
        )
        both = state.where("state = 'whole'").unionByName(grown)
        order = every.orderBy(F.col("state") == "long", "e")
        kept = both.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= width + 1)
        kept = kept.withColumns(
            {
                "dropped": F.bool_or((F.col("_r") > width) & (F.col("state") != "long")).over(every),
                "long": F.bool_or(F.col("state") == "long").over(every),
                "going": F.bool_or((F.col("state") == "live") & (F.col("_r") <= width)).over(every),
            }
        )
        table = cut(kept, "trace-round")
        tables.append(table)
        state = table.where((F.col("_r") <= width) & F.col("going") & (F.col("state") != "long")).select("tenant_id", "target", "n", "e", "state")
        if state.isEmpty():
            break
    seen = reduce(DataFrame.unionByName, tables)
    marks = seen.groupBy("tenant_id", "target").agg(F.bool_or("dropped").alias("dropped"), F.bool_or("long").alias("long"))
    return seen.where((F.col("_r") <= width) & ~F.col("going") & (F.col("state") == "whole")).select("tenant_id", "target", "n", "e"), marks


def trace_sources(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tenant_id, target, source, uri``: the distinct sources on any path of a target."""
    s = nodes.where("kind = 'Source'").select("tenant_id", F.col("id").alias("source"), "uri")
    return paths.select("tenant_id", "target", F.explode("path_nodes").alias("source")).distinct().join(s, ["tenant_id", "source"]).select("tenant_id", "target", "source", "uri")


def shortest_paths(paths: DataFrame) -> DataFrame:
    """All paths of a target that have its least length."""
    least = paths.groupBy("tenant_id", "target").agg(F.min(F.size("path_nodes")).alias("_least"))
    return paths.join(least, ["tenant_id", "target"]).where(F.size("path_nodes") == F.col("_least")).drop("_least")


def verdicts_of(nodes: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """The deciding verdict of each target: that of the lowest DECIDES edge that comes from a verdict, with its policy if there is one."""
    decides = edges.where("type = 'DECIDES'").select("tenant_id", F.col("to_id").alias("target"), F.col("id").alias("edge"), F.col("from_id").alias("verdict"))
    fields = ["verdict", "decision", "reason_codes", "method", "monitored", "policy_ref"]
    v = nodes.where("kind = 'Verdict'").select("tenant_id", F.col("id").alias("verdict"), *fields[1:])
    own = decides.join(targets.select("tenant_id", "target").distinct(), ["tenant_id", "target"], "left_semi")
    first = own.join(v, ["tenant_id", "verdict"]).groupBy("tenant_id", "target").agg(F.min_by(F.struct(*fields), "edge").alias("v"))
    p = nodes.where("kind = 'Policy'").select("tenant_id", F.col("id").alias("policy_ref"), F.col("name").alias("policy_name"), F.col("version").alias("policy_version"), F.col("content_hash").alias("policy_hash"))
    return (
        targets.select("tenant_id", "target").join(first, ["tenant_id", "target"], "left").select("tenant_id", "target", "v.*").join(p, ["tenant_id", "policy_ref"], "left")
        .select("tenant_id", "target", *fields, "policy_name", "policy_version", "policy_hash")
    )


def explain(nodes: DataFrame, edges: DataFrame, targets: DataFrame, max_paths: int = 100, max_depth: int = 64) -> DataFrame:
    """The verdict of each target and what it rests on: ``decision_paths`` are its shortest backward paths, ``sources`` the URIs on any path."""
    paths = trace(nodes, edges, targets, max_paths, max_depth)
    short = shortest_paths(paths).groupBy("tenant_id", "target").agg(F.sort_array(F.collect_list(F.struct("path_rank", "path_nodes")))["path_nodes"].alias("decision_paths"))
    uris = trace_sources(paths, nodes).groupBy("tenant_id", "target").agg(F.sort_array(F.collect_list(F.struct("source", "uri")))["uri"].alias("sources"))
    found = verdicts_of(nodes, edges, targets).join(short, ["tenant_id", "target"], "left").join(uris, ["tenant_id", "target"], "left")
    return found.withColumn("sources", F.coalesce("sources", F.array().cast("array<string>")))


def impact(nodes: DataFrame, edges: DataFrame, origins: DataFrame, max_nodes: int | None = 10_000, max_depth: int = 64, require: bool = False) -> DataFrame:
    """``tenant_id, origin, id, kind, run_id, delivered, distance, truncated`` of everything that rests on each origin, the origin excluded.

    A breadth-first frontier for all origins at once: a round joins the frontier with the edges and drops
    what was reached before; each round is written once and only read after that.  An origin reaches at most ``max_nodes``
    nodes, itself included, in the order in which they are found (that of the nodes they are reached from, then of
    ids); with None it reaches all, and nothing is put in order.  ``truncated`` tells that this limit or ``max_depth``
    cut the search short.  An origin on which nothing rests has one row with a null id.
    """
    if require:
        require_nodes(nodes, origins, "origin")
    with scope(nodes.sparkSession):
        ahead = cut(adjacency(edges, FORWARD).select("tenant_id", F.col("src").alias("id"), "dst"), "impact-adjacency")
        start = origins.select("tenant_id", "origin").distinct().select("tenant_id", "origin", F.col("origin").alias("id"), F.lit(0).alias("distance"), F.lit(1).alias("place"), F.lit(False).alias("over"))
        reached = [cut(start, "impact-origins")]
        frontier = reached[0]
        for depth in range(1, max_depth + 1):
            before = reduce(DataFrame.unionByName, reached).where("NOT over")
            grown = frontier.join(ahead, ["tenant_id", "id"]).groupBy("tenant_id", "origin", F.col("dst").alias("id")).agg(F.min("place").alias("_from"))
            new = grown.join(before.select("tenant_id", "origin", "id"), ["tenant_id", "origin", "id"], "left_anti")
            place, over = F.lit(1), F.lit(False)
            if max_nodes is not None:
                order = Window.partitionBy("tenant_id", "origin").orderBy("_from", "id")
                new = new.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= max_nodes)
                size = F.lit(1)
                if depth > 1:
                    new = new.join(before.groupBy("tenant_id", "origin").agg(F.count(F.lit(1)).alias("_size")), ["tenant_id", "origin"])
                    size = F.col("_size")
                place, over = F.col("_place"), F.col("_place") + size > max_nodes
            table = cut(new.select("tenant_id", "origin", "id", F.lit(depth).alias("distance"), place.alias("place"), over.alias("over")), "impact-round")
            state = [r["over"] for r in table.select("over").distinct().collect()]
            if not state:
                break
            reached.append(table)
            frontier = table.where("NOT over")
            if True in state:
                frontier = frontier.join(table.where("over").select("tenant_id", "origin").distinct(), ["tenant_id", "origin"], "left_anti")
        else:
            reached.append(cut(frontier.withColumn("over", F.lit(True)), "impact-deep"))
        every = reduce(DataFrame.unionByName, reached)
        cuts = every.where("over").select("tenant_id", "origin").distinct().withColumn("truncated", F.lit(True))
        members = every.where("distance > 0 AND NOT over").select("tenant_id", "origin", "id", "distance")
        named = members.join(nodes.select("tenant_id", "id", "kind", "run_id", "delivered"), ["tenant_id", "id"])
        whole = reached[0].select("tenant_id", "origin").join(named, ["tenant_id", "origin"], "left").join(cuts, ["tenant_id", "origin"], "left")
        return cut(whole.select("tenant_id", "origin", "id", "kind", "run_id", "delivered", "distance", F.coalesce("truncated", F.lit(False)).alias("truncated")), "impact", keep=True)


def impact_groups(affected: DataFrame, nodes: DataFrame) -> DataFrame:
    """``tenant_id, origin, group, id, distance, place``: affected claims, outputs, delivered outputs and runs, each by distance and id.

    A run is affected at the least distance of any of its members; sources, policies and runs are members of none.
    """
    groups = F.array_compact(
        F.array(
            F.when(F.col("kind") == "Claim", "claims"),
            F.when(F.col("kind") == "Output", "outputs"),
            F.when((F.col("kind") == "Output") & F.col("delivered"), "delivered_outputs"),
        )
    )
    listed = affected.select("tenant_id", "origin", F.explode(groups).alias("group"), "id", "distance")
    inside = affected.where(~F.col("kind").isin("Source", "Policy", "Run")).groupBy("tenant_id", "origin", F.col("run_id").alias("id")).agg(F.min("distance").alias("distance"))
    runs = inside.join(nodes.where("kind = 'Run'").select("tenant_id", "id"), ["tenant_id", "id"]).select("tenant_id", "origin", F.lit("runs").alias("group"), "id", "distance")
    order = Window.partitionBy("tenant_id", "origin", "group").orderBy("distance", "id")
    return listed.unionByName(runs).withColumn("place", F.row_number().over(order))
