"""The ledger as files: canonical JSON (one document) and JSON lines (a header, then an element a line).

Elements are made and read by expressions, so lines are written and read in parallel.  A canonical
document is one file by definition: ``write_canonical`` streams it through one task, element by element,
and ``canonical_json`` makes one value of it, for graphs that fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.errors import GraphError
from evidentia.functions.ids import json_string
from evidentia.operators.ledger import NODE_SCHEMA, redact
from evidentia.operators.validate import bad_edge, bad_node

EDGE_SCHEMA = "tenant_id string, id string, type string, schema_version int, from_id string, to_id string, observed_at string, note string"
#: Element fields whose name is not the column's in camel case.
NAMES = {"step_index": "index", "from_id": "from", "to_id": "to"}
VERSION = 1


class GraphFormatError(GraphError):
    """A file that is not a graph of this schema version."""

    def __init__(self, message: str, details: list[str] | None = None):
        super().__init__("GRAPH_SCHEMA_INVALID", message, details)


def _fields(schema: str) -> list[tuple[str, str, str]]:
    """Column, type and element field, by the name of the field."""
    out = []
    for part in schema.split(", "):
        column, kind = part.split()
        first, *rest = column.split("_")
        out.append((column, kind, NAMES.get(column, first + "".join(w.capitalize() for w in rest))))
    return sorted(out, key=lambda f: f[2])


def _value(column: str, kind: str) -> Column:
    c = F.col(column)
    if kind == "string":
        return json_string(c)
    if kind.startswith("array"):
        return F.concat(F.lit("["), F.array_join(F.transform(c, json_string), ","), F.lit("]"))
    return c.cast("string")


def element_json(schema: str) -> Column:
    """The compact element with fields in the order of their names; nulls are left out."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{name}":'), _value(c, kind))) for c, kind, name in _fields(schema)]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def _lines(nodes: DataFrame, edges: DataFrame, redacted: bool) -> DataFrame:
    shown = redact(nodes) if redacted else nodes
    n = shown.select(F.lit(1).alias("part"), "id", element_json(NODE_SCHEMA).alias("element"))
    return n.unionByName(edges.select(F.lit(2).alias("part"), "id", element_json(EDGE_SCHEMA).alias("element")))


def write_jsonl(nodes: DataFrame, edges: DataFrame, path: str, redacted: bool = True) -> None:
    """Header, nodes by id, edges by id; range-partitioned, so part files in order are the whole file in order."""
    kind = F.when(F.col("part") == 1, "node").otherwise("edge")
    body = _lines(nodes, edges, redacted).select("part", "id", F.concat(F.lit('{"type":"'), kind, F.lit('","element":'), "element", F.lit("}")).alias("value"))
    header = f'{{"type":"header","schemaVersion":{VERSION},"redacted":{str(redacted).lower()}}}'
    head = nodes.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("id"), F.lit(header).alias("value"))
    head.unionByName(body).orderBy("part", "id").select("value").write.text(path)


def canonical_json(nodes: DataFrame, edges: DataFrame, redacted: bool = True) -> DataFrame:
    """One row, ``value``: version, redaction, then nodes and edges by id, each element with its fields by name."""
    own = lambda part: F.array_join(F.sort_array(F.collect_list(F.when(F.col("part") == part, F.struct("id", "element"))))["element"], ",")
    both = _lines(nodes, edges, redacted).agg(own(1).alias("n"), own(2).alias("e"))
    return both.select(F.concat(F.lit(_head(redacted)), "n", F.lit('],"edges":['), "e", F.lit("]}")).alias("value"))


def _head(redacted: bool) -> str:
    return f'{{"schemaVersion":{VERSION},"redacted":{str(redacted).lower()},"nodes":['


def write_canonical(nodes: DataFrame, edges: DataFrame, path: str, redacted: bool = True) -> None:
    """The canonical document as one text file in the folder ``path``: one task sorts and writes it and holds an element at a time.

    Every element and the document itself end in a brace, so that is what the writer puts after each row.
    """
    body = _lines(nodes, edges, redacted)
    first = {r["part"]: r["id"] for r in body.groupBy("part").agg(F.min("id").alias("id")).collect()}  # two rows
    begin = {1: _head(redacted), 2: '],"edges":['}
    last = "".join(begin[p] for p in (1, 2) if p not in first) + "]"
    if 1 not in first:
        begin[2], last = begin[1] + begin[2], last if 2 not in first else "]"
    lead = F.lit(",")
    for part, id_ in first.items():
        lead = F.when((F.col("part") == part) & (F.col("id") == id_), begin[part]).otherwise(lead)
    rows = body.select("part", "id", F.concat(lead, F.substring("element", F.lit(1), F.length("element") - 1)).alias("value"))
    tail = nodes.sparkSession.createDataFrame([(3, "", last)], "part int, id string, value string")
    rows.unionByName(tail).repartition(1).sortWithinPartitions("part", "id").select("value").write.option("lineSep", "}").text(path)


def _element(schema: str) -> str:
    return ", ".join(f"`{name}`: {kind}" for _, kind, name in _fields(schema))


def _table(elements: DataFrame, schema: str) -> DataFrame:
    by = {c: (kind, name) for c, kind, name in _fields(schema)}
    order = [p.split()[0] for p in schema.split(", ")]
    return elements.select(*[F.col(f"x.`{by[c][1]}`").cast(by[c][0]).alias(c) for c in order])


def _parsed(records: DataFrame, schema: str) -> DataFrame:
    """Typed rows of the column ``element``; an element that does not parse fails the read."""
    x = F.from_json("element", f"struct<{_element(schema)}>", {"mode": "FAILFAST"}).alias("x")
    return _table(records.select(x), schema)


def _checked(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The tables, unless an element does not have the shape of its kind."""
    bad = nodes.where(bad_node()).select("id").unionByName(edges.where(bad_edge()).select("id")).orderBy("id").limit(10).collect()
    if bad:
        raise GraphFormatError("elements do not have the shape of their kind", [str(r["id"]) for r in bad])
    return nodes, edges


def _version(found: list) -> None:
    if not found:
        raise GraphFormatError("the graph has no header")
    if any(v != str(VERSION) for v in found):
        raise GraphFormatError(f"unsupported schema version: {found}")


def read_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables; blank lines are skipped, a missing header, another version or an unknown type is an error."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    r = lines.select(F.from_json("value", "type string, schemaVersion string, element string", {"mode": "FAILFAST"}).alias("r")).select("r.*")
    kinds = r.groupBy("type").agg(F.collect_set("schemaVersion").alias("v")).collect()  # a row a type
    unknown = [k["type"] for k in kinds if k["type"] not in ("header", "node", "edge")]
    if unknown:
        raise GraphFormatError(f"unknown record type: {unknown[0]!r}")
    _version(next((list(k["v"]) or ["none"] for k in kinds if k["type"] == "header"), []))
    return _checked(_parsed(r.where("type = 'node'"), NODE_SCHEMA), _parsed(r.where("type = 'edge'"), EDGE_SCHEMA))


def read_canonical(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables of canonical documents, one a file."""
    whole = spark.read.text(path, wholetext=True)
    d = whole.select(F.from_json("value", "schemaVersion string, nodes array<string>, edges array<string>", {"mode": "FAILFAST"}).alias("d")).select("d.*")
    state = d.agg(F.collect_set(F.coalesce("schemaVersion", F.lit("none"))).alias("v"), F.count_if(F.col("nodes").isNull() | F.col("edges").isNull()).alias("bad")).first()
    _version(list(state["v"]))
    if state["bad"]:
        raise GraphFormatError("a graph needs nodes and edges")
    return _checked(_parsed(d.select(F.explode("nodes").alias("element")), NODE_SCHEMA), _parsed(d.select(F.explode("edges").alias("element")), EDGE_SCHEMA))
