"""Content-derived ids as Catalyst expressions: SHA-256 over a compact canonical JSON."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.functions.errors import GraphError

TENANT = re.compile(r"[a-z0-9][a-z0-9_-]*")
#: An id: tenant, kind (of an edge: ``edge.`` and its type) and digest.
ID = r"pg:([a-z0-9][a-z0-9_-]*):([A-Za-z_.]+):([0-9a-f]{32})"

#: Fields of each node kind's identity, sorted by name; integers are written bare.
IDENTITY = {
    "Source": ["sourceKind", "uri"],
    "Run": ["runKey"],
    "Step": ["index", "runId"],
    "Artifact": ["contentHash", "runId"],
    "Chunk": ["contentHash", "ordinal", "runId"],
    "Claim": ["outputRef", "runId", "spanEnd", "spanStart"],
    "Policy": ["name", "version"],
    "Verdict": ["policyRef", "runId", "targetRef"],
    "Output": ["contentHash", "runId"],
}
#: Column of the node table that holds a field.
COLUMN = {
    "sourceKind": "source_kind", "uri": "uri", "runKey": "run_key", "index": "step_index", "runId": "run_id", "contentHash": "content_hash", "ordinal": "ordinal",
    "outputRef": "output_ref", "spanEnd": "span_end", "spanStart": "span_start", "name": "name", "version": "version", "policyRef": "policy_ref", "targetRef": "target_ref",
}
NUMERIC = {"index", "ordinal", "spanStart", "spanEnd"}


def assert_tenant(tenant: str) -> str:
    if not TENANT.fullmatch(tenant):
        raise GraphError("GRAPH_SCHEMA_INVALID", f"not a tenant id: {tenant!r}")
    return tenant


def parse_graph_id(text: str) -> tuple[str, str, str]:
    """Tenant, kind and digest of an id."""
    m = re.fullmatch(ID, text)
    if not m:
        raise GraphError("GRAPH_SCHEMA_INVALID", f"not a graph id: {text!r}")
    return m.group(1), m.group(2), m.group(3)


def id_parts(c: Column) -> Column:
    """``tenant, kind, digest`` of an id as a struct; null for what is none."""
    part = lambda i, name: F.regexp_extract(c, rf"\A{ID}\z", i).alias(name)
    return F.when(c.rlike(rf"\A{ID}\z"), F.struct(part(1, "tenant"), part(2, "kind"), part(3, "digest")))


def is_id_for_tenant(c: Column, tenant: Column) -> Column:
    return F.coalesce(id_parts(c)["tenant"] == tenant, F.lit(False))


def json_string(c: Column) -> Column:
    """A JSON string as compact writers make it: control characters in lower-case hexadecimal."""
    j = F.to_json(F.array(c))
    j = F.substring(j, F.lit(2), F.length(j) - 2)
    for code in (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20)):
        j = F.replace(j, F.lit(f"\\u{code:04X}"), F.lit(f"\\u{code:04x}"))
    return j


def content_digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def derive_id(tenant: Column, kind: str, fields: dict[str, Column]) -> Column:
    """``pg:tenant:kind:hex``; fields are taken in the order of their names."""
    parts = [F.concat(F.lit(f'["{n}",'), v.cast("string") if n in NUMERIC else json_string(v), F.lit("]")) for n, v in sorted(fields.items(), key=lambda f: f[0])]
    body = F.concat(F.lit('[1,"'), tenant, F.lit(f'","{kind}",['), F.concat_ws(",", *parts), F.lit("]]"))
    return F.concat(F.lit("pg:"), tenant, F.lit(f":{kind}:"), F.substring(F.sha2(body, 256), 1, 32))


def expected_node_id() -> Column:
    """The id that a row of the node table should have; null where a field of its identity is null."""
    out = F.lit(None).cast("string")
    for kind, names in IDENTITY.items():
        fields = {n: F.col(COLUMN[n]) for n in names}
        known = F.lit(True)
        for c in fields.values():
            known = known & c.isNotNull()
        out = F.when((F.col("kind") == kind) & known, derive_id(F.col("tenant_id"), kind, fields)).otherwise(out)
    return out


def edge_id(tenant: Column, kind: Column, src: Column, dst: Column) -> Column:
    """The id of an edge from its type and its two ends."""
    body = F.concat(F.lit('[1,"'), tenant, F.lit('","edge.'), kind, F.lit('",[["from",'), json_string(src), F.lit('],["to",'), json_string(dst), F.lit("]]]"))
    return F.concat(F.lit("pg:"), tenant, F.lit(":edge."), kind, F.lit(":"), F.substring(F.sha2(body, 256), 1, 32))
