"""Stores of the ledger: one contract, a store that lives with the session and one in Parquet.

All reads are by tenant and come in the order of ids; what is read of one tenant never shows another's.  An
ingest is all or nothing, and of elements with one id the last one ingested counts.
"""

from __future__ import annotations

import uuid
from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.errors import GraphError
from evidentia.functions.ids import assert_tenant
from evidentia.operators.ledger import EDGE_COLUMNS, NODE_COLUMNS, NODE_SCHEMA, redact
from evidentia.operators.validate import MALFORMED, REJECTING, assert_sound, assert_tenant_scoped, refuse
from evidentia.sources.graph_files import EDGE_SCHEMA
from evidentia.staging import cut


def resolve_raw_text(value: object) -> bool:
    """The option whether texts are kept: off unless it is a plain yes; anything but a boolean is refused."""
    if value is None:
        return False
    if not isinstance(value, bool):
        raise GraphError("GRAPH_SCHEMA_INVALID", f"persist_raw_text is a boolean, not {type(value).__name__}")
    return value


class GraphStore(ABC):
    """What every store does.  ``capabilities``: transactions, persistent, max_batch_size (None: any)."""

    name: str
    capabilities: dict[str, object]

    @abstractmethod
    def _tables(self) -> tuple[DataFrame, DataFrame]:
        """All nodes and edges."""

    @abstractmethod
    def _replace(self, nodes: DataFrame, edges: DataFrame) -> None:
        """Make these the content, at once."""

    def ingest(self, tenant: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Add elements of one tenant; elements of another, malformed ones and graphs that cannot be loaded are refused before anything is written."""
        assert_tenant(tenant)
        assert_tenant_scoped(nodes, edges, tenant)
        refuse(nodes, edges, [*MALFORMED, *[c for c in REJECTING if c not in MALFORMED]], f"ingest into {self.name}")
        self._apply(nodes, edges)

    def _apply(self, nodes: DataFrame, edges: DataFrame) -> None:
        old_nodes, old_edges = self._tables()
        newer = lambda old, new, columns: old.join(new.select("id"), "id", "left_anti").select(columns).unionByName(new.select(columns).dropDuplicates(["id"]))
        self._replace(newer(old_nodes, nodes, NODE_COLUMNS), newer(old_edges, edges, EDGE_COLUMNS))

    def nodes(self, tenant: str, kind: str | None = None) -> DataFrame:
        own = self._tables()[0].where(F.col("tenant_id") == assert_tenant(tenant))
        return (own if kind is None else own.where(F.col("kind") == kind)).orderBy("id")

    def edges(self, tenant: str, type_: str | None = None) -> DataFrame:
        own = self._tables()[1].where(F.col("tenant_id") == assert_tenant(tenant))
        return (own if type_ is None else own.where(F.col("type") == type_)).orderBy("id")

    def node(self, tenant: str, id_: str) -> dict | None:
        found = self.nodes(tenant).where(F.col("id") == id_).first()
        return None if found is None else found.asDict()

    def require_node(self, tenant: str, id_: str) -> dict:
        found = self.node(tenant, id_)
        if found is None:
            raise GraphError("GRAPH_REFERENCE_MISSING", f"node {id_} is not present in tenant {tenant}")
        return found

    def edge(self, tenant: str, id_: str) -> dict | None:
        found = self.edges(tenant).where(F.col("id") == id_).first()
        return None if found is None else found.asDict()

    def outgoing(self, tenant: str, id_: str, type_: str | None = None) -> DataFrame:
        return self.edges(tenant, type_).where(F.col("from_id") == id_)

    def incoming(self, tenant: str, id_: str, type_: str | None = None) -> DataFrame:
        return self.edges(tenant, type_).where(F.col("to_id") == id_)

    def snapshot(self, tenant: str) -> tuple[DataFrame, DataFrame]:
        return self.nodes(tenant), self.edges(tenant)

    def tenants(self) -> list[str]:
        return [r["tenant_id"] for r in self._tables()[0].select("tenant_id").distinct().orderBy("tenant_id").collect()]

    def size(self) -> dict[str, int]:
        nodes, edges = self._tables()
        return {"nodes": nodes.count(), "edges": edges.count()}

    @abstractmethod
    def close(self) -> None: ...


class FrameStore(GraphStore):
    """A store for a session: its tables are cut into the shared folder."""

    name = "frame"

    def __init__(self, spark: SparkSession, nodes: DataFrame | None = None, edges: DataFrame | None = None):
        self.spark = spark
        self.capabilities = {"transactions": True, "persistent": False, "max_batch_size": None}
        self.close()
        if nodes is not None and edges is not None:
            self.load(nodes, edges)

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        return self._content

    def _replace(self, nodes: DataFrame, edges: DataFrame) -> None:
        self._content = (cut(nodes, "store-nodes", keep=True), cut(edges, "store-edges", keep=True))

    def load(self, nodes: DataFrame, edges: DataFrame) -> FrameStore:
        """Add a graph of any tenants that can be loaded."""
        refuse(nodes, edges, REJECTING, "load the graph")
        self._apply(nodes, edges)
        return self

    def load_unchecked(self, nodes: DataFrame, edges: DataFrame) -> FrameStore:
        """Add a graph as it is, to look at what is wrong with it."""
        self._apply(nodes, edges)
        return self

    def close(self) -> None:
        self._content = (self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA))


class ParquetStore(GraphStore):
    """A store that outlives the session: versions of both tables under one folder, and a pointer to the one that counts.

    A version is written beside the others and the pointer is moved after that, so a failed ingest or a lost executor
    leaves the content as it was.  Tables are partitioned by tenant and by kind or type.  Texts are only kept if
    ``persist_raw_text`` says so.  There is one writer at a time.
    """

    name = "parquet"

    def __init__(self, spark: SparkSession, path: str, persist_raw_text: object = None):
        self.spark, self.path, self.raw = spark, path.rstrip("/"), resolve_raw_text(persist_raw_text)
        self.capabilities = {"transactions": True, "persistent": True, "max_batch_size": None}

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def _current(self) -> str | None:
        fs, root = self._fs(f"{self.path}/current")
        if not fs.exists(root):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(root))
        return names[-1].split("-", 1)[1] if names else None

    def _tables(self) -> tuple[DataFrame, DataFrame]:
        version = self._current()
        if version is None:
            return self.spark.createDataFrame([], NODE_SCHEMA), self.spark.createDataFrame([], EDGE_SCHEMA)
        read = lambda name, schema, columns: self.spark.read.schema(schema).parquet(f"{self.path}/{version}/{name}").select(columns)
        return read("nodes", NODE_SCHEMA, NODE_COLUMNS), read("edges", EDGE_SCHEMA, EDGE_COLUMNS)

    def _replace(self, nodes: DataFrame, edges: DataFrame) -> None:
        old, version = self._current(), f"v{uuid.uuid4().hex}"
        (nodes if self.raw else redact(nodes)).write.partitionBy("tenant_id", "kind").parquet(f"{self.path}/{version}/nodes")
        edges.write.partitionBy("tenant_id", "type").parquet(f"{self.path}/{version}/edges")
        fs, root = self._fs(f"{self.path}/current")
        at = max((int(s.getPath().getName().split("-")[0]) for s in fs.listStatus(root)), default=0) + 1 if fs.exists(root) else 1
        pointer = self._fs(f"{self.path}/current/{at:012d}-{version}")[1]
        fs.create(pointer, False).close()  # this is the moment at which the new version counts
        for s in fs.listStatus(root):
            if s.getPath().getName() != pointer.getName():
                fs.delete(s.getPath(), False)
        if old is not None:
            fs.delete(self._fs(f"{self.path}/{old}")[1], True)

    def ingest(self, tenant: str, nodes: DataFrame, edges: DataFrame) -> None:
        assert_sound(nodes)
        super().ingest(tenant, nodes, edges)

    def clear(self, tenant: str) -> None:
        """Remove what belongs to a tenant."""
        assert_tenant(tenant)
        nodes, edges = self._tables()
        other = F.col("tenant_id") != tenant
        self._replace(nodes.where(other), edges.where(other))

    def close(self) -> None:
        return None
