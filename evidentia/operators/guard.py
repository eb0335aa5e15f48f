"""Both gates as one object for callers that run them inline, over many runs at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions.ids import assert_tenant, content_digest
from evidentia.operators import admit, classify, ground, ledger, outcome
from evidentia.operators.claims import extract_claims
from evidentia.operators.judge import Judge, ask
from evidentia.staging import cut

EPOCH = "1970-01-01T00:00:00.000Z"


class InboundGate(Protocol):
    """Chunks with hints in, chunks with verdicts for a slot out."""

    def __call__(self, chunks: DataFrame, slots: DataFrame) -> DataFrame: ...


class OutboundGate(Protocol):
    """Outputs and admitted chunks in, assessments and verdicts out."""

    def __call__(self, outputs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]: ...


def inbound_gate(chunks: DataFrame, slots: DataFrame) -> DataFrame:
    return admit.check_slot(classify.classify(chunks), slots)


def outbound_gate(outputs: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ground.audit_outputs(outputs, chunks)


class Tracer(Protocol):
    """Whatever receives spans; what it raises is ignored."""

    def span(self, name: str, attributes: dict[str, str]) -> None: ...


@dataclass
class GuardRun:
    """What a guard did with runs: chunks with verdicts, claims with assessments, and what became of each run."""

    checked: DataFrame
    assessed: DataFrame
    delivery: DataFrame
    nodes: DataFrame
    edges: DataFrame
    spans: DataFrame


@dataclass
class Guard:
    """Two gates with one policy and mode.

    A chunk that the policy refuses is no evidence in either mode; in the mode monitor it still reaches the
    context and every output is delivered.  What is decided is the same in both modes.
    """

    mode: str = "enforce"
    tenant: str = "local"
    policy: admit.Policy | None = None
    slot: str = "signals"
    policy_name: str = "default"
    policy_version: str = "1"
    judge: Judge | None = None
    observed_at: str = EPOCH
    inbound: InboundGate = field(default=inbound_gate)

    def __post_init__(self) -> None:
        if self.mode not in ("enforce", "monitor"):
            raise ValueError(f"no such mode: {self.mode!r}")
        assert_tenant(self.tenant)
        self._slot = admit.resolve_slot(self.slot, self.policy)

    def admit_context(self, chunks: DataFrame) -> DataFrame:
        """``chunks`` with their verdicts, ``would_refuse``, and ``refused``: whether the chunk stays out of the context."""
        checked = self.inbound(chunks, admit.policy_slots(chunks.sparkSession, [self._slot]))
        would = F.col("decision") != "allow"
        return checked.withColumns({"would_refuse": would, "refused": would & F.lit(self.mode == "enforce")})

    def run(self, chunks: DataFrame, outputs: DataFrame) -> GuardRun:
        """Admit ``chunks`` (run_id, ordinal, text, hints), audit ``outputs`` (run_id, output), and build the lineage.

        ``delivery``: run_id, decision, delivered, monitored, reasons, mode.  The output alone decides; a refused chunk only cannot
        support it.  Verdicts and assessments are written to the shared folder once.
        """
        checked = cut(self.admit_context(chunks).drop("_json"), "guard-checked", keep=True)
        found = ground.assess_claims(extract_claims(outputs), checked.where(~F.col("would_refuse")))
        if self.judge is not None:
            found = ask(found, checked.where(~F.col("would_refuse")), self.judge)
        assessed = cut(found, "guard-assessed", keep=True)
        verdicts = ground.run_verdicts(outputs.select("run_id", "output"), assessed)
        monitored = F.lit(self.mode == "monitor")
        delivery = verdicts.select("run_id", "decision", ((F.col("decision") == "allow") | monitored).alias("delivered"), monitored.alias("monitored"), "reasons", F.lit(self.mode).alias("mode"))
        outcomes = outcome.run_outcomes(checked, verdicts, self.mode, inbound_blocks=False)
        own = outputs.select("run_id", F.lit(self.slot).alias("slot"), "output")
        hashed = content_digest(F.lit(admit.policy_json(self.policy)))
        runs, kept, claims = ledger.run_audit(
            own, checked, assessed, outcomes, self.tenant, self.observed_at, self.mode, self.policy_version, with_hashes=False, policy_name=self.policy_name
        )
        nodes, edges = ledger.build_graph(runs.withColumn("policy_hash", hashed), kept, claims)
        return GuardRun(checked, assessed, delivery, nodes, edges, run_spans(checked, assessed, delivery, self.mode))


def run_spans(checked: DataFrame, assessed: DataFrame, delivery: DataFrame, mode: str) -> DataFrame:
    """``run_id, span, attributes``: what both gates of a run report, two rows for each run."""
    text = lambda c: c.cast("string")
    pairs = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k.replace("__", ".")), v)])
    context = F.count_if(~F.col("refused"))
    inbound = checked.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), context.alias("a"), F.count_if("would_refuse").alias("w"))
    claims = assessed.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"))
    first = delivery.select("run_id").join(inbound, "run_id", "left").select(
        "run_id", F.lit("guard.inbound").alias("span"),
        pairs(mode=F.lit(mode), chunks__candidates=text(F.coalesce("n", F.lit(0))), chunks__admitted=text(F.coalesce("a", F.lit(0))), chunks__would_refuse=text(F.coalesce("w", F.lit(0)))).alias("attributes"),
    )
    second = delivery.join(claims, "run_id", "left").select(
        "run_id", F.lit("guard.outbound").alias("span"),
        pairs(mode=F.lit(mode), decision=F.col("decision"), delivered=text(F.col("delivered")), claims=text(F.coalesce("n", F.lit(0))), reason_codes=F.array_join("reasons", ",")).alias("attributes"),
    )
    return first.unionByName(second)


def emit(spans: DataFrame, tracer: Tracer | None) -> int:
    """Hand spans to a tracer one by one, a partition at a time, and return how many it took; a broken tracer breaks nothing."""
    if tracer is None:
        return 0
    rows: Iterator = spans.orderBy("run_id", "span").toLocalIterator()
    taken = 0
    for r in rows:
        try:
            tracer.span(r["span"], dict(r["attributes"]))
            taken += 1
        except Exception:  # noqa: S112
            continue
    return taken
