"""A fixed corpus of labelled runs: for each way in which context goes bad, and for good context that looks bad, one run.

Every scenario has a mechanism, a label (should the run be blocked), a difficulty, and the gate that is
expected to act.  ``basic`` shows in the shape of a payload; ``hard`` is well formed and means something
wrong; ``mixed`` carries good and bad content in one chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators import admit, classify, ground, outcome
from evidentia.operators.claims import extract_claims
from evidentia.staging import cut

AT = "2026-01-01T00:00:00.000Z"


@dataclass(frozen=True)
class Scenario:
    id: str
    difficulty: str
    provenance: str
    expectation: str
    expected_gate: str
    mechanism: str
    chunks: tuple[tuple[str, str, str, int | None], ...]
    output: str


def _s(id_: str, provenance: str, label: str, gate: str, mechanism: str, chunks: list, output: str) -> Scenario:
    difficulty = id_.split("-")[0] if id_.startswith(("hard-", "mixed-")) else "basic"
    rows = tuple((text, *(hints.split("/")[:2]), int(hints.split("/")[2]) if hints.count("/") == 2 else None) for hints, text in chunks)
    return Scenario(id_, difficulty, provenance, f"should_{label}", gate, mechanism, rows, output)


GATE = "Gate 9 reported 71 visits in Q3 2025."
SCENARIOS = [
    _s("stdout-capture", "derived", "block", "inbound", "What a command printed about its failure was stored as its result.",
       [("DIAGNOSTIC_LOG/T5/400", 'HTTP/1.1 400 Bad Request\nserver: gateway\n\nquery field "segment" is not known')],
       "Textile buyers moved to longer contracts this spring."),
    _s("http-error-body", "constructed", "block", "inbound", "An error page was stored as a document.",
       [("RETRIEVED_DOC/T5/503", "<html><head><title>503 Service Unavailable</title></head><body>The catalogue is offline.</body></html>")],
       "The catalogue lists no new entries this week."),
    _s("alert-in-history", "derived", "block", "inbound", "An alert for operators went into the conversation.",
       [("SYSTEM_ALERT/T5", "Pager: disk pressure on node 7 cleared at 04:10.")], "Node 7 has been replaced with a larger machine."),
    _s("truncated-json", "derived", "block", "inbound", "A tool's answer was cut off.",
       [("TOOL_RESULT/T5", '{"orders": [{"id": 11, "total": 40}, {"id": 12, "to')], "There were two orders with a total of 40."),
    _s("mechanical-fallback", "derived", "block", "inbound", "A stand-in text was passed on as an agent's answer.",
       [("AGENT_OUTPUT/T5", "The helper returned its usual text because the model call did not finish.")], "The helper confirmed the delivery date."),
    _s("unlabeled-enrichment", "derived", "block", "inbound", "Data without any provenance was added.",
       [("UNLABELED/T5", "Region score 0.82, segment mid-market.")], "The account scores 0.82 in its region."),
    _s("stale-cache", "constructed", "block", "inbound", "An old copy stood in for the source.",
       [("CACHE/T4", "Copy of the price list from March: grade A at 310 per tonne.")], "Grade A costs 310 per tonne."),
    _s("empty-not-denied", "derived", "block", "inbound", "An empty answer was taken for a negative one.", [("TOOL_RESULT/T5", "")], "No complaints were filed against the site."),
    _s("clean-labeled-retrieval", "constructed", "allow", "either", "A document that says what is claimed.",
       [("RETRIEVED_DOC/T1", "The Harbor Museum reopened on 3 June after repairs to its roof.")], "The Harbor Museum reopened on 3 June after repairs to its roof."),
    _s("clean-authorized-empty", "constructed", "allow", "either", "A tool that found nothing says so.",
       [("TOOL_RESULT/T2/200", '{"status": 200, "records": [], "count": 0}')], "The search for open permits found 0 records."),
    _s("hard-paraphrased-fabrication", "constructed", "block", "outbound", "All names fit and the verb is another.",
       [("RETRIEVED_DOC/T3", "Quarry Lane Clinic moved its records to a new archive in 2023.")], "Quarry Lane Clinic lost its archive in 2023."),
    _s("hard-recombined-entities", "constructed", "block", "outbound", "Names of two statements are put together.",
       [("RETRIEVED_DOC/T3", "Alder Foods hired Bram Textiles in 2021. Cedar Mills left the alliance in 2022.")], "Cedar Mills hired Alder Foods in 2021."),
    _s("hard-split-conjunction", "constructed", "block", "outbound", "Two facts are joined to a cause that nobody stated.",
       [("RETRIEVED_DOC/T3", "Valve 88 was replaced on 4 April. The pump alarm stopped on 4 April.")],
       "Valve 88 was replaced on 4 April. The replacement stopped the pump alarm for good."),
    _s("hard-unit-shift", "constructed", "block", "outbound", "The number fits and the unit does not.",
       [("RETRIEVED_DOC/T3", "The North Weir basin holds 640 megalitres of water.")], "The North Weir basin holds 640 kilolitres of water."),
    _s("hard-appended-qualifier", "constructed", "block", "outbound", "A reason is added to a fact.",
       [("RETRIEVED_DOC/T3", "Exports from Port Selby grew 9% in 2025.")], "Exports from Port Selby grew 9% in 2025 because tariffs fell."),
    _s("hard-ok-status-error-body", "constructed", "block", "inbound", "A good status over a body that holds an error.",
       [("TOOL_RESULT/T2/200", '{"ok": true, "error": {"kind": "quota", "note": "limit reached for today"}}')], "The quota has room for today."),
    _s("hard-fresh-timestamp-stale-body", "constructed", "block", "inbound", "A new date over an old text.",
       [("RETRIEVED_DOC/T3", "Rates as of January 2019: the base fee is 12 euros.")], "The base fee is 12 euros."),
    _s("hard-json-shaped-diagnostic", "constructed", "block", "inbound", "A well-formed answer that says it is a stand-in.",
       [("TOOL_RESULT/T2", '{"rows": [], "note": "fallback in use"}')], "The table has no rows today."),
    _s("hard-clean-error-vocabulary", "constructed", "allow", "either", "A good document about errors.",
       [("RETRIEVED_DOC/T3", "The export API now adds a trace number to every error it reports, so failed calls are easy to find.")],
       "The export API now adds a trace number to every error it reports."),
    _s("hard-clean-t3-support", "constructed", "allow", "either", "Support of the lowest tier that counts.",
       [("RETRIEVED_DOC/T3", "Silver members get a reply within 20 minutes.")], "Silver members get a reply within 20 minutes."),
    _s("hard-clean-entity-overlap", "constructed", "allow", "either", "Names that come up in two true statements.",
       [("RETRIEVED_DOC/T3", "Delta Pumps opened a plant in Oslo. Delta Pumps also runs a school in Bergen.")], "Delta Pumps runs a school in Bergen."),
    _s("hard-clean-authorized-empty", "constructed", "allow", "either", "An empty result within a stated scope.",
       [("TOOL_RESULT/T2/200", '{"items": [], "total": 0, "scope": "demo"}')], "The approved scan of the demo scope found 0 items."),
    _s("mixed-error-appended-to-document", "constructed", "block", "either", "A document that ends in somebody's error.",
       [("RETRIEVED_DOC/T3/200", "Unit 4 shipped 90 crates in May. The report ends here with an error from the feed.")], "The feed indicates that Unit 4 stopped shipping."),
    _s("mixed-truncated-tail", "constructed", "block", "either", "Good records before the place where the answer was cut off.",
       [("TOOL_RESULT/T2/200", '{"sites": [{"name": "Elm", "load": 7}, {"name": "Oak", "lo')], "Elm has a load of 7."),
    _s("mixed-diagnostic-interleaved", "constructed", "block", "either", "A trace between two lines of a report.",
       [("RETRIEVED_DOC/T3/200", 'Pump log for July.\nTraceback (most recent call last):\n  File "poll.py", line 3, in read\nFlow was 12 units.')], "Flow was 12 units in July."),
    _s("mixed-cross-sentence-both-grounded", "constructed", "block", "outbound", "Two true statements, of which the second gets a cause.",
       [("RETRIEVED_DOC/T3/200", "Mill Road closed on 2 May. Traffic on Lake Street doubled in June.")],
       "Mill Road closed on 2 May. Traffic on Lake Street doubled in June as a result of it."),
    _s("mixed-clean-quoted-error", "constructed", "allow", "either", "A good document that quotes an error.",
       [("RETRIEVED_DOC/T3/200", 'Ticket 31 quotes the message "disk full" and says it was solved on 6 May.')], "Report 31 was solved on 6 May."),
    _s("mixed-clean-multi-record", "constructed", "allow", "either", "One of several records is claimed.",
       [("TOOL_RESULT/T2/200", '[{"region": "North", "revenue": 510}, {"region": "South", "revenue": 275}]')], "South revenue was 275 for the quarter."),
    _s("mixed-unicode-homoglyph", "constructed", "block", "outbound", "A letter of another script in a word that is not checked.",
       [("RETRIEVED_DOC/T3/200", GATE)], "Gate 9 reported 71 visіts in Q3 2025."),
    _s("mixed-negation-flip", "constructed", "block", "outbound", "A denial of what the document says.", [("RETRIEVED_DOC/T3/200", GATE)], "Gate 9 did not report 71 visits in Q3 2025."),
    _s("mixed-contradictory-evidence", "constructed", "block", "outbound", "Two documents that contradict each other.",
       [("RETRIEVED_DOC/T3/200", GATE), ("RETRIEVED_DOC/T3/200", "Gate 9 reported 64 visits in Q3 2025.")], GATE),
    _s("mixed-fenced-code-fabrication", "constructed", "block", "outbound", "A false statement where no claims are looked for.",
       [("RETRIEVED_DOC/T3/200", GATE)], "```\nGate 9 reported 999 visits.\n```\n" + GATE),
]


def get_scenario(id_: str) -> Scenario | None:
    return next((s for s in SCENARIOS if s.id == id_), None)


def scenario_tables(spark: SparkSession, scenarios: list[Scenario] | None = None) -> tuple[DataFrame, DataFrame]:
    """``scenarios`` (run_id, labels, output) and their ``chunks`` with declared provenance."""
    own = SCENARIOS if scenarios is None else scenarios
    runs = spark.createDataFrame(
        [(s.id, s.difficulty, s.provenance, s.expectation, s.expected_gate, s.mechanism, s.output) for s in own],
        "run_id string, difficulty string, provenance string, expectation string, expected_gate string, mechanism string, output string",
    )
    chunks = spark.createDataFrame(
        [(s.id, i, f"{s.id}:chunk:{i}", *c, f"{s.id}:source", AT) for s in own for i, c in enumerate(s.chunks)],
        "run_id string, ordinal int, chunk_id string, text string, hint_channel string, hint_tier string, hint_status int, hint_source_id string, hint_retrieved_at string",
    )
    return runs, chunks


def run_scenarios(spark: SparkSession, scenarios: list[Scenario] | None = None) -> DataFrame:
    """``run_id, decision, reasons, passed`` of the outbound gate alone: claims against all chunks, as they are labelled."""
    runs, chunks = scenario_tables(spark, scenarios)
    labelled = chunks.withColumnRenamed("hint_tier", "tier")
    _, verdicts = ground.check_grounding(runs, extract_claims(runs), labelled)
    expected = F.when(F.col("expectation") == "should_block", "block").otherwise("allow")
    return verdicts.select("run_id", "decision", "reasons", (F.col("decision") == expected).alias("passed"))


def bench(spark: SparkSession, mode: str = "enforce", scenarios: list[Scenario] | None = None, control=outcome.control_evidence) -> DataFrame:
    """One row for each scenario, with guards and without; the evidence of the run without guards is checked before it counts."""
    runs, chunks = scenario_tables(spark, scenarios)
    classified = cut(classify.classify(chunks).drop("_json"), "bench-classified", keep=True)
    slots = admit.policy_slots(spark, [admit.resolve_slot("signals")])
    checked = admit.check_slot(classified, slots)
    assessed, verdicts = ground.audit_outputs(runs.select("run_id", "output"), checked.where("decision = 'allow'"))
    outcomes = outcome.run_outcomes(checked, verdicts, mode)
    evidence = control(classified, runs)
    problems = outcome.control_problems(evidence, chunks, runs).orderBy("run_id").limit(5).collect()
    if problems:
        raise ValueError("a run without guards is not what its scenario supplies: " + "; ".join(f"{r['run_id']}: {r['problem']}" for r in problems))
    shapes = classify.prepare(runs.withColumn("text", F.col("output")))
    shape = shapes.select("run_id", outcome.shape_flag(shapes).alias("flagged"))
    return cut(outcome.scenario_results(runs, outcomes, evidence, shape), "bench", keep=True)
