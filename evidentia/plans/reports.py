"""Texts for people: tables, breakdowns and the results of commands."""

from __future__ import annotations

from collections import Counter

from evidentia.operators.outcome import DIFFICULTIES, PROVENANCES

#: The columns of the bench table, and the columns of results that they show.
TABLE = {
    "id": "run_id", "difficulty": "difficulty", "provenance": "provenance", "expected": "expected", "actual": "actual", "pass": "passed", "expected_gate": "expected_gate",
    "actual_gate": "actual_gate", "reason": "reason_code", "stage": "stage", "guard_effect": "guard_effect", "shape_check": "shape_baseline",
}


def padded(rows: list[list[str]]) -> list[str]:
    widths = [max(map(len, column)) for column in zip(*rows, strict=True)]
    return ["  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=True)).rstrip() for row in rows]


def breakdown(counts: dict[str, int]) -> str:
    """Non-zero counts in the order in which they came up."""
    return ", ".join(f"{k}={v}" for k, v in counts.items() if v)


def bench_table(results: list[dict], recall: list[dict], false_positive: list[dict], warnings: list[str]) -> str:
    """The table of scenarios with all rates; results come in the order of the corpus."""
    show = {True: "pass", False: "fail", None: "-"}
    rows = [list(TABLE), *[[show.get(r[c], r[c]) if not isinstance(r[c], str) else r[c] for c in TABLE.values()] for r in results]]
    by = {(r["difficulty"], r["provenance"]): r["label"] for r in recall}
    fp = {r["difficulty"]: r["label"] for r in false_positive}
    block = [r for r in results if r["expected"] == "should_block"]
    would = [r for r in results if r["would_block"]]
    count = lambda names, values: {**dict.fromkeys(names, 0), **Counter(values)}
    changed = sum(r["guard_effect"] == "changed" for r in block)
    share = f"{changed}/{len(block)} ({100 * changed / len(block):.1f}%)" if block else "n/a (0 scenarios)"
    lines = [
        "",
        "recall on block scenarios:",
        *[f"  {d} {p}: {by[d, p]}" for d in DIFFICULTIES for p in PROVENANCES],
        "false-positive rate on controls:",
        *[f"  {d}: {fp[d]}" for d in DIFFICULTIES],
        f"outbound gate validations: {sum(r['expected_gate'] == r['actual_gate'] == 'outbound' for r in block)}",
        f"expected gate breakdown: {breakdown(count(['inbound', 'outbound', 'either'], [r['expected_gate'] for r in results]))}",
        f"actual gate breakdown: {breakdown(count(['inbound', 'outbound', 'none'], [r['actual_gate'] for r in results]))}",
        f"expected->actual gate breakdown: {breakdown(Counter(r['expected_gate'] + '->' + r['actual_gate'] for r in results))}",
        f"stage breakdown: {breakdown(count(['inbound', 'outbound', 'none'], [r['stage'] for r in would]))}",
        f"reason breakdown: {breakdown(Counter(r['reason_code'] for r in would if r['reason_code']))}",
        f"guard changed the outcome on: {share} of block scenarios",
        f"disabled-control invocations: {len(results)}",
        f"shape-check baseline catches: {sum(r['shape_baseline'] == 'catch' for r in block)}",
        "not measured, true by construction: an unguarded pipeline withholds nothing",
        *(["", *warnings] if warnings else []),
    ]
    return "\n".join(padded(rows) + lines)


def check_text(result: dict) -> str:
    codes = lambda verdict: ", ".join(r["code"] for r in verdict["reasons"]) or "-"
    lines = [
        f"outcome: {result['outcome']}",
        f"monitor: {'on' if result['monitor'] else 'off'}",
        f"would_block: {'yes' if result['wouldBlock'] else 'no'}",
        *[f"inbound {v['chunkId']}: {v['verdict']['decision']} [{codes(v['verdict'])}]" for v in result["inboundVerdicts"]],
        f"outbound: {result['outboundVerdict']['decision']} [{codes(result['outboundVerdict'])}]",
    ]
    return "\n".join(lines)


def described(node: dict | None, id_: str) -> str:
    """One line about a node."""
    if node is None:
        return f"{id_} (missing)"
    special = {
        "Source": lambda: f"Source {node['uri']}",
        "Chunk": lambda: f"Chunk {node['channel']}/{node['tier']} {'admitted' if node['admitted'] else 'REFUSED'} {id_}",
        "Artifact": lambda: f"Artifact {node['content_hash']}",
        "Output": lambda: f"Output {'delivered' if node['delivered'] else 'not delivered'} {id_}",
        "Step": lambda: f"Step {node['step_kind']} {node['name']}",
    }
    return special.get(node["kind"], lambda: f"{node['kind']} {id_}")()


def trace_text(target: dict, paths: list[dict], nodes: dict[str, dict], types: dict[str, str], sources: list[str], truncated: bool) -> str:
    """``paths`` in their order; ``nodes`` and ``types`` by id of a node and of an edge."""
    lines = [f"target: {target['id']}", f"kind: {target['kind']}"]
    if all(len(p["path_nodes"]) == 1 for p in paths):
        lines.append("no supporting path: this target does not rest on any recorded evidence")
    else:
        lines.append(f"paths: {len(paths)}")
        for i, p in enumerate(paths):
            lines.append(f"  path {i + 1}:")
            for k, id_ in enumerate(p["path_nodes"]):
                arrow = "" if k == 0 else f"  -[{types.get(p['path_edges'][k - 1], '?')}]-> "
                lines.append(f"    {arrow}{described(nodes.get(id_), id_)}")
    lines.append(f"sources: {', '.join(sources) or '-'}")
    if truncated:
        lines.append("truncated: yes (bounds reached; these paths are not exhaustive)")
    return "\n".join(lines)


def explain_text(target: dict, said: dict, nodes: dict[str, dict]) -> str:
    lines = [f"target: {target['id']}", f"kind: {target['kind']}"]
    if said["verdict"] is None:
        lines.append("verdict: none recorded")
    else:
        lines += [f"decision: {said['decision']}", f"method: {said['method']}", f"mode: {'monitor' if said['monitored'] else 'enforce'}"]
        if said["monitored"] and said["decision"] != "allow":
            lines.append("note: recorded in monitor mode, so this decision was not enforced")
        lines.append(f"reasons: {', '.join(said['reason_codes'] or []) or '-'}")
    lines.append("policy: none recorded" if said["policy_name"] is None else f"policy: {said['policy_name']}@{said['policy_version']} ({said['policy_hash']})")
    paths = said["decision_paths"] or []
    lines.append("evidence:" if paths else "evidence: none recorded")
    return "\n".join(lines + [f"  {described(nodes.get(id_), id_)}" for p in paths for id_ in p])


def impact_text(origin: dict, groups: dict[str, list[dict]], truncated: bool) -> str:
    """``groups`` by name, each in its order, with id, distance and, of outputs, delivered."""
    claims, outputs, runs = (groups.get(g, []) for g in ("claims", "outputs", "runs"))
    lines = [
        f"origin: {origin['id']}",
        f"kind: {origin['kind']}",
        f"affected claims: {len(claims)}",
        *[f"  {r['id']} (distance {r['distance']})" for r in claims],
        f"affected outputs: {len(outputs)}",
        *[f"  {r['id']} (distance {r['distance']}, {'delivered' if r['delivered'] else 'not delivered'})" for r in outputs],
        f"delivered outputs: {len(groups.get('delivered_outputs', []))}",
        f"affected runs: {len(runs)}",
        *[f"  {r['id']} (distance {r['distance']})" for r in runs],
    ]
    return "\n".join(lines + (["truncated: yes (bounds reached; this list is not exhaustive)"] if truncated else []))


def validation_text(violations: list[dict]) -> str:
    if not violations:
        return "graph valid: no violations"
    head = f"graph invalid: {len(violations)} violation{'' if len(violations) == 1 else 's'}"
    return "\n".join([head, *[f"  {v['code']} {v['element_type']} {v['element_id']}: {v['message']}" for v in violations]])
