"""The engine's queries in DuckDB SQL, over the same tables and the same shapes as in ``tables``."""

from __future__ import annotations

from evidentia.functions import text as T
from evidentia.functions.jsonfacts import DEGRADED
from evidentia.operators import classify, outcome
from evidentia.operators.claims import ABBREVIATIONS
from evidentia.operators.ledger import BACKWARD, FORWARD, NODE_SCHEMA, SOURCE_KINDS
from evidentia.plans.scenarios import SCENARIOS
from evidentia.plans.tables import AT, CHANNELS, LEDGER, LINES, SHAPES


def q(s: str) -> str:
    """A SQL string; control characters are put in by ``chr``."""
    out = "'" + s.replace("'", "''") + "'"
    for c in "\n\t\r":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return out


# White space as an RE2 class, and the parts of patterns that Java spells otherwise.
W = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NW = "[^" + W[1:]


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"


def listed(words: list[str]) -> str:
    return ",".join(q(w) for w in words)


def ordered(c: str) -> str:
    """The distinct members of a list in the order in which they come up."""
    return f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"


def fold(c: str) -> str:
    return f"replace(translate({c}, {q(T._FOLD_FROM + T._FOLD_SPACE)}, {q(T._FOLD_TO + ' ' * len(T._FOLD_SPACE))}), chr(8230), '...')"


def normal(c: str) -> str:
    return f"trim(regexp_replace(lower({fold(c)}), '[^a-z0-9]+', ' ', 'g'))"


def tokens_of(n: str) -> str:
    return f"CASE WHEN {n} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split({n}, ' ') END"


def content_of(t: str) -> str:
    return f"list_filter({t}, lambda x: length(x) > 2 AND x NOT IN ({listed(T.STOPWORDS)}))"


def numbers(c: str) -> str:
    f = fold(c)
    plain = rf"list_transform(regexp_extract_all({f}, '\b\d[\d,]*(?:\.\d+)?\b'), lambda x: replace(x, ',', ''))"
    return rf"list_concat(regexp_extract_all({f}, '\b\d+(?:\.\d+){{2,}}\b'), {plain})"


def entities(c: str) -> str:
    f = fold(c)
    named = (
        r"(regexp_matches(x, '^[A-Z]{2,}$') OR (contains(x, '_') AND regexp_matches(x, '[A-Za-z]')) OR regexp_matches(x, '^[a-z]+[A-Z]') OR regexp_matches(x, '^[A-Za-z][\w-]*\.[A-Za-z][\w.]*$')"
        r" OR regexp_matches(x, '(?i)^https?://') OR regexp_matches(x, '(?i)^[\w-]+\.(?:com|org|net|io|dev|gov|edu)\b')"
        f" OR (regexp_matches(x, '^[A-Z]') AND lower(x) NOT IN ({listed(T.NOT_NAMES)})))"
    )
    words = rf"list_filter(list_transform(regexp_extract_all({f}, '[A-Za-z][\w.:/-]*'), lambda x: regexp_replace(x, '[.,;:/-]+$', '')), lambda x: {named})"
    every = rf"list_concat(list_concat(regexp_extract_all({f}, '`([^`]+)`', 1), regexp_extract_all({f}, '\"([^\"]{{2,}})\"', 1)), {words})"
    return f"list_filter(list_transform({every}, lambda x: {trim('x')}), lambda x: regexp_matches(x, '[A-Za-z]') AND {normal('x')} <> '')"


def _shape(n: int) -> str:
    before, after = SHAPES[n]
    body = "replace(replace(replace(replace(replace(t, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')" if before.startswith("{") else "t"
    return f"WHEN {n} THEN replace({q(before)}, '#', CAST(doc_id AS VARCHAR)) || {body} || {q(after)}"


VARIED = f"""
v0 AS (SELECT *, coalesce(text, '') AS t FROM documents),
v1 AS (SELECT doc_id, source, CASE doc_id % 16 {" ".join(_shape(n) for n in range(len(SHAPES)))} END AS text FROM v0),
v2 AS (SELECT doc_id, source, 0 AS part, text FROM v1 UNION ALL SELECT doc_id, source, 1, ' ' || chr(10) FROM v1 WHERE doc_id % 16 = 0),
v AS (
  SELECT doc_id, part, text, 'store:' || source AS hint_source_id, ([{listed(CHANNELS)}])[(doc_id // 16) % 8 + 1] AS hint_channel,
    CASE WHEN doc_id % 5 <> 4 THEN doc_id % 5 + 1 END AS hint_rank, CASE doc_id % 7 WHEN 0 THEN 200 WHEN 1 THEN 404 END AS hint_status
  FROM v2
)"""

_STATUS_PATHS = [f"$.{p}{k}" for p in ("", "error.", "error.error.", "error.response.", "response.", "response.error.", "response.response.") for k in ("status", "statusCode", "code", "httpStatus")]


def _status(path: str) -> str:
    n = f"TRY_CAST(json_extract_string(j, '{path}') AS DOUBLE)"
    return f"CASE WHEN json_type(j, '{path}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND {n} = floor({n}) AND {n} BETWEEN 100 AND 599 THEN CAST({n} AS INTEGER) END"


_STACK = [
    r"(?i)Traceback \(most recent call last\):", r'(?im)^\s*File ".+?", line \d+, in .+$', r"(?m)^\s*at .+ \(.+:\d+:\d+\)$", r"(?m)^\s*at [\w.$<>]+\(?.+:\d+\)?$", r'Exception in thread ".+"',
    r"(?m)^\w*(Error|Exception): .+",
]
_SHELL = [
    r"(?im)^(?:zsh|bash|sh|fish|pwsh):\s+.+", r"(?i)\b(?:command not found|No such file or directory|Permission denied)\b", r"(?im)^(?:fatal|error):\s+.+", r"(?im)^npm ERR!\s+.+",
    r"(?im)^yarn (?:error|ERR!)\s+.+", r"(?im)^pnpm ERR!\s+.+",
]


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(text, {q(p)})" for p in patterns) + ")"


def classified(v: str, n: str) -> str:
    """CTEs ``{n}_facts`` and ``{n}``: signature, status, channel and rank of the chunks of ``v`` (text and hints)."""
    brackets = r"regexp_replace(regexp_replace(bare_json, '\"(?s:.*)$', ''), '[^{}\[\]]', '', 'g')"
    for _ in range(10):
        brackets = f"replace(replace({brackets}, '{{}}', ''), '[]', '')"
    density = rf"CASE WHEN len(regexp_extract_all(text, '{NW}+')) = 0 THEN CAST(0 AS DOUBLE) ELSE len(regexp_extract_all(text, '(?i)\b(?:{classify.MARKERS})\b')) / len(regexp_extract_all(text, '{NW}+')) END"
    return rf"""
{n}_0 AS (SELECT *, {trim("text")} AS trimmed FROM {v}),
{n}_1 AS (SELECT *, regexp_matches(trimmed, '^[{{\[]') AS looks, CASE WHEN regexp_matches(trimmed, '^[{{\[]') AND json_valid(trimmed) THEN trimmed END AS j FROM {n}_0),
{n}_2 AS (SELECT *, CASE WHEN looks THEN j IS NOT NULL END AS parses, coalesce({", ".join(_status(p) for p in _STATUS_PATHS)}) AS json_status,
    CASE WHEN looks AND j IS NULL THEN regexp_replace(trimmed, '"(?:[^"\\]|\\(?s:.))*"', '', 'g') END AS bare_json FROM {n}_1),
{n}_3 AS (SELECT *, CASE WHEN j IS NULL THEN false WHEN json_status NOT BETWEEN 200 AND 299 THEN true ELSE coalesce(CASE json_type(j, '$.error') WHEN 'VARCHAR' THEN json_extract_string(j, '$.error') <> ''
      WHEN 'NULL' THEN false ELSE true END AND json_type(j, '$.error') IS NOT NULL, false) END AS found,
    CASE WHEN bare_json IS NULL THEN false ELSE NOT regexp_matches({brackets}, '[}}\]]') AND (contains(bare_json, '"') OR {brackets} <> '') END AS unclosed,
    CASE WHEN j IS NULL THEN false ELSE EXISTS (SELECT 1 FROM json_tree(j) x WHERE regexp_matches(coalesce(x.key, ''), '(?i)\b(?:{DEGRADED})\b')
      OR (x.type = 'VARCHAR' AND regexp_matches(json_extract_string(x.atom, '$'), '(?i)\b(?:{DEGRADED})\b'))) END AS json_degraded FROM {n}_2),
{n}_facts AS (SELECT *,
    nullif(regexp_extract(text, '^{W}*HTTP/\d(?:\.\d)?{W}+([45]\d{{2}})\b', 1), '') AS lead,
    nullif(regexp_extract(text, '(?im)^[ \t]*([45]\d{{2}})[ \t]+(?:{classify.PHRASES})[ \t]*\r?$', 1), '') AS bare,
    CASE WHEN regexp_matches(text, '(?i)<(?:!doctype\s+html|html|head|body)\b') THEN nullif(regexp_extract(text, '(?i)<(?:title|h1)[^>]*>\s*([45]\d{{2}})\s+[^<]+?\s*</(?:title|h1)>', 1), '') END AS page,
    len(list_filter(list_slice(string_split_regex(text, '\r?\n'), 1, 8), lambda l: regexp_matches(l, '(?i)^(?:{classify.HEADERS}):\s*\S'))) > 0 AS head,
    {density} AS density, trimmed = '' AS is_empty,
    CASE WHEN j IS NOT NULL OR NOT looks THEN false ELSE unclosed OR ends_with(trimmed, '...') OR ends_with(trimmed, chr(8230)) END AS truncated,
    CASE WHEN j IS NOT NULL THEN json_degraded ELSE len(regexp_extract_all(trimmed, '{NW}+')) <= 60 AND len(regexp_extract_all(trimmed, '(?i)\b(?:{DEGRADED})\b')) >= 2 END AS degraded
  FROM {n}_3),
{n}_4 AS (SELECT *, coalesce(hint_status, CAST(lead AS INTEGER), CAST(bare AS INTEGER), CASE WHEN found THEN json_status END, CAST(page AS INTEGER)) AS status,
    (CASE WHEN lead IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN bare IS NOT NULL THEN 0.6::DOUBLE ELSE 0 END + CASE WHEN found THEN 0.8::DOUBLE ELSE 0 END
      + CASE WHEN page IS NOT NULL THEN 0.8::DOUBLE ELSE 0 END + CASE WHEN head THEN 0.3::DOUBLE ELSE 0 END + least(0.3::DOUBLE, density * 2)) >= 0.6::DOUBLE AS error FROM {n}_facts),
{n}_5 AS (SELECT *, CASE WHEN is_empty THEN 'empty' WHEN status NOT BETWEEN 200 AND 299 THEN 'non_ok_status' WHEN error THEN 'http_error' WHEN truncated THEN 'truncated_json'
    WHEN degraded THEN 'degraded_result' WHEN {_any(_STACK)} THEN 'stack_trace' WHEN {_any(_SHELL)} THEN 'shell_diagnostic' WHEN status BETWEEN 200 AND 299 THEN 'recognized_ok_status'
    ELSE 'unrecognized' END AS signature FROM {n}_4),
{n}_6 AS (SELECT *, signature NOT IN ('recognized_ok_status', 'unrecognized') AS suspicious, signature = 'recognized_ok_status' AS ok,
    CASE hint_channel WHEN 'USER_MESSAGE' THEN 1 WHEN 'TOOL_RESULT' THEN 2 WHEN 'RETRIEVED_DOC' THEN 3 WHEN 'CACHE' THEN 4 WHEN 'AGENT_OUTPUT' THEN 4 ELSE 5 END AS ceiling,
    CASE hint_channel WHEN 'TOOL_RESULT' THEN 2 WHEN 'RETRIEVED_DOC' THEN 3 WHEN 'CACHE' THEN 4 ELSE 5 END AS with_ok, sha256(text) AS d FROM {n}_5),
{n} AS (SELECT *,
    CASE WHEN signature IN ('non_ok_status', 'http_error') THEN 'SYSTEM_ALERT' WHEN signature IN ('stack_trace', 'shell_diagnostic', 'degraded_result') THEN 'DIAGNOSTIC_LOG'
      WHEN suspicious THEN 'UNLABELED' WHEN hint_channel IS NOT NULL AND (ok OR hint_rank IS NOT NULL) THEN hint_channel ELSE 'UNLABELED' END AS channel,
    CASE WHEN suspicious THEN 5 WHEN hint_channel IS NOT NULL AND hint_rank IS NOT NULL THEN greatest(hint_rank, ceiling, CASE WHEN ok THEN with_ok ELSE 1 END)
      WHEN ok AND hint_channel IS NOT NULL THEN with_ok ELSE 5 END AS rank,
    'chunk:' || substr(sha256(hint_source_id || chr(10) || 'sha256:' || d || chr(10) || text), 1, 16) AS chunk_id FROM {n}_6)"""


SLOTS = """
s AS (SELECT * FROM (VALUES ('signals', ['USER_MESSAGE','RETRIEVED_DOC','TOOL_RESULT','AGENT_OUTPUT']), ('evidence', ['RETRIEVED_DOC','TOOL_RESULT']),
  ('working_memory', ['USER_MESSAGE','RETRIEVED_DOC','TOOL_RESULT','AGENT_OUTPUT'])) t(slot, allowed))"""


def admitted(h: str, n: str) -> str:
    """CTE ``{n}``: the chunks of ``h`` by slot with ordered reasons ``r`` (code and message)."""
    reason = lambda when, code, message: f"CASE WHEN {when} THEN {{'code': '{code}', 'message': {message}}} END"
    said = "CASE WHEN status BETWEEN 200 AND 299 THEN 'status ' || status ELSE 'channel ' || channel || ' at tier T' || rank END"
    data = "(status BETWEEN 200 AND 299 OR (channel IN ('USER_MESSAGE','RETRIEVED_DOC','TOOL_RESULT','AGENT_OUTPUT') AND rank <= 3))"
    return f"""
{n} AS (
  SELECT *, list_filter([
    {reason("is_empty", "PAYLOAD_EMPTY", "'Payload is empty or whitespace-only.'")},
    {reason("truncated", "PAYLOAD_TRUNCATED", "'Payload appears to be truncated JSON.'")},
    {reason("status NOT BETWEEN 200 AND 299", "UPSTREAM_STATUS_NOT_OK", "'Upstream status ' || status || ' is not a 2xx status.'")},
    {reason(f"suspicious AND {data}", "PROVENANCE_LABEL_MISMATCH", f"'Payload is classified ' || signature || ' but declares ' || {said} || '.'")},
    {reason("signature = 'degraded_result'", "RESULT_DEGRADED", "'Payload reports success while carrying a fallback or placeholder result.'")},
    {reason("NOT list_contains(allowed, channel)", "CHANNEL_NOT_PERMITTED", "'Channel ' || channel || ' is not permitted in slot ' || slot || '.'")},
    {reason("rank > 3", "TIER_BELOW_MINIMUM", "'Tier T' || rank || ' is below minimum T3 for slot ' || slot || '.'")}], lambda x: x IS NOT NULL) AS r
  FROM {h}, s
)"""


def codes(r: str = "r") -> str:
    return f"coalesce(list_aggregate(list_transform({r}, lambda x: x.code), 'string_agg', '|'), '')"


_ADDED = f"replace(replace({q(chr(10).join(LINES))}, '#', run_id), '@', first)"
RUNS = f"""
w AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id, coalesce(string_agg(text, chr(10) ORDER BY turn, text) FILTER (role = 'assistant'), '') AS say,
    coalesce(arg_min(text, turn) FILTER (role <> 'assistant'), '') AS first
  FROM conversations GROUP BY 1
), outputs AS (SELECT run_id, say || chr(10) || {_ADDED} AS output FROM w),
raw AS (
  SELECT CAST(conv_id AS VARCHAR) AS run_id, CAST(turn AS INTEGER) AS ordinal, text, CASE WHEN role = 'system' THEN 'SYSTEM_ALERT' ELSE 'USER_MESSAGE' END AS hint_channel, 1 AS hint_rank,
    CAST(NULL AS INTEGER) AS hint_status FROM conversations WHERE role <> 'assistant'
  UNION ALL
  SELECT run_id, 1000, replace({q(LEDGER)}, '#', run_id), (['RETRIEVED_DOC', 'TOOL_RESULT', 'CACHE', 'RETRIEVED_DOC'])[CAST(run_id AS BIGINT) % 4 + 1],
    ([3, 2, 4, 1])[CAST(run_id AS BIGINT) % 4 + 1], CASE CAST(run_id AS BIGINT) % 4 WHEN 1 THEN 200 WHEN 3 THEN 404 END FROM w
), cv AS (SELECT *, 'conversation:' || run_id AS hint_source_id FROM raw)"""
SIGNALS = "s AS (SELECT 'signals' AS slot, ['USER_MESSAGE','RETRIEVED_DOC','TOOL_RESULT','AGENT_OUTPUT'] AS allowed)"
CHECKED = f"{RUNS}, {classified('cv', 'ch')}, {SIGNALS}, {admitted('ch', 'ck')}"

_HEDGES = [
    r"(?i)\b(?:might|maybe|perhaps|possibly|probably|presumably|arguably|apparently|allegedly|reportedly|potentially|seemingly|supposedly)\b", r"(?i)\b(?:seems?|appears?|suggests?|indicates?)\b",
    r"(?i)\b(?:could|would|should|can)\s+(?:be|have|include|indicate|mean|imply|suggest)\b", r"(?i)\b(?:i|we)\s+(?:think|believe|suspect|assume|guess|expect)\b",
    r"(?i)\b(?:not\s+(?:sure|certain|clear)|unclear|uncertain|unconfirmed|hard\s+to\s+say)\b",
    r"(?i)\b(?:as\s+far\s+as\s+(?:i|we)\s+know|to\s+my\s+knowledge|if\s+(?:i|we)\s+recall)\b", r"(?i)\b(?:likely|unlikely)\b",
    r"(?i)\b(?:roughly|approximately|estimated)\b|\b(?:around|about)\s+\d", r"\bmay\b",
]
_FORMAT = rf"^(?:#{{1,6}}{W}*{NW}*|[-*_]{{3,}}|\|?(?:{W}|[:|-])+\|?|(?:>|{W})*|[-*+]{W}*|\d+[.)]{W}*)$"
_MARKUP = rf"^(?:{W}*(?:>|[-*+]|\d+[.)]|#{{1,6}}){W}+)+"
_OPENS = r"[\"''\x{201C}(\[A-Z0-9]"
_WORDS_IN = f"({tokens_of(normal('text'))})"
CLAIMS = rf"""
l0 AS (SELECT run_id, output, unnest(string_split(output, chr(10))) AS line, generate_subscripts(string_split(output, chr(10)), 1) AS i FROM outputs),
l1 AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER p, 0) AS BIGINT) AS l_at, regexp_matches(line, '^[ \t]*(?:```|~~~)') AS fence FROM l0
  WINDOW p AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, sum(CAST(fence AS INTEGER)) OVER (PARTITION BY run_id ORDER BY i) AS fences FROM l1),
l3 AS (SELECT *, {trim("line")} AS t, l_at + length(line) - length(regexp_replace(line, '^{W}+', '')) AS t_at FROM l2 WHERE NOT fence AND fences % 2 = 0),
l4 AS (SELECT *, length(regexp_extract(t, '{_MARKUP}')) AS skip FROM l3 WHERE NOT regexp_matches(t, '{_FORMAT}')),
l5 AS (SELECT *, substr(t, skip + 1) AS body, t_at + skip AS body_at FROM l4),
c0 AS (SELECT *, unnest(string_split(body, '|')) AS cell, generate_subscripts(string_split(body, '|'), 1) AS k FROM l5),
c1 AS (SELECT *, body_at + CAST(coalesce(sum(length(cell) + 1) OVER (PARTITION BY run_id, i ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cell_at FROM c0),
p0 AS (SELECT run_id, output, i, k, cell, cell_at, unnest(regexp_extract_all(cell, '[^.!?]*[.!?]*')) AS p, generate_subscripts(regexp_extract_all(cell, '[^.!?]*[.!?]*'), 1) AS n FROM c1),
p1 AS (SELECT *, CAST(coalesce(sum(length(p)) OVER (PARTITION BY run_id, i, k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p_at FROM p0 WHERE p <> ''),
p2 AS (SELECT *, substr(cell, p_at + length(p) + 1) AS rest, regexp_extract(p, '([A-Za-z]+)[.!?]+$', 1) AS word FROM p1),
p3 AS (SELECT *, regexp_matches(p, '[.!?]$') AND (rest = '' OR regexp_matches(rest, '^{W}')) AND length(word) <> 1 AND lower(word) NOT IN ({listed(sorted(ABBREVIATIONS))})
    AND ({trim("rest")} = '' OR regexp_matches(rest, '^{W}*{_OPENS}')) AS stop FROM p2),
p4 AS (SELECT *, CAST(coalesce(sum(CAST(stop AS INTEGER)) OVER (PARTITION BY run_id, i, k ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS sentence FROM p3),
s0 AS (SELECT run_id, any_value(output) AS output, i, k, sentence, string_agg(p, '' ORDER BY n) AS raw_text, min(cell_at + p_at) AS raw_at FROM p4 GROUP BY run_id, i, k, sentence),
s1 AS (SELECT *, {trim("raw_text")} AS text, raw_at + length(raw_text) - length(regexp_replace(raw_text, '^{W}+', '')) AS cp_start FROM s0),
s2 AS (SELECT * FROM s1 WHERE text <> '' AND len({_WORDS_IN}) >= 3 AND len(list_filter({_WORDS_IN}, lambda x: regexp_matches(x, '[a-z]{{2,}}'))) > 0
    AND NOT regexp_matches(text, '\?["''\x{{2019}}\x{{201D}})\]]*$') AND NOT ({" OR ".join(f"regexp_matches(text, {q(h)})" for h in _HEDGES)})),
s3 AS (SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY i, k, sentence) - 1 AS INTEGER) AS claim_seq,
    length(regexp_replace(substr(output, 1, CAST(cp_start AS BIGINT)), '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS wide, length(regexp_replace(text, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')) AS inner_wide FROM s2),
claims AS (SELECT run_id, 'claim-' || claim_seq AS claim_id, claim_seq, text, CAST(cp_start AS INTEGER) AS cp_start, CAST(cp_start + wide AS INTEGER) AS span_start,
    CAST(cp_start + wide + length(text) + inner_wide AS INTEGER) AS span_end FROM s3)"""


def ground(context: str) -> str:
    """CTE ``assessed``: ``claims`` against ``context`` (run_id, ordinal, chunk_id, rank, text)."""
    strip = r"[.!?,;:\"''\x{2019}\x{201D})\]" + W[1:]
    return rf"""
g1 AS (SELECT *, {trim("text")} AS whole, regexp_replace({trim("text")}, '{strip}+$', '') AS stripped, {normal(f"regexp_replace(text, '{strip}+$', '')")} AS norm, {normal("text")} AS all_norm,
    {entities("text")} AS e0, {numbers("text")} AS n0 FROM claims),
g2 AS (SELECT *, {ordered("e0")} AS ents, {ordered("n0")} AS nums, {tokens_of("all_norm")} AS toks FROM g1),
g3 AS (SELECT * EXCLUDE (toks), {content_of("toks")} AS content, list_concat(ents, nums) AS spec FROM g2),
x1 AS (SELECT *, {normal("text")} AS c_norm, {numbers("text")} AS c_nums FROM {context}),
x2 AS (SELECT run_id, ordinal, chunk_id, rank <= 3 AS good, text AS c_text, c_norm, c_nums, {tokens_of("c_norm")} AS c_tokens FROM x1),
pr AS (SELECT g3.run_id, claim_id, ordinal, chunk_id, good, contains(c_text, whole) OR (stripped <> '' AND contains(c_text, stripped)) AS exact, norm <> '' AND contains(c_norm, norm) AS normed,
    CASE WHEN len(spec) = 0 AND len(content) > 0 THEN len(list_filter(content, lambda x: list_contains(c_tokens, x))) / len(content) END AS ratio, c_tokens FROM g3 JOIN x2 ON g3.run_id = x2.run_id),
st AS (SELECT run_id, claim_id,
    list(chunk_id ORDER BY ordinal) FILTER (exact) AS exact_ids, bool_or(good) FILTER (exact) AS exact_good, list(chunk_id ORDER BY ordinal) FILTER (normed) AS norm_ids, bool_or(good) FILTER (normed) AS norm_good,
    list(chunk_id ORDER BY ordinal) FILTER (ratio >= 0.9::DOUBLE) AS cover_ids, bool_or(good) FILTER (ratio >= 0.9::DOUBLE) AS cover_good, max(ratio) FILTER (ratio >= 0.9::DOUBLE) AS best,
    flatten(list(c_tokens)) AS corpus FROM pr GROUP BY run_id, claim_id),
sp AS (SELECT run_id, claim_id, unnest(spec) AS value, generate_subscripts(spec, 1) AS idx, len(ents) AS n_ents FROM g3),
sq AS (SELECT sp.run_id, claim_id, idx, value, ordinal, chunk_id, good FROM sp LEFT JOIN x2 ON sp.run_id = x2.run_id
    AND CASE WHEN idx <= n_ents THEN contains(' ' || c_norm || ' ', ' ' || {normal("value")} || ' ') ELSE list_contains(c_nums, value) END),
sr AS (SELECT run_id, claim_id, list(chunk_id ORDER BY idx, ordinal) FILTER (chunk_id IS NOT NULL) AS by_ids, bool_or(good) AS spec_good,
    list(value ORDER BY idx) FILTER (chunk_id IS NULL) AS missing FROM sq GROUP BY run_id, claim_id),
m1 AS (SELECT g3.*, st.* EXCLUDE (run_id, claim_id), sr.* EXCLUDE (run_id, claim_id), len(spec) > 0 AND missing IS NULL AS all_found, coalesce(len(missing), 0) < len(spec) AS partly,
    CASE WHEN len(ents) > 0 THEN 'entity' ELSE 'numeric' END AS kind, len(list_filter(content, lambda x: list_contains(coalesce(corpus, []), x))) AS n_in
  FROM g3 LEFT JOIN st ON g3.run_id = st.run_id AND g3.claim_id = st.claim_id LEFT JOIN sr ON g3.run_id = sr.run_id AND g3.claim_id = sr.claim_id),
m2 AS (SELECT *, CASE WHEN exact_good THEN 1 WHEN norm_good THEN 2 WHEN cover_good THEN 3 WHEN all_found AND spec_good THEN 4 END AS trusted,
    CASE WHEN exact_ids IS NOT NULL THEN 1 WHEN norm_ids IS NOT NULL THEN 2 WHEN cover_ids IS NOT NULL THEN 3 WHEN all_found THEN 4 END AS tainted,
    len(spec) > 0 AND NOT all_found AS lacks, len(spec) = 0 AND len(content) > 0 AND n_in / len(content) < 0.34::DOUBLE AS lexical FROM m1),
m3 AS (SELECT *, coalesce(trusted, tainted) AS hit,
    CASE coalesce(trusted, tainted) WHEN 1 THEN 'claim appears verbatim in context' WHEN 2 THEN 'claim appears in context after normalizing case, whitespace and punctuation'
      WHEN 3 THEN printf('claim has %.1f%% normalized content-word coverage in a single chunk', best * 100)
      WHEN 4 THEN 'every specific in the claim appears in context: ' || list_aggregate(spec, 'string_agg', ', ') END AS said FROM m2),
assessed AS (SELECT run_id, claim_id, claim_seq, text, span_start, span_end, CASE WHEN trusted IS NOT NULL THEN 'grounded' WHEN tainted IS NOT NULL OR lacks OR lexical THEN 'ungrounded' ELSE 'unverifiable' END AS status,
    CASE WHEN hit = 1 THEN 'exact' ELSE 'fuzzy' END AS method,
    CASE WHEN hit = 1 THEN 'exact' WHEN hit IN (2, 3) THEN 'normalized' WHEN hit = 4 OR lacks THEN kind WHEN lexical THEN 'lexical' ELSE 'none' END AS decided_by,
    CASE WHEN trusted IS NOT NULL THEN ([1.0, 0.9, 0.9, 0.75])[trusted]::DOUBLE WHEN tainted IS NOT NULL OR lacks OR lexical THEN 0::DOUBLE ELSE 0.5::DOUBLE END AS score,
    CASE hit WHEN 1 THEN exact_ids WHEN 2 THEN norm_ids WHEN 3 THEN cover_ids WHEN 4 THEN {ordered("by_ids")} ELSE CASE WHEN lacks AND partly THEN {ordered("by_ids")} ELSE CAST([] AS VARCHAR[]) END END AS ids,
    CASE WHEN trusted IS NOT NULL THEN NULL WHEN tainted IS NOT NULL THEN 'CLAIM_SUPPORT_LOW_TIER' WHEN lacks OR lexical THEN 'CLAIM_UNGROUNDED' ELSE 'CLAIM_UNVERIFIABLE' END AS reason,
    CASE WHEN trusted IS NOT NULL THEN said WHEN tainted IS NOT NULL THEN said || ', but every supporting chunk is tier T4 or T5'
      WHEN lacks THEN CASE WHEN partly THEN 'claim mixes sourced and unsourced specifics; absent from context: ' ELSE 'no specific in the claim appears in context: ' END || list_aggregate(missing, 'string_agg', ', ')
      WHEN lexical THEN 'only ' || n_in || ' of ' || len(content) || ' content words appear anywhere in context' ELSE 'no deterministic check could confirm or refute this claim' END AS detail FROM m3)"""


AUDITED = f"{CHECKED}, {CLAIMS}, ev AS (SELECT * FROM ck WHERE len(r) = 0), {ground('ev')}"
VERDICTS = """
vd AS (SELECT outputs.run_id, CASE WHEN bool_or(status IN ('ungrounded', 'unverifiable')) THEN 'block' ELSE 'allow' END AS decision, list(reason ORDER BY claim_seq) FILTER (reason IS NOT NULL) AS reasons
  FROM outputs LEFT JOIN assessed ON outputs.run_id = assessed.run_id GROUP BY outputs.run_id),
bl AS (SELECT run_id, arg_min(r[1].code, ordinal) AS code FROM ck WHERE len(r) > 0 GROUP BY run_id),
oc AS (SELECT vd.run_id, bl.code IS NOT NULL OR decision = 'block' AS would_block, CASE WHEN bl.code IS NOT NULL THEN 'inbound' WHEN decision = 'block' THEN 'outbound' ELSE 'none' END AS stage,
    CASE WHEN bl.code IS NOT NULL THEN bl.code WHEN decision = 'block' THEN reasons[1] END AS reason_code FROM vd LEFT JOIN bl ON vd.run_id = bl.run_id)"""
PIPELINE = f"{AUDITED}, {VERDICTS}"


def gid(kind: str, fields: str, tenant: str = "local") -> str:
    """An id from the SQL of its fields, each ``["name",value]`` already joined by commas."""
    return f"('pg:{tenant}:{kind}:' || substr(sha256('[1,\"{tenant}\",\"{kind}\",[' || {fields} || ']]'), 1, 32))"


def text_field(name: str, value: str) -> str:
    return f"'[\"{name}\",' || to_json({value}) || ']'"


def int_field(name: str, value: str) -> str:
    return f"'[\"{name}\",' || {value} || ']'"


def fields(*parts: str) -> str:
    return " || ',' || ".join(parts)


def edge(kind: str, a: str, b: str) -> str:
    id_ = gid(f"edge.{kind}", fields(text_field("from", a), text_field("to", b)))
    return f"SELECT 'local' AS tenant_id, {id_} AS id, '{kind}' AS type, CAST(1 AS INTEGER) AS schema_version, {a} AS from_id, {b} AS to_id, '{AT}' AS observed_at, CAST(NULL AS VARCHAR) AS note"


_TYPES = {"string": "VARCHAR", "int": "INTEGER", "boolean": "BOOLEAN"}
_COLUMNS = {c.split()[0]: _TYPES[c.split()[1]] for c in NODE_SCHEMA.split(", ") if "array" not in c}


def node(kind: str, table: str, distinct: bool = False, **values: str) -> str:
    values = {"tenant_id": "'local'", "kind": f"'{kind}'", "schema_version": "1", "observed_at": f"'{AT}'"} | values
    shown = ", ".join(f"CAST({values.get(c, 'NULL')} AS {t}) AS {c}" for c, t in _COLUMNS.items())
    return f"SELECT {'DISTINCT ' * distinct}{shown} FROM {table}"


_RUN = gid("Run", text_field("runKey", "run_key"))
_KIND = "CASE channel " + " ".join(f"WHEN '{c}' THEN '{k}'" for c, k in SOURCE_KINDS.items()) + " ELSE 'unknown' END"
RUN_KEYS = """
ks AS (SELECT run_id, string_agg('[' || to_json(chunk_id) || ',"sha256:' || d || '"]', ',' ORDER BY ordinal) AS listed FROM ck GROUP BY run_id),
rk AS (SELECT outputs.run_id, output, 'sha256:' || sha256('[' || to_json(output) || ',"signals",[' || coalesce(listed, '') || ']]') AS run_key FROM outputs LEFT JOIN ks ON outputs.run_id = ks.run_id)"""
LINEAGE = f"""{PIPELINE}, {RUN_KEYS},
r0 AS (SELECT rk.* FROM rk WHERE run_id = (SELECT min(o.run_id) FROM rk o WHERE o.run_key = rk.run_key)),
r1 AS (SELECT r0.*, NOT would_block AS delivered, {_RUN} AS run, {gid("Policy", fields(text_field("name", "'default'"), text_field("version", "'1'")))} AS policy FROM r0 JOIN oc ON r0.run_id = oc.run_id),
r2 AS (SELECT *, {", ".join(gid("Step", fields(int_field("index", str(i)), text_field("runId", "run"))) + f" AS step{i}" for i in range(3))},
    {gid("Output", fields(text_field("contentHash", "'sha256:' || sha256(output)"), text_field("runId", "run")))} AS out FROM r1),
k0 AS (SELECT r2.* EXCLUDE (run_id), ck.* , 'sha256:' || d AS hash, {_KIND} AS skind FROM ck JOIN r2 ON ck.run_id = r2.run_id),
k1 AS (SELECT *, {gid("Source", fields(text_field("sourceKind", "skind"), text_field("uri", "hint_source_id")))} AS source, {gid("Artifact", fields(text_field("contentHash", "hash"), text_field("runId", "run")))} AS artifact,
    {gid("Chunk", fields(text_field("contentHash", "hash"), int_field("ordinal", "ordinal"), text_field("runId", "run")))} AS chunk FROM k0),
k2 AS (SELECT *, {gid("Verdict", fields(text_field("policyRef", "policy"), text_field("runId", "run"), text_field("targetRef", "chunk")))} AS verdict FROM k1),
z0 AS (SELECT r2.* EXCLUDE (run_id), assessed.* FROM assessed JOIN r2 ON assessed.run_id = r2.run_id),
z1 AS (SELECT *, {gid("Claim", fields(text_field("outputRef", "out"), text_field("runId", "run"), int_field("spanEnd", "span_end"), int_field("spanStart", "span_start")))} AS claim FROM z0),
z2 AS (SELECT *, {gid("Verdict", fields(text_field("policyRef", "policy"), text_field("runId", "run"), text_field("targetRef", "claim")))} AS verdict FROM z1)"""
NODES = f"""WITH {LINEAGE}
{node("Run", "r2", id="run", run_key="run_key", started_at=f"'{AT}'")}
UNION ALL {node("Policy", "r2", True, id="policy", name="'default'", version="'1'", content_hash="'sha256:' || sha256('slot-policy:signals')", mode="'enforce'")}
UNION ALL {node("Step", "r2", id="step0", run_id="run", step_index="0", name="'retrieve'", step_kind="'retrieve'")}
UNION ALL {node("Step", "r2", id="step1", run_id="run", step_index="1", name="'assemble-context'", step_kind="'assemble'")}
UNION ALL {node("Step", "r2", id="step2", run_id="run", step_index="2", name="'generate-output'", step_kind="'generate'")}
UNION ALL {node("Output", "r2", id="out", run_id="run", content_hash="'sha256:' || sha256(output)", text="'[redacted]'", delivered="delivered")}
UNION ALL {node("Source", "k2", True, id="source", uri="hint_source_id", source_kind="skind")}
UNION ALL {node("Artifact", "k2 x WHERE ordinal = (SELECT min(y.ordinal) FROM k2 y WHERE y.artifact = x.artifact)", id="artifact", run_id="run", content_hash="hash", upstream_status="status")}
UNION ALL {node("Chunk", "k2", id="chunk", run_id="run", content_hash="hash", ordinal="ordinal", text="'[redacted]'", channel="channel", tier="'T' || rank", retrieved_at="'1970-01-01T00:00:00.000Z'", admitted="len(r) = 0", slot="slot", upstream_status="status")}
UNION ALL {node("Verdict", "k2", id="verdict", run_id="run", target_ref="chunk", policy_ref="policy", decision="CASE WHEN len(r) = 0 THEN 'allow' ELSE 'block' END", method="'deterministic'", monitored="false", decided_at=f"'{AT}'", input_hash="'sha256:' || sha256(text)")}
UNION ALL {node("Claim", "z2", id="claim", run_id="run", output_ref="out", text="'[redacted]'", span_start="span_start", span_end="span_end", material="true")}
UNION ALL {node("Verdict", "z2", id="verdict", run_id="run", target_ref="claim", policy_ref="policy", decision="CASE status WHEN 'grounded' THEN 'allow' WHEN 'unverifiable' THEN 'quarantine' ELSE 'block' END", method="'deterministic'", monitored="false", decided_at=f"'{AT}'", input_hash="'sha256:' || sha256(text)")}"""
EDGES = f"""WITH {LINEAGE},
su AS (SELECT DISTINCT z2.claim, x.chunk FROM (SELECT claim, run, unnest(ids) AS chunk_id FROM z2) z2 JOIN (SELECT run, chunk_id, arg_max(chunk, ordinal) AS chunk FROM k2 GROUP BY run, chunk_id) x ON z2.run = x.run AND z2.chunk_id = x.chunk_id)
{" UNION ALL ".join(edge("PRODUCED", "run", f"step{i}") + " FROM r2" for i in range(3))}
UNION ALL {edge("PRODUCED", "step2", "out")} FROM r2 UNION ALL {edge("EVALUATED_BY", "out", "policy")} FROM r2
UNION ALL {edge("PRODUCED", "source", "artifact")} FROM (SELECT DISTINCT source, artifact FROM k2) UNION ALL {edge("PRODUCED", "step0", "artifact")} FROM (SELECT DISTINCT step0, artifact FROM k2)
UNION ALL {edge("SPLIT_INTO", "artifact", "chunk")} FROM k2 UNION ALL {edge("EVALUATED_BY", "chunk", "policy")} FROM k2 UNION ALL {edge("DECIDES", "verdict", "chunk")} FROM k2
UNION ALL {edge("CONSUMED", "step1", "chunk")} FROM k2 WHERE len(r) = 0 UNION ALL {edge("INCLUDED_IN", "chunk", "step1")} FROM k2 WHERE len(r) = 0
UNION ALL {edge("EXTRACTED_FROM", "claim", "out")} FROM z2 UNION ALL {edge("EVALUATED_BY", "claim", "policy")} FROM z2 UNION ALL {edge("DECIDES", "verdict", "claim")} FROM z2
UNION ALL {edge("SUPPORTED_BY", "claim", "chunk")} FROM su"""

_GRID = "(VALUES ('basic'), ('hard'), ('mixed')) x(difficulty)"
SINGLE = f"""{VARIED}, {classified('v', 'h')}, {SIGNALS}, {admitted('h', 'a')},
o AS (
  SELECT doc_id, part, len(r) > 0 AS would_block, CASE WHEN len(r) > 0 THEN 'inbound' ELSE 'none' END AS stage, r[1].code AS reason_code, doc_id % 9 < 7 AS should_block,
    (['basic','hard'])[doc_id % 2 + 1] AS difficulty, (['derived','constructed'])[doc_id // 2 % 2 + 1] AS provenance, CASE WHEN doc_id % 9 < 7 THEN 'inbound' ELSE 'either' END AS expected FROM a
)"""

_N = "n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT i, i // 5 AS r FROM n, range(n.n) t(i))"
BRAID = f"""{_N},
ed AS (
  SELECT 'PRODUCED' AS type, 's' || i % 7 AS f, 'a' || i || '.0' AS t FROM b UNION ALL SELECT 'DERIVED_FROM', 'a' || i || '.1', 'a' || i || '.0' FROM b UNION ALL SELECT 'DERIVED_FROM', 'a' || i || '.2', 'a' || i || '.0' FROM b
  UNION ALL SELECT 'DERIVED_FROM', 'a' || i || '.3', 'a' || i || '.1' FROM b UNION ALL SELECT 'DERIVED_FROM', 'a' || i || '.3', 'a' || i || '.2' FROM b UNION ALL SELECT 'SPLIT_INTO', 'a' || i || '.3', 'c' || i FROM b
  UNION ALL SELECT 'SUPPORTED_BY', 'k' || i, 'c' || i FROM b UNION ALL SELECT 'SUPPORTED_BY', 'k' || i, 'c' || (i + 1) FROM b, n WHERE i % 5 < 4 AND i + 1 < n.n
  UNION ALL SELECT 'EXTRACTED_FROM', 'k' || i, 'o' || r FROM b
), ids AS (SELECT *, type || '-' || f || '-' || t AS id FROM ed)"""


def _steps(steps: dict[str, str]) -> str:
    way = lambda d: listed([t for t, x in steps.items() if x == d])
    return f"st AS (SELECT f AS src, t AS dst, id FROM ids WHERE type IN ({way('out')}) UNION ALL SELECT t, f, id FROM ids WHERE type IN ({way('in')}))"


def _paths(targets: str, depth: int) -> str:
    """CTEs up to ``ended``: all whole backward paths of at most ``depth`` nodes, and ``long``: targets with longer ones."""
    return f"""{BRAID}, {_steps(BACKWARD)},
pt AS (
  SELECT x AS target, [x] AS ns, CAST([] AS VARCHAR[]) AS es FROM ({targets}) q(x)
  UNION ALL
  SELECT target, list_append(ns, dst), list_append(es, id) FROM pt JOIN st ON ns[len(ns)] = src WHERE NOT list_contains(ns, dst) AND len(ns) <= {depth}
), ended AS (SELECT * FROM pt WHERE len(ns) <= {depth} AND NOT EXISTS (SELECT 1 FROM st WHERE src = ns[len(ns)] AND NOT list_contains(ns, dst))),
lg AS (SELECT DISTINCT target FROM pt WHERE len(ns) > {depth}), ct AS (SELECT target, count(*) AS n FROM ended GROUP BY target)"""


def _reach(origins: str, depth: int) -> str:
    return f"""{BRAID}, {_steps(FORWARD)},
rc AS (SELECT x AS origin, x AS id, 0 AS d FROM ({origins}) q(x) UNION SELECT origin, dst, d + 1 FROM rc JOIN st ON rc.id = src WHERE d < {depth}),
mb AS (SELECT origin, id, min(d) AS distance FROM rc GROUP BY origin, id)"""


_BENCH = [
    ("stdout-capture", "inbound", "UPSTREAM_STATUS_NOT_OK"), ("http-error-body", "inbound", "UPSTREAM_STATUS_NOT_OK"), ("alert-in-history", "inbound", "CHANNEL_NOT_PERMITTED"),
    ("truncated-json", "inbound", "PAYLOAD_TRUNCATED"), ("mechanical-fallback", "inbound", "TIER_BELOW_MINIMUM"), ("unlabeled-enrichment", "inbound", "CHANNEL_NOT_PERMITTED"),
    ("stale-cache", "inbound", "CHANNEL_NOT_PERMITTED"), ("empty-not-denied", "inbound", "PAYLOAD_EMPTY"), ("hard-split-conjunction", "outbound", "CLAIM_UNVERIFIABLE"),
    ("hard-ok-status-error-body", "inbound", "PROVENANCE_LABEL_MISMATCH"), ("hard-json-shaped-diagnostic", "inbound", "RESULT_DEGRADED"), ("mixed-truncated-tail", "inbound", "PAYLOAD_TRUNCATED"),
    ("mixed-diagnostic-interleaved", "inbound", "PROVENANCE_LABEL_MISMATCH"), ("mixed-clean-quoted-error", "outbound", "CLAIM_UNGROUNDED"),
]
#: Published results of the bench: which runs would be blocked, where and why; every other run passes.
_BLOCKED = {i: (s, c) for i, s, c in _BENCH}


def _bench_rows() -> str:
    out = []
    for s in SCENARIOS:
        stage, code = _BLOCKED.get(s.id, ("none", None))
        actual = "block" if code else "allow"
        passed = str((actual == "block") == (s.expectation == "should_block")).lower()
        out.append(f"({q(s.id)}, '{actual}', {passed}, '{stage}', {q(code) if code else 'NULL'}, 'delivered', '{'changed' if code else 'none'}')")
    return ", ".join(out)


_METRICS = {
    "control_invocations": 32, "should_block": 24, "guard_changed": 13, "shape_catches": 0, "outbound_validated": 1, "would_block": 14, "passed": 20, "stage_inbound": 12, "stage_outbound": 2, "stage_none": 0,
    "reason_UPSTREAM_STATUS_NOT_OK": 2, "reason_CHANNEL_NOT_PERMITTED": 3, "reason_PAYLOAD_TRUNCATED": 2, "reason_TIER_BELOW_MINIMUM": 1, "reason_PAYLOAD_EMPTY": 1, "reason_CLAIM_UNVERIFIABLE": 1,
    "reason_PROVENANCE_LABEL_MISMATCH": 2, "reason_RESULT_DEGRADED": 1, "reason_CLAIM_UNGROUNDED": 1,
}
_RATES = [
    ("recall", "basic", "derived", 6, 6), ("recall", "basic", "constructed", 2, 2), ("recall", "hard", "derived", 0, 0), ("recall", "hard", "constructed", 3, 8), ("recall", "mixed", "derived", 0, 0),
    ("recall", "mixed", "constructed", 2, 8), ("false_positive", "basic", "", 0, 2), ("false_positive", "hard", "", 0, 4), ("false_positive", "mixed", "", 1, 2),
]


def _label(n: int, d: int) -> str:
    return f"{n}/{d} ({100 * n / d:.1f}%)" if d else "n/a (0 scenarios)"


_DAMAGE = {1: ("GRAPH_SCHEMA_INVALID", "node", 1), 2: ("GRAPH_EDGE_ENDPOINT_MISSING", "edge", 4), 3: ("GRAPH_REFERENCE_MISSING", "node", 1), 4: ("GRAPH_EDGE_TYPE_NOT_PERMITTED", "edge", 1), 5: ("GRAPH_TENANT_MISMATCH", "edge", 1),
           6: ("GRAPH_RUN_MISMATCH", "edge", 1), 7: ("GRAPH_CYCLE_DETECTED", "node", 1), 8: ("GRAPH_CYCLE_DETECTED", "node", 3), 9: ("GRAPH_SUPPORT_FROM_BLOCKED_CHUNK", "edge", 1), 10: ("GRAPH_CLAIM_UNSUPPORTED_DELIVERY", "node", 1),
           11: ("GRAPH_VERDICT_POLICY_MISSING", "node", 1), 12: ("GRAPH_ID_MISMATCH", "node", 1), 13: ("GRAPH_DUPLICATE_ID", "node", 1)}
_CHECKS = """
d0 AS (SELECT doc_id, replace(replace(replace(replace(replace(coalesce(text, ''), '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t') AS e, coalesce(text, '') AS t FROM documents)"""

ORACLE: dict[str, str] = {
    "chunk_identity": f"""WITH {VARIED}, {classified('v', 'h')}
SELECT doc_id, part, chunk_id, hint_source_id AS source_id, 'sha256:' || d AS content_hash, '1970-01-01T00:00:00.000Z' AS retrieved_at FROM h""",
    "text_forms": f"""WITH n AS (SELECT doc_id, {normal("coalesce(text, '')")} AS n, doc_id || ',000 v1.2.3 ' || coalesce(text, '') AS t FROM documents), k AS (SELECT *, {tokens_of("n")} AS tokens, {numbers("t")} AS every FROM n)
SELECT doc_id, sha256(n) AS normalized_sha256, len(tokens) AS n_tokens, len({content_of("tokens")}) AS n_content_tokens, list_aggregate({ordered("every")}, 'string_agg', '|') AS numbers FROM k""",
    "text_entities": rf"""WITH t AS (SELECT doc_id, 'See `code_' || doc_id || '` and "two words" at www.shop.com, x.py or NASA. ' || coalesce(text, '') AS t FROM documents), e AS (SELECT *, {entities("t")} AS e0, {normal("t")} AS n FROM t)
SELECT doc_id, sha256(list_aggregate({ordered("e0")}, 'string_agg', '|')) AS entities_sha256, len({ordered("e0")}) AS n_entities, regexp_replace(t, '[.!?,;:"''\x{{2019}}\x{{201D}})\]{W[1:]}+$', '') = t AS bare,
  contains(' ' || n || ' ', ' of the ') AS has_phrase, regexp_matches(substr(t, 1, 3), '^[A-Z]{{2,}}$') AS acronym FROM e""",
    "error_evidence": f"""WITH {VARIED}, {classified('v', 'h')} SELECT doc_id, part, CAST(lead AS INTEGER) AS lead, CAST(bare AS INTEGER) AS bare, CAST(page AS INTEGER) AS page, head, found, error,
  coalesce(CAST(lead AS INTEGER), CAST(bare AS INTEGER), CASE WHEN found THEN json_status END, CAST(page AS INTEGER)) AS detected FROM h""",
    "json_facts": f"""WITH {VARIED}, {classified('v', 'h')} SELECT doc_id, part, parses, found AS error_found, CASE WHEN found THEN json_status END AS error_status, json_degraded AS degraded, unclosed, truncated FROM h WHERE looks""",
    "signature_classify": f"WITH {VARIED}, {classified('v', 'h')} SELECT doc_id, part, signature, CAST(status AS BIGINT) AS status, channel, 'T' || rank AS tier FROM h",
    "slot_admission": f"WITH {VARIED}, {classified('v', 'h')}, {SLOTS}, {admitted('h', 'a')} SELECT doc_id, part, slot, CASE WHEN len(r) = 0 THEN 'allow' ELSE 'block' END AS decision, {codes()} AS reason_codes FROM a",
    "slot_reasons": f"""WITH {VARIED}, {classified('v', 'h')}, {SIGNALS}, {admitted('h', 'a')}
SELECT doc_id, part, coalesce(list_aggregate(list_transform(r, lambda x: x.message), 'string_agg', ' '), '') AS messages FROM a""",
    "admission_counts": f"""WITH {VARIED}, {classified('v', 'h')}, {SLOTS}, {admitted('h', 'a')}
SELECT slot, CASE WHEN reason_code IS NULL THEN 'allow' ELSE 'block' END AS decision, reason_code, count(*) AS n
FROM (SELECT slot, unnest(CASE WHEN len(r) = 0 THEN [NULL] ELSE list_transform(r, lambda x: x.code) END) AS reason_code FROM a) GROUP BY ALL""",
    "assembled_context": f"""WITH {VARIED}, {classified('v', 'h')}, {SLOTS}, {admitted('h', 'a')}, g AS (SELECT DISTINCT doc_id // 50 AS run_id FROM v)
SELECT g.run_id, s.slot, count(a.doc_id) AS n_admitted, coalesce(sha256(string_agg(a.chunk_id, ',' ORDER BY a.doc_id, a.part)), sha256('')) AS admitted_sha256
FROM g CROSS JOIN s LEFT JOIN a ON a.doc_id // 50 = g.run_id AND a.slot = s.slot AND len(a.r) = 0 GROUP BY g.run_id, s.slot""",
    "check_inputs": f"""WITH {_CHECKS}, c AS (SELECT doc_id, e, t, doc_id % 8 AS k FROM d0)
SELECT doc_id, CASE k WHEN 1 THEN 'INPUT_MALFORMED_JSON' WHEN 2 THEN 'INPUT_INVALID_CHECK' WHEN 3 THEN 'INPUT_INVALID_CHECK' WHEN 4 THEN 'INPUT_INVALID_CHECK' WHEN 5 THEN 'INPUT_INVALID_CHECK' END AS code,
  CASE k WHEN 1 THEN 'INPUT_MALFORMED_JSON' WHEN 2 THEN 'INPUT_CHUNKS_MISSING' WHEN 3 THEN 'INPUT_OUTPUT_MISSING' WHEN 4 THEN 'INPUT_CHUNK_WITHOUT_TEXT' WHEN 5 THEN 'INPUT_SLOT_UNDECLARED' END AS error,
  CASE WHEN k IN (0, 6, 7) THEN CASE k WHEN 6 THEN 'evidence' WHEN 7 THEN 'own' ELSE 'signals' END END AS slot, CASE WHEN k IN (0, 6, 7) THEN CASE WHEN k = 7 THEN 'T5' ELSE 'T3' END END AS min_tier,
  CASE WHEN k IN (0, 6, 7) THEN sha256(t) END AS output_sha256, CASE WHEN k IN (0, 6, 7) THEN sha256(t || '|plain') END AS chunks_sha256 FROM c""",
    "claims_extract": f"WITH {RUNS}, {CLAIMS} SELECT * FROM claims",
    "ground_assess": f"WITH {AUDITED} SELECT run_id, claim_id, status, method, decided_by, score, coalesce(list_aggregate(ids, 'string_agg', '|'), '') AS supporting, reason, detail FROM assessed",
    "ground_ungated": f"""WITH {RUNS}, {classified('cv', 'ch')}, {CLAIMS}, ev AS (SELECT * REPLACE (hint_rank AS rank) FROM ch), {ground('ev')}
SELECT run_id, claim_id, status, decided_by, score, coalesce(list_aggregate(ids, 'string_agg', '|'), '') AS supporting, reason FROM assessed""",
    "audit_verdict": f"WITH {PIPELINE} SELECT run_id, decision, coalesce(list_aggregate(reasons, 'string_agg', '|'), '') AS reasons FROM vd",
    "pipeline_outcome": f"WITH {PIPELINE} SELECT run_id, would_block, stage, reason_code, CASE WHEN would_block THEN 'block' ELSE 'allow' END AS outcome FROM oc",
    "judge_escalation": f"""WITH {PIPELINE}, j AS (SELECT *, CASE WHEN status = 'unverifiable' AND claim_seq % 3 = 0 THEN 'ungrounded' END AS said FROM assessed)
SELECT run_id, claim_id, coalesce(said, status) AS status, CASE WHEN said IS NOT NULL THEN 'judge' ELSE decided_by END AS decided_by, CASE WHEN said IS NOT NULL THEN 0 ELSE score END AS score,
  CASE WHEN said IS NOT NULL THEN 'CLAIM_UNGROUNDED' ELSE reason END AS reason, CASE WHEN status = 'unverifiable' THEN claim_seq % 3 = 0 END AS applied,
  CASE WHEN status = 'unverifiable' AND claim_seq % 3 = 1 THEN 'timeout' END AS error FROM j""",
    "judge_keys": f"""WITH {PIPELINE}, cx AS (SELECT run_id, string_agg('{{"id":' || to_json(chunk_id) || ',"text":' || to_json(text) || ',"provenance":{{"sourceId":' || to_json(hint_source_id) || ',"channel":"' || channel || '","tier":"T' || rank
  || '","retrievedAt":"1970-01-01T00:00:00.000Z","contentHash":"sha256:' || d || '"' || CASE WHEN status IS NULL THEN '' ELSE ',"upstreamStatus":' || status END || '}}}}', ',' ORDER BY chunk_id, ordinal) AS c FROM ck WHERE len(r) = 0 GROUP BY run_id)
SELECT a.run_id, a.claim_id, 'sha256:' || sha256('{{"claim":{{"text":' || to_json(text) || ',"spanStart":' || span_start || ',"spanEnd":' || span_end || '}},"chunks":[' || coalesce(c, '') || ']}}') AS key
FROM assessed a LEFT JOIN cx ON a.run_id = cx.run_id WHERE status = 'unverifiable'""",
    "guard_delivery": f"""WITH {PIPELINE}, wd AS (SELECT run_id, count(*) AS n, count(*) FILTER (len(r) > 0) AS refused FROM ck GROUP BY run_id), md AS (SELECT * FROM (VALUES ('enforce'), ('monitor')) t(mode))
SELECT md.mode, vd.run_id, vd.decision, vd.decision = 'allow' OR md.mode = 'monitor' AS delivered, wd.n AS candidates, wd.n - CASE WHEN md.mode = 'enforce' THEN refused ELSE 0 END AS admitted, refused AS would_refuse
FROM vd JOIN wd ON vd.run_id = wd.run_id CROSS JOIN md""",
    "run_keys": f"WITH {CHECKED}, {RUN_KEYS} SELECT run_id, run_key, {_RUN} AS run FROM rk",
    "ledger_nodes": NODES,
    "ledger_edges": EDGES,
    "ledger_chunk_ids": f"""WITH d AS (SELECT doc_id, source, 'sha256:' || sha256(coalesce(text, '')) AS h, {gid("Run", text_field("runKey", "CAST(doc_id AS VARCHAR)"))} AS run_id FROM documents)
SELECT doc_id, run_id, {gid("Source", fields(text_field("sourceKind", "'retrieval'"), text_field("uri", "source")))} AS source_id,
  {gid("Chunk", fields(text_field("contentHash", "h"), int_field("ordinal", "0"), text_field("runId", "run_id")))} AS chunk_id FROM d""",
    "id_parts": f"""WITH p AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN {gid("Run", text_field("runKey", "CAST(doc_id AS VARCHAR)"))} WHEN 1 THEN 'run-' || doc_id WHEN 2 THEN 'pg:acme:Run:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 31)
  WHEN 3 THEN 'pg:ACME:Run:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) WHEN 4 THEN 'pg:acme:edge.PRODUCED:' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 32) ELSE '' END AS id FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'local' WHEN 4 THEN 'acme' END AS tenant, CASE doc_id % 6 WHEN 0 THEN 'Run' WHEN 4 THEN 'edge.PRODUCED' END AS kind, CASE WHEN doc_id % 6 IN (0, 4) THEN string_split(id, ':')[4] END AS digest, doc_id % 6 = 4 AS of_acme FROM p""",
    "source_uris": """
WITH p AS (SELECT page_id, url, regexp_extract(url, '^([^:]+)://([^/?#]*)(.*)$', 1) AS scheme, regexp_extract(url, '^([^:]+)://([^/?#]*)(.*)$', 2) AS host, regexp_extract(url, '^([^:]+)://([^/?#]*)(.*)$', 3) AS rest FROM pages WHERE regexp_matches(url, '^https?://[A-Za-z0-9.-]+(/|[?#]|$)'))
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url ELSE lower(scheme) || '://' || lower(host) || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END END AS uri FROM p""",
    "redacted_lines": f"""WITH {_N} SELECT '{{"id":"' || id || '","kind":"Source","observedAt":"{AT}","schemaVersion":1,"sourceKind":"retrieval","tenantId":"acme","uri":"store://' || i || '"}}' AS element FROM (SELECT i, 's' || i AS id FROM b WHERE i < 7)
UNION ALL SELECT '{{"admitted":true,"channel":"RETRIEVED_DOC","contentHash":"sha256:c' || i || '","id":"c' || i || '","kind":"Chunk","observedAt":"{AT}","ordinal":' || i % 5 || ',"runId":"r' || r || '","schemaVersion":1,"tenantId":"acme","text":"[redacted]","tier":"T3"}}' FROM b""",
    "validate_ledger": "SELECT '' AS code, '' AS element_type, '' AS element_id WHERE false",
    "validate_damaged": f"""WITH n AS (SELECT count(*) AS n FROM supplier), b AS (SELECT i % 20 AS m, count(*) AS k FROM n, range(n.n) t(i) GROUP BY 1), d(m, code, element_type, per) AS (VALUES {", ".join(f"({m}, '{c}', '{e}', {n})" for m, (c, e, n) in _DAMAGE.items())})
SELECT code, element_type, CAST(sum(per * k) AS BIGINT) AS n FROM d JOIN b ON d.m = b.m GROUP BY ALL""",
    "perf_fixture": """
WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT k AS kind, CASE WHEN f = 0 THEN n * m ELSE f + n * m END AS n FROM n, (VALUES
  ('Run', 1, 0), ('Policy', 1, 0), ('Step', 1, 0), ('Output', 1, 0), ('Source', 0, 1), ('Artifact', 0, 3), ('Chunk', 0, 1), ('Claim', 0, 1), ('Verdict', 0, 1),
  ('PRODUCED', 2, 1), ('DERIVED_FROM', 0, 2), ('SPLIT_INTO', 0, 1), ('INCLUDED_IN', 0, 1), ('EXTRACTED_FROM', 0, 1), ('SUPPORTED_BY', 0, 1), ('EVALUATED_BY', 0, 1),
  ('DECIDES', 0, 1)) t(k, f, m)""",
    "impact_kinds": """
WITH n AS (SELECT count(*) AS n FROM supplier)
SELECT k AS kind, CAST(d AS INTEGER) AS distance, n FROM n, (VALUES ('Artifact', 1), ('Artifact', 2), ('Artifact', 3), ('Chunk', 4), ('Claim', 5), ('Output', 6)) t(k, d)""",
    "impact_groups": f"""WITH RECURSIVE {_reach("SELECT 's' || i FROM b WHERE i < 7 UNION ALL SELECT 'c' || i FROM b", 64)},
g AS (SELECT origin, 'claims' AS grp, id, distance FROM mb WHERE starts_with(id, 'k') AND distance > 0 UNION ALL SELECT origin, 'outputs', id, distance FROM mb WHERE starts_with(id, 'o') AND distance > 0
  UNION ALL SELECT origin, 'delivered_outputs', id, distance FROM mb WHERE starts_with(id, 'o') AND distance > 0 AND CAST(substr(id, 2) AS BIGINT) % 2 = 0
  UNION ALL SELECT origin, 'runs', 'r' || CASE WHEN starts_with(id, 'o') THEN CAST(substr(id, 2) AS BIGINT) ELSE CAST(regexp_extract(id, '[0-9]+') AS BIGINT) // 5 END, min(distance) FROM mb WHERE distance > 0 GROUP BY ALL)
SELECT origin, grp AS "group", id, CAST(distance AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY origin, grp ORDER BY distance, id) AS INTEGER) AS place FROM g""",
    "impact_limits": f"""WITH RECURSIVE {_reach("SELECT 's' || i FROM b WHERE i < 7 UNION ALL SELECT 'c' || i FROM b", 3)}, cu AS (SELECT origin, max(distance) = 3 AS truncated FROM mb GROUP BY origin)
SELECT mb.origin, mb.id, CAST(distance AS INTEGER) AS distance, truncated FROM mb JOIN cu ON mb.origin = cu.origin WHERE distance > 0""",
    "trace_lengths": """
WITH n AS (SELECT count(*) AS n FROM supplier) SELECT CAST(l AS BIGINT) AS length, k AS kind, n FROM n, (VALUES (6, 'Source')) t(l, k)""",
    "trace_paths": f"""WITH RECURSIVE {_paths("SELECT 'k' || i FROM b UNION ALL SELECT 'a' || i || '.3' FROM b", 64)},
f AS (SELECT ended.*, n > 3 AS truncated, row_number() OVER (PARTITION BY ended.target ORDER BY es) AS k FROM ended JOIN ct ON ended.target = ct.target)
SELECT target, list_aggregate(ns, 'string_agg', '>') AS nodes, list_aggregate(es, 'string_agg', '>') AS edges, truncated,
  CAST(row_number() OVER (PARTITION BY target ORDER BY len(ns), list_aggregate(ns, 'string_agg', '>'), es) AS INTEGER) AS path_rank FROM f WHERE k <= 3""",
    "trace_limits": f"""WITH RECURSIVE {_paths("SELECT 'k' || i FROM b UNION ALL SELECT 'a' || i || '.3' FROM b", 4)} SELECT ended.target, list_aggregate(ns, 'string_agg', '>') AS nodes, lg.target IS NOT NULL AS truncated FROM ended LEFT JOIN lg ON ended.target = lg.target""",
    "trace_sources": f"""WITH RECURSIVE {_paths("SELECT 'k' || i FROM b UNION ALL SELECT 'o' || r FROM b GROUP BY r", 64)} SELECT DISTINCT target, x AS source, 'store://' || substr(x, 2) AS uri FROM (SELECT target, unnest(ns) AS x FROM ended) WHERE starts_with(x, 's')""",
    "explain_claims": f"""WITH RECURSIVE {_paths("SELECT 'k' || i FROM b", 64)}, sh AS (SELECT target, min(len(ns)) AS least FROM ended GROUP BY target),
sp AS (SELECT ended.target, count(*) AS n_shortest, min(len(ns)) AS length FROM ended JOIN sh ON ended.target = sh.target AND len(ns) = least GROUP BY ended.target),
so AS (SELECT target, string_agg(DISTINCT 'store://' || substr(x, 2), '|' ORDER BY 'store://' || substr(x, 2)) AS sources FROM (SELECT target, unnest(ns) AS x FROM ended) WHERE starts_with(x, 's') GROUP BY target)
SELECT 'k' || i AS target, CASE WHEN i % 3 <> 0 THEN 'v' || i END AS verdict, CASE WHEN i % 3 <> 0 THEN CASE WHEN i % 2 = 0 THEN 'allow' ELSE 'block' END END AS decision, CASE WHEN i % 3 <> 0 THEN i % 4 = 0 END AS monitored,
  CASE WHEN i % 3 = 1 THEN 'default' END AS policy_name, n_shortest, CAST(length AS BIGINT) AS length, sources FROM b JOIN sp ON sp.target = 'k' || i JOIN so ON so.target = 'k' || i""",
    "monitor_outcome": f"WITH {SINGLE} SELECT doc_id, part, would_block, stage, reason_code, 'allow' AS outcome FROM o",
    "recall_rates": f"""WITH {SINGLE}
SELECT x.difficulty, y.provenance, count(*) FILTER (o.would_block) AS numerator, count(o.doc_id) AS denominator
FROM {_GRID} CROSS JOIN (VALUES ('derived'), ('constructed')) y(provenance)
LEFT JOIN o ON o.difficulty = x.difficulty AND o.provenance = y.provenance AND should_block GROUP BY ALL""",
    "false_positive_rates": f"""WITH {SINGLE}
SELECT x.difficulty, count(*) FILTER (o.would_block) AS numerator, count(o.doc_id) AS denominator FROM {_GRID} LEFT JOIN o ON o.difficulty = x.difficulty AND NOT should_block GROUP BY ALL""",
    "gate_breakdown": f"""WITH {SINGLE}
SELECT expected, stage AS actual, count(*) AS n, CAST(grouping(expected, stage) AS BIGINT) AS level FROM o GROUP BY GROUPING SETS ((expected), (stage), (expected, stage))""",
    "shape_baseline": f"WITH {VARIED}, {classified('v', 'h')} SELECT doc_id, part, is_empty OR (looks AND j IS NULL) AS flagged FROM h",
    "bench_results": f"SELECT * FROM (VALUES {_bench_rows()}) t(run_id, actual, passed, stage, reason_code, control, guard_effect)",
    "bench_summary": f"SELECT * FROM (VALUES {', '.join(f'({q(k)}, CAST({v} AS BIGINT))' for k, v in _METRICS.items())}) t(metric, value)",
    "bench_rates": f"SELECT * FROM (VALUES {', '.join(f'({q(k)}, {q(d)}, {q(p)}, CAST({n} AS BIGINT), CAST({m} AS BIGINT), {q(_label(n, m))})' for k, d, p, n, m in _RATES)}) t(kind, difficulty, provenance, numerator, denominator, label)",
    "control_evidence": f"""WITH {CHECKED} SELECT outputs.run_id, 'delivered' AS control, count(ch.chunk_id) AS chunk_count, coalesce(string_agg(chunk_id, ',' ORDER BY ordinal), '') AS chunk_ids,
  coalesce(string_agg(substr(d, 1, 16), ',' ORDER BY ordinal), '') AS content_hashes, coalesce(string_agg(channel || ':T' || rank, ',' ORDER BY ordinal), '') AS labels, substr(sha256(any_value(output)), 1, 16) AS output_hash
FROM outputs LEFT JOIN ch ON outputs.run_id = ch.run_id GROUP BY outputs.run_id""",
}

assert set(outcome.DIFFICULTIES) == {"basic", "hard", "mixed"}
