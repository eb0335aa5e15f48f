"""Inbound classification: what a payload is, and which channel and tier that leaves it.

Patterns are spelled for Java such that white space, word borders and line ends are those the
semantics are defined by.  A pattern is only run where a fixed part of it occurs in the text, and
what can only tip a balance is only counted where there is a balance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.jsonfacts import DEGRADED, json_facts
from evidentia.functions.text import B0, B1, BLANK, BOL, DOT, EOL, NOT_WS, WS

# Phrases of bare status lines, error wording, and the names of response headers.
PHRASES = (
    "Bad Request|Unauthorized|Forbidden|Not Found|Request Timeout|Conflict|Gone|Payload Too Large|URI Too Long|Unsupported Media Type|"
    "Unprocessable Entity|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service Unavailable|Gateway Timeout|"
    "Service Temporarily Unavailable"
)
MARKERS = "error|errors|exception|failed|failure|unavailable|timeout|timed out|denied|forbidden|invalid|unreachable|refused"
HEADERS = "content-type|content-length|date|server|retry-after|x-request-id|www-authenticate"
#: Shapes of traces and of shell output, each after lower-case parts of which any text with the shape has one.
STACK = [
    (["traceback (most recent call last):"], r"(?i)Traceback \(most recent call last\):"),
    (['file "'], rf'(?i){BOL}{BLANK}*File "{DOT}+?", line [0-9]+, in {DOT}+{EOL}'),
    (["at "], rf"{BOL}{BLANK}*at {DOT}+ \({DOT}+:[0-9]+:[0-9]+\){EOL}"),
    (["at "], rf"{BOL}{BLANK}*at [A-Za-z0-9_.$<>]+\(?{DOT}+:[0-9]+\)?{EOL}"),
    (['exception in thread "'], f'Exception in thread "{DOT}+"'),
    (["error: ", "exception: "], rf"{BOL}[A-Za-z0-9_]*(?:Error|Exception): {DOT}+"),
]
SHELL = [
    (["sh:"], rf"(?i){BOL}(?:zsh|bash|sh|fish|pwsh):{WS}+{DOT}+"),
    (["command not found", "no such file or directory", "permission denied"], rf"(?i){B0}(?:command not found|No such file or directory|Permission denied){B1}"),
    (["fatal:", "error:"], rf"(?i){BOL}(?:fatal|error):{WS}+{DOT}+"),
    (["npm err!"], rf"(?i){BOL}npm ERR!{WS}+{DOT}+"),
    (["yarn "], rf"(?i){BOL}yarn (?:error|ERR!){WS}+{DOT}+"),
    (["pnpm err!"], rf"(?i){BOL}pnpm ERR!{WS}+{DOT}+"),
]
#: A line that ends in a place of a source file, as the lines of some traces do.
PLACE = rf":[0-9]+\)?{EOL}"
#: The best tier a channel can justify, and the tier that an explicit 2xx gives it.
CEILING = {"USER_MESSAGE": 1, "TOOL_RESULT": 2, "RETRIEVED_DOC": 3, "CACHE": 4, "AGENT_OUTPUT": 4, "SYSTEM_ALERT": 5, "DIAGNOSTIC_LOG": 5, "UNLABELED": 5}
OK_TIER = {"TOOL_RESULT": 2, "RETRIEVED_DOC": 3, "CACHE": 4}
SUSPICIOUS = ["empty", "non_ok_status", "http_error", "html_error", "truncated_json", "degraded_result", "stack_trace", "shell_diagnostic"]
EPOCH = "1970-01-01T00:00:00.000Z"


def is_ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def is_http(status: Column) -> Column:
    return F.coalesce(status.between(100, 599), F.lit(False))


def rank(tier: Column) -> Column:
    return F.substring(tier, 2, 1).cast("int")


def lookup(pairs: dict[str, int], key: Column, other: int) -> Column:
    known = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(F.element_at(known, key), F.lit(other))


def any_of(text: Column, low: Column, shapes: list[tuple[list[str], str]]) -> Column:
    found = F.lit(False)
    for parts, pattern in shapes:
        near = F.lit(False)
        for part in parts:
            near = near | F.contains(low, F.lit(part))
        if parts == ["at "]:
            near = near & text.rlike(PLACE)
        found = found | (near & text.rlike(pattern))
    return found


def error_columns(df: DataFrame) -> DataFrame:
    """Add ``_error``, whether the text is an error response, and ``_status``, the status it shows; ``df`` has text, _low and _json.

    Evidence adds up: a status line at the start 1, a bare status line 0.6, a JSON error 0.8, an HTML
    error page 0.8, response headers 0.3, and the density of error wording up to 0.3; 0.6 is enough.  So the
    density, for which all words are counted, decides only where there is nothing but headers.
    """
    t = F.col("text")
    number = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int")
    lead = number(rf"\A{WS}*+HTTP/[0-9](?:\.[0-9])?{WS}+([45][0-9]{{2}})(?![A-Za-z0-9_])")
    opening = F.lit(False)  # a line that may begin with a status, by cheap tests
    for mark in ("4", "5", " ", "\t"):
        opening = opening | F.startswith(t, F.lit(mark)) | F.contains(t, F.lit("\n" + mark))
    for end in ("\r", "\u2028", "\u2029"):
        opening = opening | F.contains(t, F.lit(end))
    bare = F.when(opening, number(rf"(?i){BOL}[ \t]*+([45][0-9]{{2}})[ \t]+(?:{PHRASES})[ \t]*\r?{EOL}"))
    tag = F.contains(t, F.lit("<")) & t.rlike(rf"(?i)<(?:!doctype{WS}+html|html|head|body)(?![A-Za-z0-9_])")
    page = F.when(tag, number(rf"(?i)<(?:title|h1)[^>]*>{WS}*+([45][0-9]{{2}}){WS}[^<]+</(?:title|h1)>"))
    in_line, named = WS.replace(r"\n", ""), F.lit(False)
    for name in HEADERS.split("|"):
        named = named | F.contains("_low", F.lit(name + ":"))
    head = named & t.rlike(rf"(?i)\A(?:[^\n]*+\n){{0,7}}(?:{HEADERS}):{in_line}*{NOT_WS}")
    df = df.withColumns({"_lead": lead, "_bare": bare, "_page": page, "_head": head})
    found = F.coalesce(F.col("_json.error_found"), F.lit(False))
    add = lambda c, w: F.when(c, w).otherwise(0.0)
    score = add(F.col("_lead").isNotNull(), 1.0) + add(F.col("_bare").isNotNull(), 0.6) + add(found, 0.8)
    score = score + add(F.col("_page").isNotNull(), 0.8) + add(F.col("_head"), 0.3)
    density = F.regexp_count(t, F.lit(rf"(?i){B0}(?:{MARKERS}){B1}")) / F.regexp_count(t, F.lit(rf"{NOT_WS}+"))
    df = df.withColumn("_score", score)
    error = F.when(F.col("_score") >= 0.6, True).when(F.col("_head"), F.col("_score") + F.least(F.lit(0.3), density * 2) >= 0.6).otherwise(False)
    return df.withColumns({"_error": error, "_status": F.coalesce("_lead", "_bare", F.when(found, F.col("_json.error_status")), "_page")})


def prepare(df: DataFrame) -> DataFrame:
    """Columns that signatures and reasons are read from; the JSON pass is one Arrow UDF.  A null text counts as empty."""
    t, j = F.col("text"), F.col("_json")
    df = error_columns(df.withColumn("text", F.coalesce(t, F.lit(""))).withColumns({"_json": json_facts(t), "_low": F.lower(t)}))
    ends = t.rlike(rf"(?:\.\.\.|…){WS}*+\z")
    few = t.rlike(rf"\A{WS}*+(?:{NOT_WS}++(?:{WS}++|\z)){{0,60}}+\z")
    marks = F.regexp_count(t, F.lit(rf"(?i){B0}(?:{DEGRADED}){B1}"))
    return df.withColumns(
        {
            "_empty": ~t.rlike(NOT_WS),
            "_truncated": F.when(j["parses"], False).when(j["parses"].isNotNull(), ends | j["unclosed"]).otherwise(False),
            "_degraded": F.when(F.coalesce(j["parses"], F.lit(False)), j["degraded"]).when(few, marks >= 2).otherwise(False),
        }
    )


def signature(status: Column) -> Column:
    """The first class that fits, given the status to judge by; needs the columns that ``prepare`` adds."""
    t, low = F.col("text"), F.col("_low")
    return (
        F.when(F.col("_empty"), "empty")
        .when(status.isNotNull() & ~is_ok(status), "non_ok_status")
        .when(F.col("_error"), "http_error")
        .when(F.col("_truncated"), "truncated_json")
        .when(F.col("_degraded"), "degraded_result")
        .when(any_of(t, low, STACK), "stack_trace")
        .when(any_of(t, low, SHELL), "shell_diagnostic")
        .when(is_ok(status), "recognized_ok_status")
        .otherwise("unrecognized")
    )


def is_suspicious(signature: Column) -> Column:
    return signature.isin(SUSPICIOUS)


def classify(chunks: DataFrame) -> DataFrame:
    """Add chunk_id, source_id, content_hash, retrieved_at, status, signature, channel and tier to raw chunks.

    Needs text, hint_channel, hint_tier, hint_status; hint_source_id, hint_content_hash and
    hint_retrieved_at are optional columns, as is chunk_id, which is made where it is null.  The
    row-wise plan has no shuffle.
    """
    for c in ("hint_source_id", "hint_content_hash", "hint_retrieved_at", "chunk_id"):
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.lit(None).cast("string"))
    digest = F.sha2(F.col("text"), 256)
    df = prepare(chunks).withColumns(
        {
            "content_hash": F.coalesce("hint_content_hash", F.concat(F.lit("sha256:"), digest)),
            "source_id": F.coalesce("hint_source_id", F.concat(F.lit("source:"), F.substring(digest, 1, 16))),
            "retrieved_at": F.coalesce("hint_retrieved_at", F.lit(EPOCH)),
            "status": F.coalesce("hint_status", "_status"),
        }
    )
    df = df.withColumn("signature", signature(F.col("status")))
    sig, declared, ok = F.col("signature"), F.col("hint_channel"), F.col("signature") == "recognized_ok_status"
    ceiling = lookup(CEILING, declared, 5)
    with_ok = lookup(OK_TIER, declared, 5)
    both = declared.isNotNull() & F.col("hint_tier").isNotNull()
    channel = (
        F.when(sig.isin("http_error", "html_error", "non_ok_status"), "SYSTEM_ALERT")
        .when(sig.isin("stack_trace", "shell_diagnostic", "degraded_result"), "DIAGNOSTIC_LOG")
        .when(sig.isin("empty", "truncated_json"), "UNLABELED")
        .when(both | (ok & declared.isNotNull()), declared)
        .otherwise("UNLABELED")
    )
    tier = (
        F.when(is_suspicious(sig), 5)
        .when(both, F.greatest(rank(F.col("hint_tier")), ceiling, F.when(ok, with_ok).otherwise(1)))
        .when(ok & declared.isNotNull(), with_ok)
        .otherwise(5)
    )
    own_id = F.concat(F.lit("chunk:"), F.substring(F.sha2(F.concat_ws("\n", "source_id", "content_hash", "text"), 256), 1, 16))
    return df.withColumns({"channel": channel, "tier": F.concat(F.lit("T"), tier.cast("string")), "chunk_id": F.coalesce("chunk_id", own_id)})
