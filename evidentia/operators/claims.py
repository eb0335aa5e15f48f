"""Claim extraction: sentences of an output with their offsets, without questions, hedges and fragments."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from evidentia.functions.jsonfacts import SPACES
from evidentia.functions.text import B0, B1, WS, tokenize

#: Abbreviations that end no sentence.
ABBREVIATIONS = set(
    "al approx apr aug avg cf co corp dec dept dr eg est etc feb fig gen ie inc jan jr jul jun ltd mar max min mr mrs ms mt "
    "no nov oct prof rev sec sep sept sr st vs".split()
)
_S = f"[{SPACES}]"
#: Lines that are formatting alone, markup before a line's text, and what opens or closes a block of code.
FORMATTING = re.compile(rf"#{{1,6}}{_S}*[^{SPACES}]*|[-*_]{{3,}}|\|?[{SPACES}:|-]+\|?|[>{SPACES}]*|[-*+]{_S}*|[0-9]+[.)]{_S}*")
MARKUP = re.compile(rf"(?:{_S}*(?:>|[-*+]|[0-9]+[.)]|#{{1,6}}){_S}+)+")
FENCE = re.compile(r"(?:\A|(?<=[\n\r\u2028\u2029]))[ \t]*(?:```|~~~)")
STARTS = set("\"'\u201c([ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
STOPS = re.compile(r"[.!?]+")
_SPACE, _LETTER = set(SPACES), set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Wording that commits to nothing.
HEDGES = [
    rf"(?i){B0}(?:might|maybe|perhaps|possibly|probably|presumably|arguably|apparently|allegedly|reportedly|potentially|seemingly|supposedly){B1}",
    rf"(?i){B0}(?:seems?|appears?|suggests?|indicates?){B1}",
    rf"(?i){B0}(?:could|would|should|can){WS}+(?:be|have|include|indicate|mean|imply|suggest){B1}",
    rf"(?i){B0}(?:i|we){WS}+(?:think|believe|suspect|assume|guess|expect){B1}",
    rf"(?i){B0}(?:not{WS}+(?:sure|certain|clear)|unclear|uncertain|unconfirmed|hard{WS}+to{WS}+say){B1}",
    rf"(?i){B0}(?:as{WS}+far{WS}+as{WS}+(?:i|we){WS}+know|to{WS}+my{WS}+knowledge|if{WS}+(?:i|we){WS}+recall){B1}",
    rf"(?i){B0}(?:likely|unlikely){B1}",
    rf"(?i){B0}(?:roughly|approximately|estimated){B1}|{B0}(?:around|about){WS}+[0-9]",
    rf"{B0}may{B1}",
]
NAMES = ["text", "cp_start", "span_start", "span_end"]
RAW = ArrayType(StructType([StructField(n, StringType() if n == "text" else IntegerType()) for n in NAMES]))
_LONGEST = max(map(len, ABBREVIATIONS))


def sentences(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Begin and end of each sentence of ``text[a:b]``, without white space around it, in one pass.

    A run of stops ends a sentence if white space or the end follows, if the word before it is neither one
    letter nor an abbreviation, and if what comes next begins as sentences do.
    """
    start = a
    for m in STOPS.finditer(text, a, b):
        end = after = m.end()
        while after < b and text[after] in _SPACE:
            after += 1
        if after == end < b:
            continue
        word = m.start()
        while word > a and m.start() - word <= _LONGEST and text[word - 1] in _LETTER:
            word -= 1
        if m.start() - word == 1 or text[word : m.start()].lower() in ABBREVIATIONS or (after < b and text[after] not in STARTS):
            continue
        yield from trimmed(text, start, end)
        start = after
    yield from trimmed(text, start, b)


def trimmed(text: str, a: int, b: int) -> Iterator[tuple[int, int]]:
    while a < b and text[a] in _SPACE:
        a += 1
    while b > a and text[b - 1] in _SPACE:
        b -= 1
    if a < b:
        yield a, b


def segments(output: str) -> Iterator[tuple[int, int]]:
    """Lines that begin outside blocks of code, without their markup, and the cells of table lines."""
    marks = [m.start() for m in FENCE.finditer(output)]
    closed = [output.find("\n", i) + 1 or len(output) + 1 for i in marks]
    at = 0
    for line in output.split("\n"):
        begin, at = at, at + len(line) + 1
        before = bisect_right(marks, begin)  # an odd number of marks opened a block; an even one's last mark ends with its line
        if before % 2 or (before and begin < closed[before - 1]):
            continue
        for a, b in trimmed(output, begin, begin + len(line)):
            if FORMATTING.fullmatch(output, a, b):
                continue
            m = MARKUP.match(output, a, b)
            a = m.end() if m else a
            if output.find("|", a, b) < 0:
                yield a, b
                continue
            for part in output[a:b].split("|"):
                yield a, a + len(part)
                a += len(part) + 1


def raw_claims(output: str) -> list[tuple[str, int, int, int]]:
    """All sentences: text, code point offset, and begin and end in UTF-16 units."""
    spans = [s for a, b in segments(output) for s in sentences(output, a, b)]
    if output.isascii() or max(output) <= "\uffff":
        return [(output[a:b], a, a, b) for a, b in spans]
    wide = [i for i, c in enumerate(output) if c > "\uffff"]
    return [(output[a:b], a, a + bisect_right(wide, a - 1), b + bisect_right(wide, b - 1)) for a, b in spans]


@F.arrow_udf(RAW)
def _raw(outputs: pa.Array) -> pa.Array:
    found = [raw_claims(o or "") for o in outputs.to_pylist()]
    rows = [r for f in found for r in f]
    columns = [pa.array([r[i] for r in rows], pa.string() if n == "text" else pa.int32()) for i, n in enumerate(NAMES)]
    ends = [0]
    for f in found:
        ends.append(ends[-1] + len(f))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, NAMES))


def substantive(c: Column) -> Column:
    t = tokenize(c)
    return (F.size(t) >= 3) & F.exists(t, lambda x: x.rlike("[a-z]{2,}"))


def is_question(c: Column) -> Column:
    return c.rlike("\\?[\"'\u2019\u201d)\\]]*\\z")


def is_hedged(c: Column) -> Column:
    found = F.lit(False)
    for p in HEDGES:
        found = found | c.rlike(p)
    return found


def is_claim(c: Column) -> Column:
    """Whether a sentence asserts something: enough words, no question, no hedge."""
    return substantive(c) & ~is_question(c) & ~is_hedged(c)


def extract_claims(outputs: DataFrame) -> DataFrame:
    """``run_id, claim_id, claim_seq, text, cp_start, span_start, span_end``; ids count from 0 what the filters left.

    The sentence scan is the only Python; filters are Catalyst expressions over the array of an output's
    sentences, so claims are numbered where they are and nothing is shuffled.
    """
    kept = F.filter(_raw(F.col("output")), lambda c: is_claim(c["text"]))
    return outputs.select("run_id", F.posexplode(kept).alias("claim_seq", "_c")).select(
        "run_id", F.concat(F.lit("claim-"), F.col("claim_seq").cast("string")).alias("claim_id"), "claim_seq", "_c.*"
    )
