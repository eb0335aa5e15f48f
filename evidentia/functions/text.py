"""Text functions as Catalyst expressions.

Java's character classes differ from those the semantics are defined by: white space is spelled
out, word borders are ASCII look-arounds, and the end of input is ``\\z``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, the byte order mark and the no-break space included.
WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
NOT_WS = "[^" + WS[1:]
#: White space within a line.
BLANK = WS.replace(r"\n", "").replace(r"\r", "").replace(r"\u2028\u2029", "")
#: A character within a line, and the places where a line begins and ends.
DOT = r"[^\n\r\u2028\u2029]"
BOL, EOL = rf"(?<!{DOT})", rf"(?!{DOT})"
#: Before and after a word of ASCII letters, digits and underscores.
B0, B1 = r"(?<![A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"

# Characters that folding replaces one by one, and by what.
_FOLD_FROM = "\u2018\u2019\u201a\u201b\u2032" "\u201c\u201d\u201e\u201f\u2033" "\u2010\u2011\u2012\u2013\u2014\u2015\u2212"
_FOLD_TO = "'" * 5 + '"' * 5 + "-" * 7
_FOLD_SPACE = "\u00a0" + "".join(map(chr, range(0x2000, 0x200C))) + "\u202f\u205f\u3000\ufeff"

#: Words without content.
STOPWORDS = """
a about above after again against all also am an and any are as at be because been before being below between both but
by can did do does doing down during each few for from further had has have having he her here hers herself him himself
his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours
ourselves out over own same she should so some such than that the their theirs them themselves then there these they
this those through to too under until up very was we were what when where which while who whom why will with would you
your yours yourself
""".split()

#: Words that are capitalised at the start of a sentence without naming anything.
NOT_NAMES = """
a additionally after all also although an and another any as at because before both but by consequently during each
either every finally first for from further furthermore he her here his how however i if in instead into it its
meanwhile moreover most much neither never nevertheless no nor not of on once one only or other our overall per
primarily she since so some specifically still such that the their then there therefore these they this those though
thus to typically under unlike until via we what when where whether which while who why with within without yet you your
""".split()

#: Shapes of identifiers.
IDENTIFIER = "|".join(
    [
        r"^[A-Z]{2,}\z",
        r"^(?=.*_)(?=.*[A-Za-z])",
        r"^[a-z]+[A-Z]",
        r"^[A-Za-z][A-Za-z0-9_-]*\.[A-Za-z][A-Za-z0-9_.]*\z",
        r"^(?i:https?)://",
        r"^(?i:[A-Za-z0-9_-]+\.(?:com|org|net|io|dev|gov|edu))(?![A-Za-z0-9_])",
    ]
)


def js_trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}++|(?<!{WS}){WS}++\z", "")


def fold(c: Column) -> Column:
    """Typographic quotes, dashes, spaces and the ellipsis to ASCII."""
    return F.replace(F.translate(c, _FOLD_FROM + _FOLD_SPACE, _FOLD_TO + " " * len(_FOLD_SPACE)), F.lit("\u2026"), F.lit("..."))


def normalize(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(fold(c)), "[^a-z0-9]+", " "))


def tokens_of_normalized(n: Column) -> Column:
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def tokenize(c: Column) -> Column:
    return tokens_of_normalized(normalize(c))


def content_of_tokens(t: Column) -> Column:
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(t, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))


def content_tokens(c: Column) -> Column:
    return content_of_tokens(tokenize(c))


def contains_phrase(haystack: Column, needle: Column) -> Column:
    """Whole-word containment of one normalized text in another; an empty needle is not contained."""
    sp = F.lit(" ")
    return (needle != "") & F.contains(F.concat(sp, haystack, sp), F.concat(sp, needle, sp))


def strip_trailing(c: Column) -> Column:
    tail = "[.!?,;:\"'\u2019\u201d)\\]" + WS[1:]
    return F.regexp_replace(c, rf"(?<!{tail}){tail}++\z", "")


def numbers(c: Column) -> Column:
    """Versions as written, then numbers without their commas; distinct, in order of appearance."""
    f = fold(c)
    versions = F.regexp_extract_all(f, F.lit(rf"({B0}[0-9]+(?:\.[0-9]+){{2,}}{B1})"), 1)
    plain = F.regexp_extract_all(f, F.lit(rf"({B0}[0-9][0-9,]*(?:\.[0-9]+)?{B1})"), 1)
    return F.array_distinct(F.concat(versions, F.transform(plain, lambda x: F.replace(x, F.lit(","), F.lit("")))))


def is_identifier(c: Column) -> Column:
    return c.rlike(IDENTIFIER)


def entities(c: Column) -> Column:
    """Names and identifiers: code spans, quoted spans, then capitalised or identifier-like tokens; distinct by case, in this order."""
    f = fold(c)
    spans = F.concat(F.regexp_extract_all(f, F.lit("`([^`]+)`"), 1), F.regexp_extract_all(f, F.lit('"([^"]{2,})"'), 1))
    raw = F.regexp_extract_all(f, F.lit(r"([A-Za-z][A-Za-z0-9_.:/-]*)"), 1)
    plain = F.array(*map(F.lit, NOT_NAMES))
    words = F.filter(
        F.transform(raw, lambda x: F.regexp_replace(x, r"[.,;:/-]+\z", "")),
        lambda x: is_identifier(x) | (x.rlike("^[A-Z]") & ~F.array_contains(plain, F.lower(x))),
    )
    both = F.transform(F.concat(spans, words), js_trim)
    return F.array_distinct(F.filter(both, lambda x: x.rlike("[A-Za-z]") & (normalize(x) != "")))
