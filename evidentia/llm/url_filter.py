"""URL filter: host-suffix and path-prefix expressions joined on hash prefixes.

A rule is a host and a path.  It fits its host and every subdomain of it, where the path of the
URL starts with the rule's path.  Each URL is expanded into the expressions ``host suffix + path
directory``; the first four bytes of their SHA-256 digests are equi-joined with those of the
rules, and a candidate counts only if the full digest of host suffix and path prefix is the
rule's.  Of the rules that fit, the longest wins (then the longer host, then block).

The expansion stops at the most host labels and path directories that any rule has: a longer
expression cannot equal a rule.  The rules are broadcast only while their measured size is
within ``broadcast_bytes``; larger rule sets are joined by shuffle with a salted URL side, so a
rule that fits a third of all URLs is spread over ``salts`` partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import lower_ascii

SEP = "\n"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the URL is null or has no ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", i), F.lit(""))
    return lower_ascii(part(1)), part(2)


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def _expressions(host: Column, path: Column, labels: int, depth: int) -> Column:
    parts = F.split(host, r"\.")
    n = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(n, F.lit(labels))),
        lambda i: F.array_join(F.slice(parts, n - i + 1, i), "."),
    )
    directories = F.concat(
        F.array(F.lit("")),
        F.transform(
            F.filter(F.sequence(F.lit(1), F.lit(max(depth, 1))), lambda k: (k <= _slashes(path)) & (k <= depth)),
            lambda k: F.concat(F.call_function("substring_index", path, F.lit("/"), k), F.lit("/")),
        ),
    )
    return F.flatten(F.transform(suffixes, lambda h: F.transform(directories, lambda d: F.struct(h.alias("h"), d.alias("d")))))


def judge_urls(
    urls: DataFrame,
    rules: DataFrame,
    key: str = "page_id",
    url: str = "url",
    default: str = "allow",
    broadcast_bytes: int = 8 << 20,
    salts: int = 32,
) -> DataFrame:
    """Return ``key, host, path, rule, verdict, digest`` for every row of ``urls``.

    ``rules`` has host, path and verdict (allow or block); of equal rules with different verdicts
    block holds, and rows with a null are no rules.  ``digest`` is the SHA-256 of the rule that
    decided.  Null and malformed URLs have an empty host and path and get ``default`` unless a
    rule has an empty host.  Repeated rows give as many equal rows; other columns of ``urls``,
    whatever their names, are not read.  Empty tables give empty results.
    """
    h, p = host_and_path(F.col("_u"))
    pages = (
        urls.select(F.col(key).alias("_k"), F.col(url).alias("_u"))
        .groupBy("_k", "_u")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_h": h, "_p": p})
    )
    last = F.col("_rp")
    own = (
        rules.select(lower_ascii(F.col("host")).alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv"))
        .dropna()
        .groupBy("_rh", "_rp")
        .agg(F.max("_rv").alias("_rv"))
        .withColumns(
            {
                "_dir": F.substring(last, F.lit(1), F.length(last) - F.length(F.regexp_extract(last, r"([^/]*)\z", 1))),
                "_full": F.sha2(F.concat(F.col("_rh"), F.lit(SEP), last), 256),
                "_len": F.length(F.concat("_rh", "_rp")),
            }
        )
        .withColumn("_short", F.substring(F.sha2(F.concat("_rh", F.lit(SEP), "_dir"), 256), 1, 8))
    )
    size = own.agg(
        F.coalesce(F.sum(F.octet_length(F.concat("_rh", "_rp")) + 200), F.lit(0)).alias("bytes"),
        F.coalesce(F.max(F.size(F.split("_rh", r"\."))), F.lit(1)).alias("labels"),
        F.coalesce(F.max(_slashes(F.col("_rp"))), F.lit(0)).alias("depth"),
    ).first()
    found = (
        pages.withColumn("_e", F.explode(_expressions(F.col("_h"), F.col("_p"), size["labels"], size["depth"])))
        .withColumn("_short", F.substring(F.sha2(F.concat("_e.h", F.lit(SEP), "_e.d"), 256), 1, 8))
    )
    on = ["_short"]
    if size["bytes"] <= broadcast_bytes:
        own = F.broadcast(own)
    else:
        on.append("_salt")
        found = found.withColumn("_salt", F.pmod(F.xxhash64("_k", "_u"), F.lit(salts)))
        own = own.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("_salt", F.col("_salt").cast("long"))
    fits = F.col("_full") == F.sha2(
        F.concat(F.col("_e.h"), F.lit(SEP), F.substring(F.col("_p"), F.lit(1), F.length("_rp"))), 256
    )
    best = F.max(F.when(fits, F.struct("_len", F.length("_rh").alias("_hl"), "_rv", "_rh", "_rp", "_full")))
    return (
        found.join(own, on, "left")
        .groupBy("_k", "_u", "_n", "_h", "_p")
        .agg(best.alias("_b"))
        .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))))
        .select(
            F.col("_k").alias(key),
            F.col("_h").alias("host"),
            F.col("_p").alias("path"),
            F.concat("_b._rh", "_b._rp").alias("rule"),
            F.coalesce("_b._rv", F.lit(default)).alias("verdict"),
            F.col("_b._full").alias("digest"),
        )
    )
