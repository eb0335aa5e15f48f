"""Helpers that the operators of this package share.

Intermediate tables are ``cut`` into the folder that the driver and the executors share, so that later jobs neither repeat
the work before them nor depend on an executor that may be lost; a ``scope`` removes its tables when it ends.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from evidentia.staging import cut, fresh_dir, scope, shared_dir

__all__ = ["cut", "fresh_dir", "held_out", "lower_ascii", "scope", "session", "shared_dir", "texts_of", "unit_hash", "unused"]

#: Rows and bytes of one Arrow batch at most: whole texts may be long, and rows of numbers are short.
ARROW_ROWS = 2048
ARROW_BYTES = 1 << 20

#: White space that separates words, as a Java and as an RE2 character class.
WORD = r"[^\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def session(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session; smaller bounds that are set already stay."""
    for key, most, usual in (("maxRecordsPerBatch", ARROW_ROWS, 10000), ("maxBytesPerBatch", ARROW_BYTES, 2**31 - 1)):
        name = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(name, str(usual))
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, str(most))
    return spark


def lower_ascii(c: Column) -> Column:
    """A-Z to lower case and nothing else."""
    return F.translate(c, _UPPER, _UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold that no model learns from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unit_hash(c: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the value alone."""
    return F.pmod(F.xxhash64(c.cast("string"), F.lit(salt)), F.lit(1 << 52)) / float(1 << 52)


def texts_of(column: pa.Array, start: int, size: int) -> list[str]:
    """A slice of a string column, null as the empty text."""
    return [x or "" for x in column.slice(start, size).to_pylist()]


def unused(name: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
