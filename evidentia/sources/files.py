"""Reading one input file with typed errors."""

from __future__ import annotations

from pyspark.sql import SparkSession

from evidentia.functions.errors import InputError
from evidentia.functions.jsonfacts import parse


def read_input(spark: SparkSession, path: str, what: str) -> str:
    """The text of a file that Spark's file systems reach; directories, missing and unreadable files have codes of their own."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(target):
            raise InputError("INPUT_NOT_FOUND", f"{what} file does not exist: {path}", "Check the path, or generate the file first.")
        if fs.getFileStatus(target).isDirectory():
            raise InputError("INPUT_IS_DIRECTORY", f"{what} path is a directory, not a file: {path}", "Pass the path to a file.")
        stream = fs.open(target)
        try:
            return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
    except InputError:
        raise
    except Exception as e:
        denied = "AccessControl" in str(e) or "Permission denied" in str(e)
        said = f"{what} file cannot be read: {path}" if denied else f"{what} file could not be read: {path}"
        raise InputError("INPUT_NOT_READABLE", said, "Check the file's permissions." if denied else "Check that the path is a readable file.", e) from e


def parse_json(text: str, path: str, what: str) -> object:
    try:
        return parse(text)
    except ValueError as e:
        raise InputError("INPUT_MALFORMED_JSON", f"{what} file is not valid JSON: {path}", str(e) or "Check the file contents.", e) from e


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write one small text file, replacing what is there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        stream = fs.create(target, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
    except Exception as e:
        raise InputError("OUTPUT_NOT_WRITABLE", f"output cannot be written: {path}", "Check the folder and its permissions.", e) from e
