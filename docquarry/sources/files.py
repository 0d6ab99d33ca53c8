"""Files in and out: text, Markdown, Word, PDF by plug-in, JSON lines, TSV, and merging sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docquarry.functions.text import extension

#: Most characters of a text file, and most bytes of an unpacked Word body.
MOST_CHARS, MOST_UNZIPPED = 1 << 20, 64 << 20
# Fixed value: the namespace of Word's XML.
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
FORMATS = {"txt": "text", "md": "text", "markdown": "text", "pdf": "pdf", "docx": "docx"}


def file_format(path: Column) -> Column:
    """text, pdf or docx by extension, whatever its case; null for others."""
    ext = extension(path)
    out = F.lit(None).cast("string")
    for name, kind in FORMATS.items():
        out = F.when(ext == name, kind).otherwise(out)
    return out


def read_plain(content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a UTF-8 file: no NUL, BOM dropped, line ends unified, not blank, not too long."""
    try:
        text = content.decode("utf-8")
    except UnicodeDecodeError:
        return None, "not UTF-8"
    if "\0" in text:
        return None, "holds NUL"
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    return (None, "blank") if not text.strip() else (None, "too long") if len(text) > MOST_CHARS else (text, None)


def read_docx(content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a Word file: runs of text, tabs and breaks, a line end per paragraph; DTDs are refused."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            with archive.open("word/document.xml") as body:
                xml = body.read(MOST_UNZIPPED + 1)
    except (zipfile.BadZipFile, KeyError, RuntimeError, OSError):
        return None, "no Word file"
    if len(xml) > MOST_UNZIPPED:
        return None, "too long"
    if b"<!DOCTYPE" in xml or b"<!ENTITY" in xml:
        return None, "holds a DTD"
    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None, "no Word file"
    lines = []
    for paragraph in root.iter(f"{_W}p"):
        marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
        lines.append("".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in paragraph.iter()))
    text = "\n".join(lines).strip("\n")
    return (text, None) if text.strip() else (None, "blank")


def extracted(files: DataFrame, pdf: Callable[[bytes], tuple[str | None, str | None]] | None = None) -> DataFrame:
    """(path, format, text, error) of binary files; error tells why there is no text. pdf is the reader to plug in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        readers = {"text": read_plain, "docx": read_docx, "pdf": pdf or (lambda _: (None, "no PDF reader"))}
        for part in parts:
            got = [readers.get(kind, lambda _: (None, "unknown format"))(bytes(content)) for kind, content in zip(part["format"], part["content"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "format": part["format"], "text": [t for t, _ in got], "error": [e for _, e in got]})

    return files.select("path", file_format(F.col("path")).alias("format"), "content").mapInPandas(run, "path string, format string, text string, error string")


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, names in the first line."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def named_uuid(name: Column) -> Column:
    """A version-3 style UUID of a name: the same chunk always gets the same key."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("3"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """old with the rows of new in place of those with the same keys; of several new rows the one of the greatest values stays. Null keys never match."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc_nulls_last(c) for c in new.columns if c not in keys and not dict(new.dtypes)[c].startswith("map"))))
    latest = new.withColumn("_r", rank).where("_r = 1").drop("_r")
    return old.join(latest.select(*keys), list(keys), "left_anti").select(*old.columns).unionByName(latest.select(*old.columns))


def append_keyed(new: DataFrame, path: str, *keys: str) -> None:
    """Append the rows of new whose keys the Parquet folder doesn't hold yet, one row a key: a run that is repeated adds nothing."""
    spark = new.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    rows = new.dropDuplicates(list(keys))
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        # keys alone are read of what is there; the rows that are added don't depend on files written meanwhile
        rows = rows.join(spark.read.schema(new.schema).parquet(path).select(*keys), list(keys), "left_anti")
    rows.write.mode("append").parquet(path)


def updated(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """Columns set where the condition holds; null counts as not."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def without(df: DataFrame, condition: Column) -> DataFrame:
    """Rows deleted where the condition holds; null counts as not."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def appended(df: DataFrame, array: str, value: Column, condition: Column) -> DataFrame:
    """value pushed to an array column where the condition holds; a null array starts empty."""
    grown = F.when(F.col(array).isNull(), F.array(value)).otherwise(F.array_append(array, value))
    return df.withColumn(array, F.when(F.coalesce(condition, F.lit(False)), grown).otherwise(F.col(array)))


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """One column sql: an INSERT per row, quotes doubled, nulls as NULL."""

    def literal(c: str, kind: str) -> Column:
        text = F.col(c).cast("string")
        quoted = text if kind in ("int", "bigint", "double", "float", "smallint", "boolean") else F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(quoted, F.lit("NULL"))

    values = F.concat_ws(", ", *(literal(c, k) for c, k in df.dtypes))
    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("sql"))
