"""Document parsers by name, golden records, snapshot tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A parser turns the bytes of one file into (text blocks, tables of (page, rows)) or raises.
Parser = Callable[[bytes], tuple[list[str], list[tuple[int, list[list[str]]]]]]
PARSERS: dict[str, Callable[[], Parser]] = {}

PARSED = "struct<text_blocks:array<string>,tables:array<struct<page_no:int,rows:array<array<string>>>>,error_type:string,error_message:string>"


def register_parser(name: str, factory: Callable[[], Parser]) -> None:
    """``factory`` is called once per Python worker, so that a model is loaded once."""
    PARSERS[name] = factory


def text_parser() -> Parser:
    """Plain text: blocks are paragraphs, runs of tab-separated lines are tables."""

    def parse(content: bytes) -> tuple[list[str], list[tuple[int, list[list[str]]]]]:
        blocks, tables = [], []
        for part in content.decode("utf-8", errors="replace").replace("\r", "").split("\n\n"):
            lines = [x for x in part.split("\n") if x.strip()]
            if lines and all("\t" in x for x in lines):
                tables.append((1, [[c.strip() for c in x.split("\t")] for x in lines]))
            elif lines:
                blocks.append("\n".join(x.strip() for x in lines))
        if not blocks and not tables:
            raise ValueError("no content")
        return blocks, tables

    return parse


register_parser("text", text_parser)


def parse_documents(files: DataFrame, parser: str, content: str = "content") -> DataFrame:
    """Adds text_blocks, tables, error_type and error_message; a file that cannot be read keeps its row."""
    if parser not in PARSERS:
        raise ValueError(f"unknown document parser {parser!r}; known are {sorted(PARSERS)}")
    factory = PARSERS[parser]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parse = factory()
        for contents in batches:
            rows = []
            for c in contents:
                try:
                    blocks, tables = parse(bytes(c))
                    rows.append({"text_blocks": blocks, "tables": [{"page_no": p, "rows": r} for p, r in tables], "error_type": None, "error_message": None})
                except Exception as e:  # noqa: BLE001 - whatever a parser raises is this file's permanent error
                    rows.append({"text_blocks": None, "tables": None, "error_type": "DocumentParse", "error_message": str(e)[:500]})
            yield pd.DataFrame(rows)

    return files.withColumn("_p", F.pandas_udf(run, PARSED)(content)).select(*files.columns, "_p.*")


def read_golden(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One expected record per JSON file."""
    return spark.read.schema(schema).option("multiLine", True).json(folder)


def _pointer(spark: SparkSession, root: str):
    """File system (any that Hadoop knows) and path of the pointer to the current version."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_current")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a new version beside the older ones and then point to it: readers never see half a table.

    The version before stays for those who still read it; older ones are deleted.
    """
    version, before = uuid.uuid4().hex, current_version(df.sparkSession, root)
    df.write.parquet(f"{root}/{version}")
    fs, path = _pointer(df.sparkSession, root)
    out = fs.create(path, True)
    try:
        out.writeBytes(version)
    finally:
        out.close()
    for old in fs.listStatus(path.getParent()):
        if old.isDirectory() and old.getPath().getName() not in (version, before):
            fs.delete(old.getPath(), True)
    return version


def current_version(spark: SparkSession, root: str) -> str | None:
    fs, path = _pointer(spark, root)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def read_snapshot(spark: SparkSession, root: str, schema: str | StructType) -> DataFrame:
    """The current version, or an empty table of the schema before the first write."""
    version = current_version(spark, root)
    return spark.read.schema(schema).parquet(f"{root}/{version}") if version else spark.createDataFrame([], schema)
