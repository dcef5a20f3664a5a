"""Readers and writers of document collections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.arrow import map_columns

BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def read_files(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """One row a file: path, modificationTime, length, content. The content is
    only read where a query uses it."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def stream_files(spark: SparkSession, path: str, glob: str | None = None, per_trigger: int = 1000) -> DataFrame:
    """The same rows as a stream over a directory."""
    r = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", per_trigger)
    return (r.option("pathGlobFilter", glob) if glob else r).load(path)


def pdf_pages(df: DataFrame, rasteriser: Callable[[bytes], Iterator[bytes]], id_col: str = "path") -> DataFrame:
    """(id, page_no, image, error): pages from 1 in order, by a plug-in that
    yields one image a page. Files without a PDF head or that fail keep one row with an error."""

    def fn(ids, contents):
        rows = []
        for i, c in zip(ids, contents):
            if not (c or b"").startswith(b"%PDF"):
                rows.append((i, None, None, "not a PDF"))
                continue
            try:
                rows += [(i, n, img, None) for n, img in enumerate(rasteriser(c), 1)]
            except Exception as e:  # noqa: BLE001 - the row keeps its place
                rows.append((i, None, None, f"{type(e).__name__}: {e}"))
        return dict(zip((id_col, "page_no", "image", "error"), map(list, zip(*rows) if rows else [()] * 4)))

    kind = df.schema[id_col].dataType.simpleString()
    return map_columns(df.select(id_col, "content"), fn, f"{id_col} {kind}, page_no int, image binary, error string")


def write_json(df: DataFrame, path: str, pretty: bool = False) -> None:
    out = df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"}).alias("value"))
    out.write.text(path) if not pretty else out.write.option("lineSep", "\n\n").text(path)


def write_markdown(df: DataFrame, path: str, column: str = "markdown") -> None:
    """Only the Markdown, a parquet row a document (text files cannot hold its line ends)."""
    df.select(column).write.parquet(path)
