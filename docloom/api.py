"""The public surface in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.detect import file_info, supported_types
from docloom.functions.validate import DEFAULT_MODELS, MODEL_LISTS
from docloom.operators.nested import nested_records, subtype_table
from docloom.operators.pipeline import Calls, ConvertOptions, Extractor, ProviderConfig, convert, extract, extract_by_page, extract_invoices, extract_receipts, extract_tables, register_converter
from docloom.operators.schemas import SCHEMAS as schemas
from docloom.operators.schemas import from_json, validate_answers
from docloom.plans.session import table
from docloom.sources.files import pdf_pages, read_files, stream_files, write_json, write_markdown

__all__ = ["Calls", "ConvertOptions", "Extractor", "ProviderConfig", "convert", "extract", "extract_by_page", "register_views", "extract_invoices", "extract_receipts", "extract_tables", "file_info", "from_json", "is_supported", "nested_records", "pdf_pages", "providers", "read_files", "register_converter", "schemas", "stream_files", "subtype_table", "supported_types", "to_markdown", "validate_answers", "write_json", "write_markdown"]

providers = {p: {"models": m, "default": DEFAULT_MODELS[p]} for p, m in MODEL_LISTS.items()}


def to_markdown(df: DataFrame, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """(path, markdown) only."""
    return convert(df, options).select("path", "markdown")


def is_supported(df: DataFrame) -> DataFrame:
    return file_info(df).select("path", F.coalesce("supported", F.lit(False)).alias("supported"))


def register_views(spark: SparkSession, folder: str) -> list[str]:
    """Every table ``folder/name.parquet`` as a temporary view, for ``spark.sql``; the names."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(n[: -len(".parquet")] for f in files if (n := f.getPath().getName()).endswith(".parquet"))
    for n in names:
        table(spark, folder, n).createOrReplaceTempView(n)
    return names
