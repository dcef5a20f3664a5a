"""Whole conversions and extractions over collections.

``convert``: files -> Markdown. The format gate is native and runs before any
Python; each file stays one row, failures carry an error struct.

``extract``: page images -> validated answers. All pages of a document go into
one model call, so pages meet in one shuffle by document; the model is a
plug-in (``Extractor``). Pages may be references (paths) that the task loads, so
that no row holds a document's images. ``extract_by_page`` calls the model for
each page instead, so only answers meet. Calls time out and are repeated with
growing delays where the failure is a passing one.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import detect, errors, validate
from docloom.functions.arrow import map_columns
from docloom.functions.textrules import html_title
from docloom.operators import htmlmd, schemas
from docloom.sources.docx import docx_to_html


@dataclass(frozen=True)
class ConvertOptions:
    """One set of options for all stages; unknown ones are kept in ``extra``."""

    preserve_tables: bool = True
    convert_math: bool = True
    heading_style: str = "atx"
    style_map: dict = field(default_factory=dict)
    compat: str = "default"
    failed_title: str = "Conversion failed"
    extra: dict = field(default_factory=dict)


_CONVERTERS: list[tuple[str, Callable, Callable[[DataFrame], DataFrame]]] = []


def register_converter(name: str, accepts: Callable, to_html: Callable[[DataFrame], DataFrame]) -> None:
    """``accepts(content, mimetype, extension) -> Column``; ``to_html`` maps
    (path, content) to (path, html, error). Later ones are asked first."""
    _CONVERTERS.insert(0, (name, accepts, to_html))


def convert(df: DataFrame, options: ConvertOptions = ConvertOptions()) -> DataFrame:
    """path, content[, mimetype] -> path, title, markdown, error."""
    mime = F.col("mimetype") if "mimetype" in df.columns else F.lit(None).cast("string")
    info = detect.enhance_info(F.col("content"), mime, detect.extension_of(F.col("path")), F.col("path"))
    x = df.select("path", "content", info.alias("i"))
    i = F.col("i")
    own = F.lit(None).cast("string")
    for name, accepts, _ in reversed(_CONVERTERS):
        own = F.when(F.coalesce(accepts(F.col("content"), i["mimetype"], i["extension"]), F.lit(False)), name).otherwise(own)
    kind = F.coalesce(own, detect.converter_of(F.col("content"), i["mimetype"], i["extension"]), F.lit("none"))
    x = x.withColumn("kind", kind).withColumn("filename", i["filename"])
    o = htmlmd.Options(options.preserve_tables, options.heading_style, options.compat)
    parts = []

    def finish(h: DataFrame) -> DataFrame:
        """(path, filename, html, error) -> the common columns."""
        md = htmlmd.html_to_markdown(h.select(F.struct("path", "filename", "html", "error").alias("k"), "html"), "k", "html", o)
        e = F.coalesce(F.col("k.error"), F.col("error"))
        return md.select(F.col("k.path").alias("path"), html_title(F.col("k.html"), F.col("k.filename")).alias("title"), F.col("markdown"), e.alias("e"), F.when(F.col("k.error").isNotNull(), "docx-to-html").when(F.col("error").isNotNull(), "html-to-markdown").alias("phase"))

    for name, _, to_html in _CONVERTERS:
        parts.append(finish(to_html(x.where(F.col("kind") == name).select("path", "content")).select("path", detect.filename_of(F.col("path")).alias("filename"), "html", "error")))
    docx = docx_to_html(x.where("kind = 'docx'"), "path", "content", options.style_map, options.convert_math)
    parts.append(finish(docx.select("path", detect.filename_of(F.col("path")).alias("filename"), "html", "error")))
    decoded = F.decode("content", "UTF-8")
    parts.append(finish(x.where("kind = 'html'").select("path", "filename", decoded.alias("html"), F.lit(None).cast("string").alias("error"))))
    null = F.lit(None).cast("string")
    parts.append(x.where("kind = 'text'").select("path", F.regexp_replace("filename", r"\.[^.]*$", "").alias("title"), decoded.alias("markdown"), null.alias("e"), null.alias("phase")))
    parts.append(x.where("kind = 'none'").select("path", F.lit(options.failed_title).alias("title"), F.lit("").alias("markdown"), F.lit("unsupported format").alias("e"), F.lit("gate").alias("phase")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    code = F.when(F.col("phase") == "gate", "UNSUPPORTED_FORMAT").when(F.col("e").isNotNull(), F.when(errors.error_code(F.col("e")) != "UNKNOWN_ERROR", errors.error_code(F.col("e"))).otherwise(errors.phase_code(F.col("phase"))))
    failed = F.col("e").isNotNull()
    return out.select("path", F.when(failed, F.lit(options.failed_title)).otherwise(F.col("title")).alias("title"), F.when(failed, F.lit("")).otherwise(F.col("markdown")).alias("markdown"), errors.error_struct(code, F.col("phase"), F.col("e")).alias("error"))


_LOG = logging.getLogger("docloom.extract")


@dataclass(frozen=True)
class Calls:
    """How a model is called: seconds a call may take, repetitions, and delays of
    ``base`` seconds times ``factor`` to the power of the attempt, at most ``most``."""

    timeout: float = 120.0
    retries: int = 2
    base: float = 1.0
    factor: float = 2.0
    most: float = 60.0

    def run(self, f: Callable[[], str]) -> tuple[str | None, str | None, int]:
        """(answer, failure, attempts). A call that hangs is left behind in its thread."""
        failure: str | None = None
        for k in range(1 + (self.retries or 2)):
            got: list = []

            def call() -> None:
                try:
                    got.append((f(), None))
                except Exception as e:  # noqa: BLE001 - the row keeps its place
                    got.append((None, e))

            t = threading.Thread(target=call, daemon=True)
            t.start()
            t.join(self.timeout)
            answer, error = got[0] if got else (None, TimeoutError(f"timeout after {self.timeout:g} s"))
            if error is None:
                return answer, None, k + 1
            failure = f"{type(error).__name__}: {error}"
            _LOG.warning("attempt %d failed: %s", k + 1, failure)
            if not errors.passing(error) or k == (self.retries or 2):
                break
            time.sleep(min(self.most, self.base * self.factor**k))
        return None, failure, k + 1


class Extractor(Protocol):
    """A model behind the engine. It is pickled to the executors; secrets stay in its own configuration."""

    def generate(self, images: list[bytes], prompt: str, model: str) -> str: ...


@dataclass(frozen=True)
class ProviderConfig:
    """Resolved before a job starts: object, then environment, then default."""

    provider: str = "scaleway"
    model: str | None = None
    api_key: str | None = None
    base_url: str | None = None

    def resolve(self, env: dict[str, str]) -> ProviderConfig:
        if self.provider not in validate.PROVIDERS:
            raise ValueError(f"unknown provider {self.provider}")
        up = self.provider.upper()
        key = self.api_key or env.get(f"{up}_API_KEY")
        url = self.base_url or env.get(f"{up}_BASE_URL")
        if self.provider in ("scaleway", "mistral") and not key:
            raise ValueError(f"{self.provider} needs an API key")
        if self.provider == "custom" and not url:
            raise ValueError("custom needs a base URL")
        return ProviderConfig(self.provider, self.model or env.get(f"{up}_MODEL") or validate.DEFAULT_MODELS[self.provider], key, url)


def _prompt(document_type: str | None, tables_only: bool) -> str:
    """The same system text for every provider, then the task."""
    return validate.PROMPTS["system"] + "\n\n" + validate.PROMPTS["tables" if tables_only else "invoice" if document_type == "invoice" else "generic"]


def extract(pages: DataFrame, extractor: Extractor, schema: schemas.Type | None = None, document_type: str | None = None, tables_only: bool = False, model: str = "", mode: str = "PERMISSIVE", retries: int = 2, doc_col: str = "doc_id", calls: Calls | None = None, load: Callable[[str], bytes] | None = None) -> DataFrame:
    """(doc, page_no, image) -> doc, page_count, schema_used, model, success, data, errors, attempts, elapsed_ms.

    ``retries`` of 0 means 2. A failing call leaves its row with an error. With
    ``load`` the pages are (doc, page_no, path), and a document's images are only
    read by the task that calls the model.
    """
    name = "custom" if schema else "tables_only" if tables_only else {"invoice": "invoice", "receipt": "receipt", "tables": "tables"}.get((document_type or "").lower(), "comprehensive_invoice")
    prompt = _prompt(document_type, tables_only)
    how = calls or Calls(retries=retries)
    column = "path" if load else "image"
    read = load or (lambda x: x)

    def fn(ids, images):
        out = {doc_col: ids, "page_count": [len(x) for x in images], "answer": [], "failure": [], "attempts": [], "elapsed_ms": []}
        for pics in images:
            start = time.monotonic()
            answer, failure, k = how.run(lambda: extractor.generate([read(p[column]) for p in pics], prompt, model))  # noqa: B023
            for n, v in zip(("answer", "failure", "attempts", "elapsed_ms"), (answer, failure, k, (time.monotonic() - start) * 1000)):
                out[n].append(v)
        return out

    kind = pages.schema[doc_col].dataType.simpleString()
    by_doc = pages.groupBy(doc_col).agg(F.sort_array(F.collect_list(F.struct("page_no", column))).alias("pages"))  # the pages of one document
    got = map_columns(by_doc, fn, f"{doc_col} {kind}, page_count int, answer string, failure string, attempts int, elapsed_ms double")
    got = got.withColumn("schema_name", F.lit(name))
    checked = schemas.validate_answers(got.select(F.struct(doc_col, "page_count", "failure", "attempts", "elapsed_ms").alias("k"), "schema_name", "answer"), schema, mode, "k", "schema_name", "answer")
    failed = F.col("k.failure").isNotNull()
    errs = F.when(failed, F.array(F.struct(F.lit("").alias("path"), F.col("k.failure").alias("message")))).otherwise(F.col("errors"))
    return checked.select(f"k.{doc_col}", F.when(F.col("success"), F.col("k.page_count")).otherwise(0).alias("page_count"), F.when(F.col("success"), F.lit(name)).otherwise("unknown").alias("schema_used"), F.when(F.col("success"), F.lit(model)).otherwise("unknown").alias("model"), "success", "data", errs.alias("errors"), "k.attempts", "k.elapsed_ms")


def extract_by_page(pages: DataFrame, extractor: Extractor, schema: schemas.Type | None = None, document_type: str | None = None, tables_only: bool = False, model: str = "", doc_col: str = "doc_id", calls: Calls | None = None, load: Callable[[str], bytes] | None = None) -> DataFrame:
    """(doc, page_no, image or path) -> doc, page_count, n_failed, results: a call for each page.

    ``results`` holds each page's number, validity, answer and errors in order of the pages.
    """
    key = F.struct(F.col(doc_col).alias("doc"), F.col("page_no").alias("page"))
    one = pages.select(key.alias("k"), F.lit(1).alias("page_no"), "path" if load else "image")
    got = extract_of_keys(one, extractor, schema, document_type, tables_only, model, calls, load)
    row = F.struct(F.col("k.page").alias("page"), F.col("success").alias("valid"), "data", "errors")
    by_doc = got.groupBy(F.col("k.doc").alias(doc_col)).agg(F.sort_array(F.collect_list(row)).alias("results"))
    return by_doc.select(doc_col, F.size("results").alias("page_count"), F.size(F.filter("results", lambda x: ~x["valid"])).alias("n_failed"), "results")


def extract_of_keys(one: DataFrame, extractor: Extractor, schema: schemas.Type | None, document_type: str | None, tables_only: bool, model: str, calls: Calls | None, load: Callable[[str], bytes] | None) -> DataFrame:
    """``extract`` of rows that are a document each: no shuffle."""
    name = "custom" if schema else "tables_only" if tables_only else {"invoice": "invoice", "receipt": "receipt", "tables": "tables"}.get((document_type or "").lower(), "comprehensive_invoice")
    prompt = _prompt(document_type, tables_only)
    how, read = calls or Calls(), load or (lambda x: x)

    def fn(keys, images):
        got = [how.run(lambda: extractor.generate([read(p)], prompt, model)) for p in images]  # noqa: B023
        return {"k": keys, "answer": [g[0] for g in got], "failure": [g[1] for g in got]}

    kind = one.schema["k"].dataType.simpleString()
    got = map_columns(one.select("k", "path" if load else "image"), fn, f"k {kind}, answer string, failure string").withColumn("schema_name", F.lit(name))
    checked = schemas.validate_answers(got.select(F.struct("k", "failure").alias("x"), "schema_name", "answer"), schema, "PERMISSIVE", "x", "schema_name", "answer")
    errs = F.when(F.col("x.failure").isNotNull(), F.array(F.struct(F.lit("").alias("path"), F.col("x.failure").alias("message")))).otherwise(F.col("errors"))
    return checked.select(F.col("x.k").alias("k"), "success", "data", errs.alias("errors"))


def extract_invoices(pages: DataFrame, extractor: Extractor, **kw) -> DataFrame:
    return extract(pages, extractor, document_type="invoice", **kw)


def extract_receipts(pages: DataFrame, extractor: Extractor, **kw) -> DataFrame:
    return extract(pages, extractor, document_type="receipt", **kw)


def extract_tables(pages: DataFrame, extractor: Extractor, **kw) -> DataFrame:
    return extract(pages, extractor, tables_only=True, **kw)
