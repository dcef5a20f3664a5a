"""Request and answer validation as native columns; bad rows stay, with errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: providers, document types, ranges, default models, prices
PROVIDERS = ["scaleway", "ollama", "mistral", "custom"]
DOC_TYPES = ["invoice", "receipt", "tables", "basic", "simple"]
DEFAULT_MODELS = {"scaleway": "mistral-small-3.1-24b-instruct-2503", "ollama": "llava:13b", "mistral": "pixtral-12b-latest", "custom": ""}
MODEL_LISTS = {
    "scaleway": ["mistral-small-3.1-24b-instruct-2503"],
    "ollama": ["llava:latest", "llava:13b", "llava:34b"],
    "mistral": ["pixtral-12b-latest", "pixtral-large-latest", "mistral-medium-latest", "mistral-small-latest"],
    "custom": [],
}
MODEL_CAPS = [("gpt-4o", 4096, 0.01275, 10, 2048), ("gpt-4o-mini", 16384, 0.003825, 10, 1024), ("llava:34b", 4096, 0.0, 5, 1024), ("llava-phi3:latest", 2048, 0.0, 3, 768), ("minicpm-v:latest", 8192, 0.0, 8, 1344)]
_EMAIL = r"^[A-Za-z0-9_+-]+(\.[A-Za-z0-9_+-]+)*@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$"
PROMPTS = {
    "tables": "Return every table of the document: headers, all rows, numbers as numbers, null for empty cells.",
    "invoice": "Return the invoice: numbers and dates, seller and buyer, lines, totals, taxes and payment; null for what is not there.",
    "system": "You read scanned business documents and fill the given schema exactly. Numbers are numbers, what is missing or unclear is null, nothing is guessed. Answer with one valid JSON value and no other text.",
    "generic": "Return everything visible in the document by the given schema; null for what is unclear.",
}


def to_int(text: Column) -> Column:
    """The leading whole number of a form field; empty is absent, other text is null."""
    return F.nullif(F.regexp_extract(text, r"^[ \t\r\n]*([+-]?[0-9]+)", 1), F.lit("")).try_cast("int")


def request_defaults(provider: Column, model: Column, query: Column, crop: Column, tables_only: Column, doc_type: Column, contrast: Column, quality: Column, debug: Column) -> Column:
    """A request's form fields, typed, absent ones with their defaults. Switches are on by the text
    ``true``, contrast is off only by ``false``; numbers that are none stay null and are errors."""
    flag = lambda c: F.coalesce(c == "true", F.lit(False))
    given = F.nullif(quality, F.lit(""))
    return F.struct(
        F.coalesce(provider, F.lit("scaleway")).alias("provider"),
        model.alias("model"),
        F.coalesce(query, F.lit("*")).alias("query"),
        to_int(crop).alias("cropSize"),
        flag(tables_only).alias("tablesOnly"),
        doc_type.alias("documentType"),
        F.coalesce(contrast != "false", F.lit(True)).alias("enhanceContrast"),
        F.when(given.isNull(), 95).otherwise(to_int(given)).alias("targetQuality"),
        flag(debug).alias("debug"),
    )


def request_errors(provider: Column, crop: Column, doc_type: Column, quality: Column) -> Column:
    """What is wrong with a request given as form text, as an array of messages."""
    c, q = to_int(crop), to_int(quality)
    given = lambda x: F.coalesce(x != "", F.lit(False))
    bad = lambda cond, text: F.when(F.coalesce(cond, F.lit(True)), F.lit(text))
    return F.array_compact(
        F.array(
            F.when(provider.isNotNull() & ~provider.isin(PROVIDERS), F.lit("provider")),
            F.when(given(crop), bad(~c.between(10, 100), "cropSize")),
            F.when(doc_type.isNotNull() & ~doc_type.isin(DOC_TYPES), F.lit("documentType")),
            F.when(given(quality), bad(~q.between(70, 100), "targetQuality")),
        )
    )


def schema_for(doc_type: Column) -> Column:
    t = F.lower(doc_type)
    return F.when(t == "receipt", "receipt").when(t == "tables", "tables").otherwise("comprehensive")


def schema_name(custom: Column, tables_only: Column, doc_type: Column, query: Column, query_is_json: Column) -> Column:
    """Which schema a request gets, by priority."""
    has = lambda c: F.nullif(c, F.lit("")).isNotNull()
    return (
        F.when(F.coalesce(custom, F.lit(False)), "custom")
        .when(F.coalesce(tables_only, F.lit(False)), "tables-only")
        .when(has(doc_type), doc_type)
        .when(has(query) & (query != "*") & F.coalesce(query_is_json, F.lit(False)), "custom-json")
        .otherwise("comprehensive")
    )


def strict_query_error(query: Column, query_is_json: Column) -> Column:
    q = F.coalesce(query, F.lit("*"))
    return F.when((q != "*") & ~F.coalesce(query_is_json, F.lit(False)), F.lit("query is neither * nor JSON"))


def prompt_for(tables_only: Column, doc_type: Column) -> Column:
    return F.when(F.coalesce(tables_only, F.lit(False)), PROMPTS["tables"]).when(doc_type == "invoice", PROMPTS["invoice"]).otherwise(PROMPTS["generic"])


def resolve_model(provider: Column, option: Column, config: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in DEFAULT_MODELS.items() for x in kv])
    own = [F.nullif(config, F.lit(""))] if config is not None else []
    return F.coalesce(F.nullif(option, F.lit("")), *own, F.try_element_at(pairs, provider))


def image_uri(image: Column) -> Column:
    return F.concat(F.lit("data:image/jpeg;base64,"), F.base64(image))


def is_email(c: Column) -> Column:
    return c.rlike(_EMAIL)


def is_vat_number(c: Column) -> Column:
    return c.rlike(r"^[A-Z]{2}[A-Z0-9]+$")


def is_currency(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9.,]", "").rlike(r"^[0-9.,]+$")


def receipt_errors(merchant: Column, total: Column, items: Column) -> Column:
    """Facts a receipt must show; ``items``: array<struct<price, quantity, total>>."""
    off = F.abs(F.aggregate(items, F.lit(0.0), lambda a, x: a + F.coalesce(x["total"], F.lit(0.0))) - total)
    pos = lambda c: F.coalesce(c > 0, F.lit(False))
    n = F.coalesce(F.size(items), F.lit(0))
    return F.array_compact(
        F.array(
            F.when(F.nullif(F.trim(merchant), F.lit("")).isNull(), F.lit("merchant_name")),
            F.when(~pos(total), F.lit("total_amount")),
            F.when(n < 1, F.lit("items")),
            F.when((n > 0) & ~F.forall(items, lambda x: pos(x["price"]) & pos(x["quantity"]) & pos(x["total"])), F.lit("item values")),
            F.when(F.round(off, 6) > 0.01, F.lit("sum of items")),
        )
    )


def completeness(*fields: Column) -> Column:
    """struct(found, empty): how many fields hold a value."""
    found = sum((f.isNotNull().cast("int") for f in fields), F.lit(0))
    return F.struct(found.alias("found"), (F.lit(len(fields)) - found).alias("empty"))


def chunk(arr: Column, n: int) -> Column:
    """An array cut into arrays of n."""
    return F.when(F.size(arr) > 0, F.transform(F.sequence(F.lit(1), F.size(arr), F.lit(n)), lambda i: F.slice(arr, i, n))).otherwise(F.array())
