"""Queries of the core operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.functions import detect, errors, imageplan, mathxml, textrules, validate
from docloom.operators import htmlmd, metrics, nested, schemas
from docloom.plans.session import table
from docloom.streaming.convert import run_counts

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def put(f: Q) -> Q:
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


def _once(s: SparkSession, d: str, name: str, key: str, *cols: str) -> DataFrame:
    """A table's columns with every key once."""
    return table(s, d, name).select(key, *cols).dropDuplicates([key])


def _map(pairs: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in pairs.items()) + "}"


_FIRST_EXT: dict[str, str] = {}
for _e, _m in detect.MIME.items():
    _FIRST_EXT.setdefault(_m, _e)
_MIME_SQL, _EXT_SQL = _map(detect.MIME), _map(_FIRST_EXT)
_WS = r"[ \t\r\n]"
_C = "(SELECT DISTINCT ON (conv_id) * FROM conversions)"
_R = "(SELECT DISTINCT ON (run_id) * FROM extract_runs)"
_X = "(SELECT DISTINCT ON (run_id) * FROM extract_results)"

# nested records


def _records(s: SparkSession, d: str) -> DataFrame:
    return nested.nested_records(table(s, d, "extract_results"))


QUERIES |= {
    "p3_found": lambda s, d: _records(s, d).select("run_id", "parent_path", "child_path"),
    "p3_line_items": lambda s, d: nested.subtype_table(_records(s, d), "line_item").drop("other"),
    **{f"p3_{t}s": lambda s, d, t=t: nested.subtype_table(_records(s, d), t) for t in nested.COLUMNS if t != "line_item"},
    "p3_shapes": lambda s, d: nested.shape_counts(_records(s, d)),
}


@query(
    "p3_metadata",
    f"""SELECT run_id, metadata.page_count AS page_count, metadata.processing_time AS processing_time,
               lower(trim(metadata.provider)) AS provider, lower(trim(metadata.model)) AS model, metadata.schema_used AS schema_used,
               metadata.optimization_metrics.original_size_mb AS original_size_mb, metadata.optimization_metrics.optimized_size_mb AS optimized_size_mb,
               metadata.optimization_metrics.compression_ratio AS compression_ratio
        FROM {_X}""",
)
def p3_metadata(s, d):
    return nested.metadata_table(table(s, d, "extract_results"))


@query(
    "p3_validation_errors",
    f"""SELECT run_id, CAST(i AS INTEGER) AS position, e[i + 1].path AS path, e[i + 1].message AS message
        FROM (SELECT run_id, validation.errors AS e, unnest(range(len(validation.errors))) AS i FROM {_X} WHERE validation.errors IS NOT NULL)""",
)
def p3_validation_errors(s, d):
    return nested.validation_errors(table(s, d, "extract_results"))


# detection


@query("stream_info", rf"""SELECT conv_id, list_last(string_split(source_path, '/')) AS filename, nullif(regexp_extract(list_last(string_split(source_path, '/')), '\.[^.]*$'), '') AS extension, mimetype FROM {_C}""")
def stream_info(s, d):
    i = detect.stream_info(F.col("source_path"), F.col("mimetype"))
    return _once(s, d, "conversions", "conv_id", "source_path", "mimetype").select("conv_id", i["filename"].alias("filename"), i["extension"].alias("extension"), i["mimetype"].alias("mimetype"))


@query("mime_lookup", f"SELECT conv_id, ({_MIME_SQL})[lower(extension)] AS mime FROM {_C}")
def mime_lookup(s, d):
    return _once(s, d, "conversions", "conv_id", "extension").select("conv_id", detect.mime_of(F.col("extension")).alias("mime"))


@query("ext_lookup", f"SELECT conv_id, ({_EXT_SQL})[mimetype] AS ext FROM {_C}")
def ext_lookup(s, d):
    return _once(s, d, "conversions", "conv_id", "mimetype").select("conv_id", detect.ext_of(F.col("mimetype")).alias("ext"))


_HEADS = ["504B0304", "504B0708", "25504446", "D0CF11E0A1B11AE1", "7B5C727466", "FFD8FF", "89504E470D0A1A0A", "47494638", "424D", "00", "504B0304776F72642F20646F63756D656E742E786D6C", "504B0304786C2F776F726B626F6F6B2E786D6C", "504B03047070742F70726573656E746174696F6E2E786D6C", "504B"]
_SIG_SQL = "CASE " + " ".join(f"WHEN starts_with(h, '{g}') THEN '{m}'" for g, m, _ in detect.SIGNATURES) + " END"
_OFFICE_SQL = "CASE " + " ".join(f"WHEN z AND contains(t, '{a}') AND contains(t, '{b}') THEN '{detect.MIME[e]}'" for a, b, e in detect.OFFICE) + f" ELSE {_SIG_SQL} END"


@query(
    "magic_detect",
    f"""WITH c AS (SELECT conv_id, ({_HEADS!r})[conv_id % {len(_HEADS)} + 1] || hex(coalesce(left(title, 300), '')) AS h, coalesce(left(title, 300), '') AS tt FROM {_C}),
         t AS (SELECT conv_id, h, starts_with(h, '504B0304') OR starts_with(h, '504B0708') AS z, decode(unhex(({_HEADS!r})[conv_id % {len(_HEADS)} + 1])) || tt AS t FROM c WHERE conv_id % {len(_HEADS)} NOT IN (3, 5, 6)
               UNION ALL SELECT conv_id, h, false, '' FROM c WHERE conv_id % {len(_HEADS)} IN (3, 5, 6))
         SELECT conv_id, {_OFFICE_SQL} AS mime FROM t""",
)
def magic_detect(s, d):
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), (F.col("conv_id") % len(_HEADS) + 1).cast("int"))
    content = F.concat(F.unhex(head), F.encode(F.coalesce(F.substring("title", 1, 300), F.lit("")), "UTF-8"))
    return _once(s, d, "conversions", "conv_id", "title").select("conv_id", detect.detect_type(content)["mimetype"].alias("mime"))


@query(
    "enhanced_info",
    rf"""WITH c AS (SELECT conv_id, nullif(mimetype, '') AS m, nullif(extension, '') AS e FROM {_C}),
         x AS (SELECT conv_id, coalesce(m, ({_MIME_SQL})[lower(e)]) AS mime, e FROM c)
         SELECT conv_id, mime, coalesce(e, ({_EXT_SQL})[mime]) AS ext,
                coalesce(mime IN ({", ".join(repr(x) for x in detect.SUPPORTED_MIME)}), false) OR coalesce(lower(coalesce(e, ({_EXT_SQL})[mime])) IN ({", ".join(repr(x) for x in detect.SUPPORTED_EXT)}), false) AS supported
         FROM x""",
)
def enhanced_info(s, d):
    none = F.lit(None).cast("binary")
    i = detect.enhance_info(none, F.col("mimetype"), F.col("extension"), F.col("source_path"))
    x = _once(s, d, "conversions", "conv_id", "mimetype", "extension", "source_path").select("conv_id", i["mimetype"].alias("mime"), i["extension"].alias("ext"))
    return x.withColumn("supported", detect.recognised(F.col("mime"), F.col("ext")))


@query("pdf_upload", f"SELECT conv_id, CASE WHEN NOT (coalesce(contains(mimetype, 'pdf'), false) OR coalesce(ends_with(lower(filename), '.pdf'), false)) THEN 'not a PDF' WHEN size_bytes * 1000 > 52428800 THEN 'larger than 50 MiB' END AS error FROM {_C}")
def pdf_upload(s, d):
    return _once(s, d, "conversions", "conv_id", "filename", "mimetype", "size_bytes").select("conv_id", detect.valid_pdf_upload(F.col("filename"), F.col("mimetype"), F.col("size_bytes") * 1000).alias("error"))


@query(
    "supported_types",
    """SELECT * FROM (VALUES ('converter', 'DocxConverter'), ('extension', '.docx'), ('mimetype', 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'), ('feature', 'Tables'),
         ('feature', 'Math equations (OMML to LaTeX)'), ('feature', 'Headings and formatting'), ('feature', 'Images with alt text'), ('feature', 'Lists and structural elements'), ('feature', 'Custom style mapping'), ('feature', 'Batch processing')) t(kind, value)""",
)
def supported_types(s, d):
    return detect.supported_types(s)


# HTML and Markdown rules

_HTML = "concat('<html><h1 class=x>', coalesce(title, ''), '</h1><script>var a = \"<p>\";</script>', chr(10), chr(10), ' ', chr(10), '<w:p val=1>', markdown, '</w:p><STYLE>', source_path, '</STYLE></html>')"


def _html(s: SparkSession, d: str) -> DataFrame:
    return _once(s, d, "conversions", "conv_id", "title", "markdown", "source_path", "filename").select("*", F.expr(_HTML.replace('\\"', '"')).alias("html"))


_HTML_CLEAN = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), '\n{_WS}*\n{_WS}*\n', chr(10) || chr(10), 'g'), '<w:[^>]*>', '', 'g'), '</w:[^>]*>', '', 'g')"


@query("html_preprocess", f"SELECT conv_id, md5({_HTML_CLEAN}) AS digest, length({_HTML_CLEAN}) AS n FROM (SELECT conv_id, {_HTML} AS html FROM {_C} WHERE markdown IS NOT NULL)")
def html_preprocess(s, d):
    h = textrules.html_preprocess(F.col("html"))
    return _html(s, d).where("markdown is not null").select("conv_id", h.alias("h")).select("conv_id", F.md5("h").alias("digest"), F.char_length("h").alias("n"))


@query(
    "html_title",
    rf"""WITH h AS (SELECT conv_id, filename, CASE WHEN conv_id % 3 = 0 THEN NULL ELSE concat('<H1 id="a">', ' <b>', title, '</b> ', '</h1>') END AS html FROM {_C})
         SELECT conv_id, CASE WHEN coalesce(regexp_matches(html, '(?i)<h1[^>]*>([^\n\r]*?)</h1>'), false)
                THEN regexp_replace(regexp_replace(regexp_extract(html, '(?i)<h1[^>]*>([^\n\r]*?)</h1>', 1), '<[^>]*>', '', 'g'), '^{_WS}+|{_WS}+$', '', 'g')
                ELSE regexp_replace(filename, '(?i)\.docx?$', '') END AS title FROM h""",
)
def html_title(s, d):
    html = F.when(F.col("conv_id") % 3 != 0, F.concat(F.lit('<H1 id="a"> <b>'), F.coalesce("title", F.lit("")), F.lit("</b> </h1>")))
    return _html(s, d).select("conv_id", textrules.html_title(html, F.col("filename")).alias("title"))


_MD = "concat(chr(10), '# ', coalesce(title, 'x'), chr(10), 'text', repeat(chr(10), 5), '| a |  |  | b |   ', chr(10), markdown, '  ', chr(13), chr(10), 'end ', chr(10))"


def _md_sql(literal: bool) -> str:
    a = r"regexp_replace(replace(md, chr(13) || chr(10), chr(10)), '\n{4,}', repeat(chr(10), 3), 'g')"
    if literal:
        a = rf"regexp_replace(regexp_replace({a}, '\n(#{{1,6}} [^\n\r]+)\n', chr(10) || '\1' || chr(10) || chr(10), 'g'), '\|{_WS}*\|{_WS}*\|', '| |', 'g')"
    else:
        # a heading directly followed by text gets its blank line
        a = rf"regexp_replace({a}, '(?m)^(#{{1,6}} [^\n\r]+)\n([^\n])', '\1' || chr(10) || chr(10) || '\2', 'g')"
    lines = rf"array_to_string(list_transform(string_split({a}, chr(10)), lambda s: CASE WHEN ends_with(s, '  ') THEN s ELSE regexp_replace(s, '[ \t\r]+$', '') END), chr(10))"
    return rf"regexp_replace({lines}, '{_WS}+$', '') || chr(10)"


for _mode in ("default", "literal"):

    @query(f"md_postprocess_{_mode}", f"SELECT conv_id, md5({_md_sql(_mode == 'literal')}) AS digest FROM (SELECT conv_id, {_MD} AS md FROM {_C} WHERE markdown IS NOT NULL)")
    def md_postprocess(s, d, mode=_mode):
        c = _once(s, d, "conversions", "conv_id", "title", "markdown").where("markdown is not null").select("conv_id", F.expr(_MD).alias("md"))
        return c.select("conv_id", F.md5(textrules.md_postprocess(F.col("md"), mode)).alias("digest"))


@query("table_cell_escape", rf"SELECT conv_id, ' ' || replace(replace(regexp_replace(t, '^{_WS}+|{_WS}+$', '', 'g'), '|', '\|'), chr(10), ' ') || ' |' AS cell FROM (SELECT conv_id, concat(' ', title, chr(10), '| a|b ', filename, ' ') AS t FROM {_C})")
def table_cell_escape(s, d):
    t = F.concat(F.lit(" "), F.coalesce("title", F.lit("")), F.lit("\n| a|b "), F.coalesce("filename", F.lit("")), F.lit(" "))
    return _once(s, d, "conversions", "conv_id", "title", "filename").select("conv_id", textrules.cell_escape(t).alias("cell"))


_HEAD_SQL = rf"(regexp_matches(line, '\*\*[^\n]*\*\*') OR regexp_matches(line, '(?i)(^|[^0-9A-Za-z_])({textrules.HEADER_WORDS})([^0-9A-Za-z_]|$)'))"


@query("header_row_flag", f"SELECT conv_id, count(*) AS n_rows, count(*) FILTER (WHERE {_HEAD_SQL}) AS n_headers FROM (SELECT conv_id, unnest(string_split(markdown, chr(10))) AS line FROM {_C}) WHERE starts_with(line, '|') GROUP BY 1")
def header_row_flag(s, d):
    rows = _once(s, d, "conversions", "conv_id", "markdown").select("conv_id", F.explode(F.split("markdown", "\n")).alias("line")).where(F.col("line").startswith("|"))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n_rows"), F.count_if(textrules.looks_like_header(F.col("line"))).alias("n_headers"))


@query(
    "link_render",
    rf"""WITH l AS (SELECT conv_id, coalesce(title, 'x') AS t, (['javascript:a()', 'a b/c', 'vbscript:x', NULL, '', coalesce(title, 'x'), 'https://a.invalid/' || conv_id])[conv_id % 7 + 1] AS h, (['', 'say "hi"', NULL])[conv_id % 3 + 1] AS ti FROM {_C})
         SELECT conv_id, CASE WHEN coalesce(h, '') = '' OR starts_with(h, 'javascript:') OR starts_with(h, 'vbscript:') THEN t
             WHEN t = h AND coalesce(ti, '') = '' THEN '<' || replace(h, ' ', '%20') || '>'
             ELSE '[' || t || '](' || replace(h, ' ', '%20') || CASE WHEN coalesce(ti, '') = '' THEN '' ELSE ' "' || replace(ti, '"', '\"') || '"' END || ')' END AS link FROM l""",
)
def link_render(s, d):
    t = F.coalesce("title", F.lit("x"))
    null = F.lit(None).cast("string")
    h = F.element_at(F.array(F.lit("javascript:a()"), F.lit("a b/c"), F.lit("vbscript:x"), null, F.lit(""), t, F.concat(F.lit("https://a.invalid/"), F.col("conv_id"))), (F.col("conv_id") % 7 + 1).cast("int"))
    ti = F.element_at(F.array(F.lit(""), F.lit('say "hi"'), null), (F.col("conv_id") % 3 + 1).cast("int"))
    return _once(s, d, "conversions", "conv_id", "title").select("conv_id", textrules.render_link(t, h, ti).alias("link"))


@query(
    "image_render",
    rf"""WITH l AS (SELECT conv_id, (['', NULL, title])[conv_id % 3 + 1] AS a, ([NULL, 'data:image/png;base64,' || repeat('A', 78), 'data:image/png;base64,' || repeat('A', 79), 'p/' || repeat('x', 498), 'p/' || repeat('x', 499), 'pic.png'])[conv_id % 6 + 1] AS s, (['', 'a "b"'])[conv_id % 2 + 1] AS ti FROM {_C})
         SELECT conv_id, CASE WHEN coalesce(s, '') = '' THEN '' WHEN starts_with(s, 'data:') AND length(s) > 100 THEN '![' || coalesce(nullif(a, ''), 'Image') || '](data:image/png...)'
             WHEN length(s) > 500 THEN '![' || coalesce(nullif(a, ''), 'Image') || ']'
             ELSE '![' || coalesce(a, '') || '](' || s || CASE WHEN ti = '' THEN '' ELSE ' "' || replace(ti, '"', '\"') || '"' END || ')' END AS image FROM l""",
)
def image_render(s, d):
    null = F.lit(None).cast("string")
    at = lambda *v: F.element_at(F.array(*v), (F.col("conv_id") % len(v) + 1).cast("int"))
    src = at(null, F.lit("data:image/png;base64," + "A" * 78), F.lit("data:image/png;base64," + "A" * 79), F.lit("p/" + "x" * 498), F.lit("p/" + "x" * 499), F.lit("pic.png"))
    return _once(s, d, "conversions", "conv_id", "title").select("conv_id", textrules.render_image(at(F.lit(""), null, F.col("title")), src, at(F.lit(""), F.lit('a "b"'))).alias("image"))


@query("html_to_markdown")
def html_to_markdown(s, d):
    return htmlmd.html_to_markdown(_html(s, d), "conv_id", "html")


# math

_SYMS = "".join(textrules.LATEX)


def _latex_sql(x: str) -> str:
    for k, v in textrules.LATEX.items():
        x = f"replace({x}, '{k}', '{v} ')"
    return x


@query("unicode_to_latex", f"SELECT conv_id, {_latex_sql('t')} AS latex FROM (SELECT conv_id, concat(title, '{_SYMS}'[(conv_id % {len(_SYMS)} + 1):(conv_id % {len(_SYMS)} + 3)], 'x') AS t FROM {_C})")
def unicode_to_latex(s, d):
    t = F.concat(F.coalesce("title", F.lit("")), F.substring(F.lit(_SYMS), (F.col("conv_id") % len(_SYMS) + 1).cast("int"), F.lit(3)), F.lit("x"))
    return _once(s, d, "conversions", "conv_id", "title").select("conv_id", textrules.unicode_to_latex(t).alias("latex"))


_OMML = "concat('<m:oMath><m:f><m:fPr/><m:num>', l_partkey, '</m:num><m:den>', l_suppkey, '</m:den></m:f><m:sSup><m:e>x</m:e><m:sup>', l_linenumber, '</m:sup></m:sSup><m:sSub><m:e>y</m:e><m:sub>i</m:sub></m:sSub>', CASE WHEN l_partkey % 2 = 0 THEN '<m:rad><m:deg>3</m:deg><m:e>z</m:e></m:rad>' ELSE '<m:rad><m:e>π ≤ w</m:e></m:rad>' END, '<m:r><m:t>ratio:b ', l_orderkey, '</m:t></m:r></m:oMath>')"


def _omml_want(root: str, text: str) -> str:
    """The LaTeX by hand, from the numbers of the row."""
    return rf"SELECT DISTINCT l_orderkey, concat('\frac{{', l_partkey, '}}{{', l_suppkey, '}}x^{{', l_linenumber, '}}y_{{i}}', CASE WHEN l_partkey % 2 = 0 THEN '{root}' ELSE '\sqrt{{\pi \leq w}}' END, '{text} ', l_orderkey) AS latex FROM lineitem"


for _mode, _want in (("default", _omml_want(r"\sqrt[3]{z}", "ratio:b")), ("literal", _omml_want(r"\sqrt{z}", "b"))):

    @query(f"omml_to_latex_{_mode}", _want)
    def omml_to_latex(s, d, mode=_mode):
        # equal formulas once, before they are read; the shuffle also spreads a table of one file
        x = table(s, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").distinct()
        return x.select("l_orderkey", mathxml.omml_to_latex(F.expr(_OMML), mode).alias("latex"))


_NESTED = "concat('<m:f><m:num><m:f><m:num><m:r><m:t>', o_orderkey, '</m:t></m:r></m:num><m:den><m:r><m:t>b</m:t></m:r></m:den></m:f></m:num><m:den><m:rad><m:deg><m:r><m:t>', o_orderkey % 7 + 3, '</m:t></m:r></m:deg><m:e><m:sSup><m:e><m:rad><m:radPr/><m:deg/><m:e><m:r><m:t>∑ x</m:t></m:r></m:e></m:rad></m:e><m:sup><m:f><m:num><m:r><m:t>1</m:t></m:r></m:num><m:den><m:r><m:t>2</m:t></m:r></m:den></m:f></m:sup></m:sSup></m:e></m:rad></m:den></m:f>')"


@query("omml_nested", r"SELECT o_orderkey, concat('\frac{\frac{', o_orderkey, '}{b}}{\sqrt[', o_orderkey % 7 + 3, ']{\sqrt{\sum x}^{\frac{1}{2}}}}') AS latex FROM orders")
def omml_nested(s, d):
    return table(s, d, "orders").select("o_orderkey", mathxml.omml_to_latex(F.expr(_NESTED)).alias("latex"))


@query("latex_run", f"SELECT conv_id, '<w:r><w:t>' || q || coalesce(title, '') || q || '</w:t></w:r>' AS run FROM (SELECT *, CASE WHEN conv_id % 2 = 0 THEN '$$' ELSE '$' END AS q FROM {_C})")
def latex_run(s, d):
    t = F.coalesce("title", F.lit(""))
    return _once(s, d, "conversions", "conv_id", "title").select("conv_id", F.when(F.col("conv_id") % 2 == 0, textrules.latex_run(t, True)).otherwise(textrules.latex_run(t)).alias("run"))


# schemas, requests, models

_REQ = "(SELECT run_id, (['scaleway', 'ollama', 'bogus', NULL])[run_id % 4 + 1] AS provider, (['', 'abc', '9', '10', '100', '101', ' 55x', NULL])[run_id % 8 + 1] AS crop, (['invoice', 'receipt', 'tables', 'other', NULL, ''])[run_id % 6 + 1] AS doc_type, (['69', '70', '100', '101', '', NULL, '-3'])[run_id % 7 + 1] AS quality, (['*', '{\"a\": 1}', '{bad', NULL])[(run_id // 3) % 4 + 1] AS q, run_id % 5 = 0 AS tables_only, run_id % 11 = 0 AS custom, (['', 'Pixtral-X', NULL])[run_id % 3 + 1] AS option FROM (SELECT DISTINCT run_id FROM extract_runs))"


def _requests(s: SparkSession, d: str) -> DataFrame:
    r = F.col("run_id")
    pick = lambda i, *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), (i % len(v) + 1).cast("int"))
    return table(s, d, "extract_runs").select("run_id").distinct().select(
        "run_id", pick(r, "scaleway", "ollama", "bogus", None).alias("provider"), pick(r, "", "abc", "9", "10", "100", "101", " 55x", None).alias("crop"),
        pick(r, "invoice", "receipt", "tables", "other", None, "").alias("doc_type"), pick(r, "69", "70", "100", "101", "", None, "-3").alias("quality"),
        pick(F.floor(r / 3), "*", '{"a": 1}', "{bad", None).alias("q"), (r % 5 == 0).alias("tables_only"), (r % 11 == 0).alias("custom"), pick(r, "", "Pixtral-X", None).alias("option"),
    )


def _json_flag() -> F.Column:
    return F.col("q") == '{"a": 1}'


_ROUTE = "CASE WHEN custom THEN 'custom' WHEN tables_only THEN 'tables-only' WHEN coalesce(doc_type, '') <> '' THEN doc_type WHEN coalesce(q, '') NOT IN ('', '*') AND json_valid(q) THEN 'custom-json' ELSE 'comprehensive' END"


@query("schema_route", f"SELECT run_id, {_ROUTE} AS schema_name, CASE lower(doc_type) WHEN 'receipt' THEN 'receipt' WHEN 'tables' THEN 'tables' ELSE 'comprehensive' END AS by_type, CASE WHEN tables_only THEN 'tables' WHEN doc_type = 'invoice' THEN 'invoice' ELSE 'generic' END AS prompt_kind, CASE WHEN coalesce(q, '*') <> '*' AND NOT json_valid(q) THEN 'query is neither * nor JSON' END AS strict_error FROM {_REQ}")
def schema_route(s, d):
    c = F.col
    name = validate.schema_name(c("custom"), c("tables_only"), c("doc_type"), c("q"), _json_flag())
    prompt = validate.prompt_for(c("tables_only"), c("doc_type"))
    kind = F.when(prompt == validate.PROMPTS["tables"], "tables").when(prompt == validate.PROMPTS["invoice"], "invoice").otherwise("generic")
    return _requests(s, d).select("run_id", name.alias("schema_name"), validate.schema_for(c("doc_type")).alias("by_type"), kind.alias("prompt_kind"), validate.strict_query_error(c("q"), _json_flag()).alias("strict_error"))


@query(
    "request_validate",
    rf"""WITH r AS (SELECT *, TRY_CAST(nullif(regexp_extract(crop, '^{_WS}*([+-]?[0-9]+)', 1), '') AS INTEGER) AS c, TRY_CAST(nullif(regexp_extract(quality, '^{_WS}*([+-]?[0-9]+)', 1), '') AS INTEGER) AS qq FROM {_REQ})
         SELECT run_id, coalesce(c, 0) AS crop_value, array_to_string(list_filter([
            CASE WHEN provider IS NOT NULL AND provider NOT IN ('scaleway', 'ollama', 'mistral', 'custom') THEN 'provider' END,
            CASE WHEN crop <> '' AND coalesce(NOT (c BETWEEN 10 AND 100), true) THEN 'cropSize' END,
            CASE WHEN doc_type IS NOT NULL AND doc_type NOT IN ('invoice', 'receipt', 'tables', 'basic', 'simple') THEN 'documentType' END,
            CASE WHEN quality <> '' AND coalesce(NOT (qq BETWEEN 70 AND 100), true) THEN 'targetQuality' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""",
)
def request_validate(s, d):
    e = validate.request_errors(F.col("provider"), F.col("crop"), F.col("doc_type"), F.col("quality"))
    return _requests(s, d).select("run_id", F.coalesce(validate.to_int(F.col("crop")), F.lit(0)).alias("crop_value"), F.array_join(e, ",").alias("errors"))


_LIMIT = "CASE WHEN contains(lower({m}), 'pixtral') THEN 1024 WHEN contains(lower({m}), 'mistral') THEN 1540 ELSE 2048 END"


@query("model_resolve", f"SELECT run_id, m AS model, {_LIMIT.format(m='coalesce(m, \'\')')} AS side FROM (SELECT run_id, coalesce(nullif(option, ''), ({_map(validate.DEFAULT_MODELS)})[provider]) AS m FROM {_REQ})")
def model_resolve(s, d):
    m = validate.resolve_model(F.col("provider"), F.col("option"))
    return _requests(s, d).select("run_id", m.alias("model")).withColumn("side", imageplan.resolution_limit(F.col("model")))


@query("image_uri", f"SELECT conv_id, 'data:image/jpeg;base64,' || to_base64(encode(coalesce(filename, ''))) AS uri FROM {_C}")
def image_uri(s, d):
    return _once(s, d, "conversions", "conv_id", "filename").select("conv_id", validate.image_uri(F.encode(F.coalesce("filename", F.lit("")), "UTF-8")).alias("uri"))


@query("provider_list", "SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{m}', '{validate.DEFAULT_MODELS[p]}')" for p, ms in validate.MODEL_LISTS.items() for m in ms) + ") t(provider, model, default_model)")
def provider_list(s, d):
    return s.createDataFrame([(p, m, validate.DEFAULT_MODELS[p]) for p, ms in validate.MODEL_LISTS.items() for m in ms], "provider string, model string, default_model string")


@query("json_valid", f"SELECT run_id, coalesce(json_valid(data), false) AS is_json FROM {_X}")
def json_valid(s, d):
    return schemas.json_valid(_once(s, d, "extract_results", "run_id", "data"), "run_id", "data")


_CLEAN_SQL = rf"regexp_replace(regexp_replace(regexp_replace(data, '^{_WS}+|{_WS}+$', '', 'g'), '(?s)^(.*?)```json{_WS}*', '\1'), '```{_WS}*$', '')"


@query("response_clean", rf"SELECT run_id, md5(CASE WHEN regexp_extract(t, '(?s)\{{.*\}}') <> '' THEN regexp_extract(t, '(?s)\{{.*\}}') ELSE t END) AS digest FROM (SELECT run_id, {_CLEAN_SQL} AS t FROM {_X})")
def response_clean(s, d):
    return _once(s, d, "extract_results", "run_id", "data").select("run_id", F.md5(textrules.response_clean(F.col("data"))).alias("digest"))


@query("answer_validation")
def answer_validation(s, d):
    return schemas.validate_answers(table(s, d, "extract_results"))


@query("answer_keys")
def answer_keys(s, d):
    return schemas.json_keys(_once(s, d, "extract_results", "run_id", "data"), "run_id", "data")


@query("schema_leaves")
def schema_leaves(s, d):
    return s.createDataFrame([(n, p) for n, t in (("invoice", schemas.INVOICE), ("receipt", schemas.RECEIPT), ("tables", schemas.TABLES)) for p in t.leaves()], "schema_name string, path string")


@query("table_cells")
def table_cells(s, d):
    """Cells of detected tables by (table, row, column), with their kind."""
    c = _records(s, d).where("record_type = 'table_row'").select("run_id", "parent_path", F.col("position").alias("row_no"), F.posexplode("cells").alias("col_no", "cell"))
    kind = F.when(F.col("cell").isNull(), "null").when(F.col("cell").try_cast("double").isNotNull(), "number").otherwise("string")
    return c.withColumn("kind", kind)


# assembly and consistency of documents from relational tables

_CENTS = "sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0::DOUBLE AS subtotal, sum(CAST(round(l_extendedprice * l_discount * 10000) AS BIGINT)) / 10000.0::DOUBLE AS discount_total, sum(CAST(round(l_extendedprice * (1 - l_discount) * l_tax * 1000000) AS BIGINT)) / 1000000.0::DOUBLE AS tax_total"
_L = f"SELECT l_orderkey, {_CENTS}, count(*) AS n_lines FROM lineitem GROUP BY 1"


def _line_totals(s: SparkSession, d: str) -> DataFrame:
    """Money is summed in whole units of its last decimal, so the order of the rows cannot matter."""
    l_ = table(s, d, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount", "l_tax")
    p = F.col("l_extendedprice")
    total = lambda v, unit: F.sum(F.round(v * unit).cast("bigint")) / float(unit)
    return l_.groupBy("l_orderkey").agg(
        total(p, 100).alias("subtotal"), total(p * F.col("l_discount"), 10_000).alias("discount_total"),
        total(p * (1 - F.col("l_discount")) * F.col("l_tax"), 1_000_000).alias("tax_total"), F.count("*").alias("n_lines"),
    )


@query("invoice_totals", f"SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS invoice_date, c_name AS buyer, coalesce(n_lines, 0) AS n_lines, subtotal, discount_total, tax_total FROM orders LEFT JOIN ({_L}) l ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey")
def invoice_totals(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("invoice_date"))
    c = table(s, d, "customer").select("c_custkey", F.col("c_name").alias("buyer"))
    x = o.join(_line_totals(s, d), F.col("l_orderkey") == F.col("o_orderkey"), "left").join(c, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.select("o_orderkey", "invoice_date", "buyer", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "subtotal", "discount_total", "tax_total")


_LINE_COLS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query("invoice_line_items", f"SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_COLS)}) - 1 AS INTEGER) AS position, CAST(l_partkey AS VARCHAR) AS item_number, p_name AS description, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price, l_extendedprice AS line_total FROM lineitem LEFT JOIN part ON p_partkey = l_partkey")
def invoice_line_items(s, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_COLS)
    x = table(s, d, "lineitem").withColumn("position", F.row_number().over(w) - 1)
    x = x.join(table(s, d, "part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return x.select("l_orderkey", "position", F.col("l_partkey").cast("string").alias("item_number"), F.col("p_name").alias("description"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("line_total"))


@query(
    "receipt_consistency",
    """WITH t AS (SELECT l_orderkey AS k, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, min(l_quantity) AS q FROM lineitem GROUP BY 1),
       r AS (SELECT o_orderkey AS k, coalesce(cents, 0) AS cents, cents IS NOT NULL AS has, q, CASE o_orderkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN -1 ELSE 500 END AS off, o_orderkey % 10 = 0 AS blank FROM orders LEFT JOIN t ON k = o_orderkey)
       SELECT k AS o_orderkey, array_to_string(list_filter([CASE WHEN blank THEN 'merchant_name' END, CASE WHEN cents + off <= 0 THEN 'total_amount' END, CASE WHEN NOT has THEN 'items' END,
              CASE WHEN has AND NOT (q > 0) THEN 'item values' END, CASE WHEN abs(off) > 1 THEN 'sum of items' END], lambda x: x IS NOT NULL), ',') AS errors FROM r""",
)
def receipt_consistency(s, d):
    price = F.round(F.col("l_extendedprice"), 2)
    items = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(price.alias("price"), F.col("l_quantity").alias("quantity"), price.alias("total"))).alias("items"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("cents"))  # the lines of one order
    k = F.col("o_orderkey")
    off = F.when(k % 4 == 0, 2).when(k % 4 == 1, 0).when(k % 4 == 2, -1).otherwise(500)
    x = table(s, d, "orders").select("o_orderkey").join(items, k == F.col("l_orderkey"), "left")
    total = (F.coalesce("cents", F.lit(0)) + off) / 100.0
    e = validate.receipt_errors(F.when(k % 10 == 0, F.lit(" ")).otherwise(F.lit("shop")), total, F.coalesce("items", F.array().cast("array<struct<price:double,quantity:double,total:double>>")))
    return x.select("o_orderkey", F.array_join(e, ",").alias("errors"))


_FIELDS = ["source_path", "filename", "extension", "mimetype", "title", "markdown", "size_bytes", "converted_at"]


@query("field_completeness", f"SELECT conv_id, {' + '.join(f'({c} IS NOT NULL)::INT' for c in _FIELDS)} AS found, {len(_FIELDS)} - ({' + '.join(f'({c} IS NOT NULL)::INT' for c in _FIELDS)}) AS empty FROM {_C}")
def field_completeness(s, d):
    return _once(s, d, "conversions", "conv_id", *_FIELDS).select("conv_id", validate.completeness(*[F.col(c) for c in _FIELDS]).alias("f")).select("conv_id", "f.found", "f.empty")


@query("bilingual_lines")
def bilingual_lines(s, d):
    """Line items with the French synonyms merged into the English fields."""
    i = nested.subtype_table(_records(s, d), "line_item")
    pairs = {"quantity": "quantite", "unit_price": "prix_unitaire", "line_total": "montant_ttc", "tax_rate": "taux_tva", "tax_amount": "montant_tva"}
    return i.select("run_id", "child_path", *[F.coalesce(a, b).alias(a) for a, b in pairs.items()])


# image plans

_DIM = "(SELECT DISTINCT p_partkey, CAST(p_partkey * 37 % 4200 + 60 AS INTEGER) AS w, CAST(p_partkey * 91 % 5200 + 60 AS INTEGER) AS h, CAST(p_size * 7 % 115 AS INTEGER) AS pct, CASE p_partkey % 3 WHEN 0 THEN 1024 WHEN 1 THEN 1540 ELSE 2048 END AS side FROM part)"


def _dims(s: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(s, d, "part").select("p_partkey", (k * 37 % 4200 + 60).cast("int").alias("w"), (k * 91 % 5200 + 60).cast("int").alias("h"), (F.col("p_size") * 7 % 115).alias("pct"), F.when(k % 3 == 0, 1024).when(k % 3 == 1, 1540).otherwise(2048).alias("side")).distinct()


@query(
    "crop_plan",
    f"""WITH c AS (SELECT *, CAST(floor(w * pct / 100) AS BIGINT) AS cw, CAST(floor(h * pct / 100) AS BIGINT) AS ch FROM {_DIM})
        SELECT p_partkey, cw AS width, ch AS height, CAST(floor((w - cw) / 2) AS BIGINT) AS "left", CAST(floor((h - ch) / 2) AS BIGINT) AS top, 'crop-' || pct || '%' AS tag FROM c WHERE pct > 0 AND pct < 100 AND cw > 100 AND ch > 100""",
)
def crop_plan(s, d):
    c = imageplan.crop(F.col("w"), F.col("h"), F.col("pct"))
    return _dims(s, d).select("p_partkey", c.alias("c")).where("c is not null").select("p_partkey", "c.*")


@query(
    "resize_direct",
    f"""WITH a AS (SELECT *, w::DOUBLE / h AS ar, (side * side)::DOUBLE AS area FROM {_DIM} WHERE w::BIGINT * h > side * side OR w > side OR h > side),
        b AS (SELECT *, sqrt(area * ar) AS w1, sqrt(area / ar) AS h1 FROM a),
        c AS (SELECT *, CASE WHEN w1 > side THEN side::DOUBLE ELSE w1 END AS w2, CASE WHEN w1 > side THEN side / ar ELSE h1 END AS h2 FROM b),
        e AS (SELECT p_partkey, CAST(floor(CASE WHEN h2 > side THEN side * ar ELSE w2 END + 0.5) AS INTEGER) AS width, CAST(floor(CASE WHEN h2 > side THEN side ELSE h2 END + 0.5) AS INTEGER) AS height FROM c)
        SELECT *, 'resize-' || width || 'x' || height || '-pixels' AS tag FROM e""",
)
def resize_direct(s, d):
    r = imageplan.resize_direct(F.col("w"), F.col("h"), F.col("side"))
    return _dims(s, d).select("p_partkey", r.alias("r")).where("r is not null").select("p_partkey", "r.*")


@query("resize_worker", f"SELECT p_partkey, 2048 AS width, CAST(floor(h * 2048.0::DOUBLE / w + 0.5) AS INTEGER) AS height, 'resize-2048x' || CAST(floor(h * 2048.0::DOUBLE / w + 0.5) AS INTEGER) AS tag FROM {_DIM} WHERE w > 2048")
def resize_worker(s, d):
    r = imageplan.resize_worker(F.col("w"), F.col("h"))
    return _dims(s, d).select("p_partkey", r.alias("r")).where("r is not null").select("p_partkey", "r.*")


@query("image_plan")
def image_plan(s, d):
    p = imageplan.plan_image(F.col("w"), F.col("h"), F.col("pct"), F.lit("pixtral-12b-latest"), F.lit(None).cast("boolean"), F.lit(None).cast("int"))
    return _dims(s, d).select("p_partkey", p.alias("p")).select("p_partkey", "p.*")


# aggregations

_MB = 1048576.0


@query("size_metrics", f"SELECT run_id, count(*) AS page_count, sum(original_bytes) / {_MB}::DOUBLE AS original_mb, sum(optimized_bytes) / {_MB}::DOUBLE AS optimized_mb, round(avg(optimized_bytes::DOUBLE / nullif(original_bytes, 0)), 9) AS compression_ratio FROM page_images GROUP BY 1")
def size_metrics(s, d):
    return metrics.size_metrics(table(s, d, "page_images")).withColumn("compression_ratio", F.round("compression_ratio", 9))


@query("tag_counts", "SELECT tag, count(*) AS n_pages, count(DISTINCT run_id) AS n_runs FROM (SELECT run_id, unnest(tags) AS tag FROM page_images) GROUP BY 1")
def tag_counts(s, d):
    return table(s, d, "page_images").select("run_id", F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n_pages"), F.countDistinct("run_id").alias("n_runs"))


_STATE = "coalesce(success, false) AS a, error_message IS NOT NULL AND NOT coalesce(success, false) AS p"


@query("pool_stats", f"SELECT pool, count(*) AS total, count(*) FILTER (WHERE a) AS active, count(*) FILTER (WHERE p) AS pending, count(*) FILTER (WHERE NOT a AND NOT p) AS available, count(*) FILTER (WHERE a) * 100.0::DOUBLE / count(*) AS utilisation FROM (SELECT lower(trim(provider)) AS pool, {_STATE} FROM {_R}) GROUP BY 1")
def pool_stats(s, d):
    r = _once(s, d, "extract_runs", "run_id", "provider", "success", "error_message").withColumn("provider", F.lower(F.trim("provider")))
    ok = F.coalesce("success", F.lit(False))
    return metrics.pool_stats(r, "provider", ok, F.col("error_message").isNotNull() & ~ok)


@query("batch_groups", "SELECT run_id, CAST((page_no - 1) // 4 AS BIGINT) AS batch_no, count(*) AS n, min(page_no) AS first_page, max(page_no) AS last_page FROM page_images GROUP BY 1, 2")
def batch_groups(s, d):
    b = F.floor((F.col("page_no") - 1) / 4)
    return table(s, d, "page_images").groupBy("run_id", b.alias("batch_no")).agg(F.count("*").alias("n"), F.min("page_no").alias("first_page"), F.max("page_no").alias("last_page"))


@query("array_chunks", "SELECT run_id, page_no, len(tags) AS n_tags, CASE WHEN len(tags) > 0 THEN CAST(ceil(len(tags) / 2.0) AS INTEGER) ELSE 0 END AS n_chunks, CASE WHEN len(tags) > 0 THEN array_to_string(tags[1:2], '+') END AS first_chunk FROM page_images WHERE tags IS NOT NULL")
def array_chunks(s, d):
    c = validate.chunk(F.col("tags"), 2)
    return table(s, d, "page_images").where("tags is not null").select("run_id", "page_no", F.size("tags").alias("n_tags"), F.size(c).alias("n_chunks"), F.array_join(F.get(c, 0), "+").alias("first_chunk"))


_CODE_SQL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(m), \'{w}\')' for w in ws)} THEN '{c}'" for ws, c in errors.WORDS) + " WHEN m IS NOT NULL THEN 'UNKNOWN_ERROR' END"
_MSGS = ["ENOENT: no such file", "Network timeout on fetch", "File size too large", "HTML parse error", "markdown writer", "Invalid ZIP", "EACCES: access denied", "EMFILE", "odd"]


@query(
    "error_codes",
    f"""WITH r AS (SELECT run_id, CASE WHEN run_id % 2 = 0 THEN ({_MSGS!r})[run_id % {len(_MSGS)} + 1] ELSE error_message END AS m, (['preprocessing', 'docx-to-html', 'html-to-markdown', 'unknown'])[run_id % 4 + 1] AS ph FROM {_R}),
        c AS (SELECT *, {_CODE_SQL} AS code FROM r)
        SELECT run_id, code, CASE ph WHEN 'preprocessing' THEN 'PREPROCESSING_FAILED' WHEN 'html-to-markdown' THEN 'MARKDOWN_GENERATION_FAILED' ELSE 'CONVERSION_FAILED' END AS phase_code,
               CASE WHEN contains(m, 'ENOENT') THEN 'FILE_NOT_FOUND' WHEN contains(m, 'EACCES') OR contains(m, 'EMFILE') OR contains(m, 'ENFILE') THEN 'FILE_ACCESS_DENIED' ELSE 'UNKNOWN_ERROR' END AS file_code,
               coalesce(code IN ('NETWORK_ERROR', 'TIMEOUT_ERROR', 'FILE_ACCESS_DENIED'), false) AS recoverable,
               coalesce(({_map(errors.ADVICE)})[code], 'The conversion failed.') AS advice FROM c""",
)
def error_codes(s, d):
    k = F.col("run_id")
    pick = lambda v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    m = F.when(k % 2 == 0, pick(_MSGS)).otherwise(F.col("error_message"))
    r = _once(s, d, "extract_runs", "run_id", "error_message").select("run_id", m.alias("m"), pick([*errors.PHASES, "unknown"]).alias("ph"))
    r = r.withColumn("code", errors.error_code(F.col("m")))
    return r.select("run_id", "code", errors.phase_code(F.col("ph")).alias("phase_code"), errors.file_error_code(F.col("m")).alias("file_code"), errors.recoverable(F.col("code")).alias("recoverable"), errors.message_for(F.col("code")).alias("advice"))


_STEPS = f"(SELECT lower(trim(provider)) AS provider, coalesce(schema_used, '(none)') AS step, sum(CASE WHEN isfinite(processing_time) AND processing_time > 0 THEN CAST(round(processing_time * 1000) AS BIGINT) END) AS duration, count(*) AS n, count(*) FILTER (WHERE NOT coalesce(success, false)) AS failures FROM {_R} GROUP BY 1, 2)"


def _steps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _once(s, d, "extract_runs", "run_id", "provider", "schema_used", "processing_time", "success").select(F.lower(F.trim("provider")).alias("provider"), F.coalesce("schema_used", F.lit("(none)")).alias("step"), "processing_time", "success")
    v = F.col("processing_time")
    return metrics.step_report(r, "provider", "step", F.when(~F.isnan(v) & (v > 0) & (v < float("inf")), F.round(v * 1000).cast("bigint")), F.coalesce("success", F.lit(False)))


@query("step_report", f"SELECT provider, step, CAST(duration AS BIGINT) AS duration, n, failures, round(duration * 100.0::DOUBLE / sum(duration) OVER (PARTITION BY provider), 6) AS percentage FROM {_STEPS}")
def step_report(s, d):
    return _steps(s, d)[0].withColumn("percentage", F.round("percentage", 6))


@query("slowest_steps", f"SELECT * FROM (SELECT provider, step, CAST(duration AS BIGINT) AS duration, n, failures, CAST(row_number() OVER (PARTITION BY provider ORDER BY duration DESC NULLS LAST, step) AS INTEGER) AS place FROM {_STEPS}) WHERE place <= 3")
def slowest_steps(s, d):
    return _steps(s, d)[1]


@query("doc_type", rf"SELECT conv_id, CASE WHEN coalesce(regexp_matches(t, '(?i)invoice{_WS}*(number|no|#)|facture{_WS}*(numéro|n°|#)|rechnung{_WS}*(nummer|nr)|bill{_WS}*to|remit{_WS}*to'), false) THEN 'invoice' ELSE 'unknown' END AS doc_type FROM (SELECT conv_id, concat(markdown, (['Invoice  # 1', 'facture n° 3', 'Rechnung Nr 3', 'bill to', '', 'remit'])[conv_id % 6 + 1]) AS t FROM {_C})")
def doc_type(s, d):
    tail = F.element_at(F.array(*[F.lit(x) for x in ("Invoice  # 1", "facture n° 3", "Rechnung Nr 3", "bill to", "", "remit")]), (F.col("conv_id") % 6 + 1).cast("int"))
    return _once(s, d, "conversions", "conv_id", "markdown").select("conv_id", textrules.doc_type(F.concat(F.coalesce("markdown", F.lit("")), tail)).alias("doc_type"))


@query(
    "model_cost",
    "WITH m(name, cost, most) AS (VALUES " + ", ".join(f"('{n}', {c}::DOUBLE, {m})" for n, _, c, m, _ in validate.MODEL_CAPS) + """), i AS (SELECT run_id, (['gpt-4o', 'llava:34b', 'llava-phi3:latest', 'other'])[run_id % 4 + 1] AS model, count(*) AS n_images FROM page_images GROUP BY 1, 2)
       SELECT run_id, model, n_images, CASE WHEN name IS NOT NULL AND n_images <= most THEN n_images * cost END AS cost, CASE WHEN name IS NULL THEN 'unknown model' WHEN n_images > most THEN 'too many images' END AS error FROM i LEFT JOIN m ON name = model""",
)
def model_cost(s, d):
    model = F.element_at(F.array(*[F.lit(x) for x in ("gpt-4o", "llava:34b", "llava-phi3:latest", "other")]), (F.col("run_id") % 4 + 1).cast("int"))
    return metrics.model_cost(table(s, d, "page_images").select("run_id", model.alias("m")), "run_id", "m")


@query(
    "formats",
    r"""WITH c AS (SELECT c_custkey, (['FR12X', 'fr12', 'DE123', 'D1', 'GB 1'])[c_custkey % 5 + 1] AS vat, (['12,50 €', 'abc', '$3.1', ''])[c_custkey % 4 + 1] AS cur, (['a@b.co', 'a.b@c', 'x@y.org ', 'first.last@sub.dom.net', '@q.de'])[c_custkey % 5 + 1] AS mail FROM customer)
        SELECT c_custkey, regexp_matches(vat, '^[A-Z]{2}[A-Z0-9]+$') AS vat_ok, regexp_matches(regexp_replace(cur, '[^0-9.,]', '', 'g'), '^[0-9.,]+$') AS currency_ok,
               regexp_matches(mail, '^[A-Za-z0-9_+-]+(\.[A-Za-z0-9_+-]+)*@([A-Za-z0-9][A-Za-z0-9-]*\.)+[A-Za-z]{2,}$') AS email_ok FROM c""",
)
def formats(s, d):
    k = F.col("c_custkey")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
    return table(s, d, "customer").select("c_custkey", validate.is_vat_number(pick("FR12X", "fr12", "DE123", "D1", "GB 1")).alias("vat_ok"), validate.is_currency(pick("12,50 €", "abc", "$3.1", "")).alias("currency_ok"), validate.is_email(pick("a@b.co", "a.b@c", "x@y.org ", "first.last@sub.dom.net", "@q.de")).alias("email_ok"))


@query("auto_correct", f"SELECT run_id, coalesce(TRY_CAST(t AS INTEGER), 0) AS page_count, coalesce(TRY_CAST(nullif(trim(u), '') AS DOUBLE), -1.0) AS ratio FROM (SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'n/a' ELSE CAST(page_count AS VARCHAR) END AS t, CASE WHEN run_id % 5 = 0 THEN ' ' ELSE CAST(CAST(run_id % 7 AS DOUBLE) / 4 AS VARCHAR) END AS u FROM {_R})")
def auto_correct(s, d):
    """Text to numbers, what is missing or wrong to its default."""
    k = F.col("run_id")
    t = F.when(k % 3 == 0, F.lit("n/a")).otherwise(F.col("page_count").cast("string"))
    u = F.when(k % 5 == 0, F.lit(" ")).otherwise(((k % 7).cast("double") / 4).cast("string"))
    return _once(s, d, "extract_runs", "run_id", "page_count").select("run_id", F.coalesce(t.try_cast("int"), F.lit(0)).alias("page_count"), F.coalesce(F.nullif(F.trim(u), F.lit("")).try_cast("double"), F.lit(-1.0)).alias("ratio"))


@query("json_sink", f"""SELECT run_id, '{{"run_id":' || run_id || ',"success":' || coalesce(CAST(success AS VARCHAR), 'null') || ',"page_count":' || coalesce(CAST(page_count AS VARCHAR), 'null') || '}}' AS line FROM {_R}""")
def json_sink(s, d):
    r = _once(s, d, "extract_runs", "run_id", "success", "page_count")
    return r.select("run_id", F.to_json(F.struct("run_id", "success", "page_count"), {"ignoreNullFields": "false"}).alias("line"))


@query("run_counts", f"SELECT strftime(started_at, '%Y-%m-%d') AS window_start, lower(trim(provider)) AS provider, count(*) AS n_runs, count(*) FILTER (WHERE coalesce(success, false)) AS n_success FROM {_R} GROUP BY 1, 2")
def runs_by_window(s, d):
    return run_counts(table(s, d, "extract_runs")).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


# Spark's own relational operators over the engine's tables


def _runs(s: SparkSession, d: str) -> DataFrame:
    r = _once(s, d, "extract_runs", "run_id", "provider", "model", "schema_used", "page_count", "success", "started_at", "source_path")
    return r.withColumns({c: F.lower(F.trim(c)) for c in ("provider", "model")})


_RUNS = f"(SELECT run_id, lower(trim(provider)) AS provider, lower(trim(model)) AS model, schema_used, page_count, success, started_at, source_path FROM {_R})"


@query("runs_cube", f"SELECT provider, schema_used, CAST(grouping_id(provider, schema_used) AS BIGINT) AS level, count(*) AS n, sum(page_count)::BIGINT AS pages FROM {_RUNS} GROUP BY CUBE (provider, schema_used)")
def runs_cube(s, d):
    return _runs(s, d).cube("provider", "schema_used").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum("page_count").alias("pages"))


@query("runs_rollup", f"SELECT provider, model, count(*) AS n, count(DISTINCT source_path) AS n_sources FROM {_RUNS} GROUP BY ROLLUP (provider, model)")
def runs_rollup(s, d):
    return _runs(s, d).rollup("provider", "model").agg(F.count("*").alias("n"), F.countDistinct("source_path").alias("n_sources"))


@query("runs_window", f"SELECT run_id, CAST(row_number() OVER (PARTITION BY provider, model ORDER BY started_at, run_id) AS INTEGER) AS place, sum(page_count) OVER (PARTITION BY provider, model ORDER BY started_at, run_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)::BIGINT AS last_three FROM {_RUNS}")
def runs_window(s, d):
    return metrics.running_in_group(_runs(s, d), ["provider", "model"], "started_at", "run_id", "page_count").withColumnRenamed("total", "last_three")


@query("request_defaults", r"""SELECT run_id, coalesce(provider, 'scaleway') AS provider, coalesce(nullif(option, ''), 'none') AS model, coalesce(q, '*') AS query, TRY_CAST(nullif(regexp_extract(crop, '^\s*([+-]?[0-9]+)', 1), '') AS INTEGER) AS crop_size, tables_only,
         CASE WHEN run_id % 3 = 0 THEN false ELSE true END AS enhance_contrast, CASE WHEN coalesce(quality, '') = '' THEN 95 ELSE TRY_CAST(quality AS INTEGER) END AS target_quality, false AS debug FROM REQ""".replace("REQ", _REQ))
def request_defaults(s, d):
    r = _requests(s, d)
    text = lambda c: F.col(c).cast("string")
    contrast = F.when(F.col("run_id") % 3 == 0, "false").when(F.col("run_id") % 3 == 1, "yes")
    x = r.select("run_id", validate.request_defaults(F.col("provider"), F.coalesce(F.nullif("option", F.lit("")), F.lit("none")), F.col("q"), F.col("crop"), text("tables_only"), F.col("doc_type"), contrast, F.col("quality"), F.lit("no")).alias("r"))
    return x.select("run_id", "r.provider", "r.model", "r.query", F.col("r.cropSize").alias("crop_size"), F.col("r.tablesOnly").alias("tables_only"), F.col("r.enhanceContrast").alias("enhance_contrast"), F.col("r.targetQuality").alias("target_quality"), "r.debug")


@query("passing_errors", """SELECT run_id, CASE WHEN error_message IS NULL THEN false ELSE lower(error_message) SIMILAR TO '.*(rate limit|timeout|connection|econnreset|etimedout|429|503).*' END AS passing FROM (SELECT DISTINCT run_id, error_message FROM extract_runs)""")
def passing_errors(s, d):
    return _once(s, d, "extract_runs", "run_id", "error_message").select("run_id", errors.is_passing(F.col("error_message")).alias("passing"))


@query("runs_without_pages", f"SELECT run_id FROM {_RUNS} r WHERE NOT EXISTS (SELECT 1 FROM page_images p WHERE p.run_id = r.run_id)")
def runs_without_pages(s, d):
    return _runs(s, d).select("run_id").join(table(s, d, "page_images").select("run_id"), "run_id", "left_anti")


@query("run_sets", f"SELECT 'both' AS part, run_id FROM (SELECT run_id FROM page_images INTERSECT SELECT run_id FROM extract_results) UNION ALL SELECT 'only_pages', run_id FROM (SELECT run_id FROM page_images EXCEPT SELECT run_id FROM extract_results)")
def run_sets(s, d):
    p, r = table(s, d, "page_images").select("run_id"), table(s, d, "extract_results").select("run_id")
    return p.intersect(r).select(F.lit("both").alias("part"), "run_id").union(p.subtract(r).select(F.lit("only_pages").alias("part"), "run_id"))


@query("previous_run", f"SELECT run_id, prev AS previous_run FROM (SELECT a.run_id, b.run_id AS prev, row_number() OVER (PARTITION BY a.run_id ORDER BY b.started_at DESC, b.run_id DESC) AS k FROM {_RUNS} a JOIN {_RUNS} b ON a.source_path = b.source_path AND a.provider = b.provider AND a.model = b.model AND (b.started_at < a.started_at OR (b.started_at = a.started_at AND b.run_id < a.run_id))) WHERE k = 1")
def previous_run(s, d):
    """As-of join of each run with the one before it on the same file and model: windows of a day, not a range join."""
    x = _runs(s, d).where("source_path is not null and provider is not null and model is not null and started_at is not null")
    return metrics.previous_in_group(x, ["source_path", "provider", "model"], "started_at", "run_id").withColumnRenamed("previous", "previous_run").where("previous_run is not null")
