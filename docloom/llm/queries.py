"""Queries of the training-data operators, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import leakage, lookalike, markup, mixing, nearcopies, percentiles, splitting, subjects
from docloom.plans.session import materialise, table

Q = Callable[[SparkSession, str], DataFrame]


def _classified(s: SparkSession, d: str) -> DataFrame:
    docs = table(s, d, "documents")
    return subjects.classify(docs, subjects.train(docs, table(s, d, "subject_labels"), table(s, d, "subject_areas")))


def _digest_days(s: SparkSession, d: str) -> DataFrame:
    return materialise(percentiles.run_digests(table(s, d, "extract_runs")), "digests")


def p1_clean(s: SparkSession, d: str) -> DataFrame:
    """Clean text of every conversion, redelivered rows once."""
    c = table(s, d, "conversions").select("conv_id", "markdown").dropDuplicates(["conv_id"])
    return markup.clean_markup(c)


def p4_percentiles(s: SparkSession, d: str) -> DataFrame:
    return percentiles.quantiles(_digest_days(s, d), ["provider", "model", "run_day"], {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


def p4_period(s: SparkSession, d: str) -> DataFrame:
    keys = ["provider", "model"]
    return percentiles.quantiles(percentiles.merge(_digest_days(s, d), keys), keys, {"p05": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99})


QUERIES: dict[str, Q] = {
    "p1_found": lambda s, d: markup.residue_kinds(table(s, d, "conversions")),
    "p1_clean": p1_clean,
    "p2_found": lambda s, d: splitting.oversized(table(s, d, "conversions")),
    "p2_pieces": lambda s, d: splitting.split_rows(table(s, d, "conversions")),
    "p4_found": lambda s, d: percentiles.slow_days(_digest_days(s, d)),
    "p4_percentiles": p4_percentiles,
    "p4_period": p4_period,
    "p5_found": lambda s, d: lookalike.lookalike_pairs(table(s, d, "conversions")),
    "p5_canonical": lambda s, d: lookalike.canonical_text(table(s, d, "conversions").select("conv_id", "title", "markdown").dropDuplicates(["conv_id"])),
    "p5_report": lambda s, d: lookalike.lookalike_report(table(s, d, "conversions")),
    "p6_found": lambda s, d: nearcopies.near_pairs(table(s, d, "conversions")),
    "p6_groups": lambda s, d: nearcopies.near_groups(table(s, d, "conversions")),
    "p7_found": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")).select("doc_id", "item_id").distinct(),
    "p7_report": lambda s, d: leakage.leaked_items(table(s, d, "documents"), table(s, d, "eval_items")),
    "p8_found": lambda s, d: mixing.short_sources(table(s, d, "documents"), table(s, d, "mix_targets")),
    "p8_mixture": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[0],
    "p8_shares": lambda s, d: mixing.mixture(table(s, d, "documents"), table(s, d, "mix_targets"))[1],
    "p9_found": lambda s, d: subjects.subject_rows(_classified(s, d)),
    "p9_composition": lambda s, d: subjects.composition(materialise(_classified(s, d), "classified")),
}

# independent SQL for the searches that patterns can express

_Q = "'"
_FOLD = {k: v for k, v in lookalike.rules().items() if len(v) == 1} | {"ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï"}
P5 = f"""
        WITH c AS (SELECT DISTINCT conv_id, title, markdown FROM conversions),
             v AS (SELECT conv_id, 'title' AS field_name, title AS v FROM c WHERE title <> '' UNION ALL SELECT conv_id, 'markdown', markdown FROM c WHERE markdown <> ''),
             n AS (SELECT *, nfc_normalize(translate(regexp_replace(v, '[{lookalike.WIDTHLESS}]', '', 'g'), '{"".join(_FOLD)}', '{"".join(_FOLD.values()).replace(_Q, _Q * 2)}')) AS n FROM v)
        SELECT a.conv_id AS conv_id_a, b.conv_id AS conv_id_b, a.field_name FROM n a JOIN n b ON a.field_name = b.field_name AND a.n = b.n AND a.v <> b.v AND a.conv_id < b.conv_id"""
_FENCE = "|".join(rf"(?:^[ \t]*{c}{{{n}}}[^{c}\n]*\n(?s:.*?)^[ \t]*{c}{{{n},}}[ \t\r]*$)" for c in "`~" for n in (6, 5, 4, 3))
P2 = rf"""
        WITH c AS (SELECT DISTINCT ON (conv_id) conv_id, markdown AS m FROM conversions WHERE length(markdown) > 3000),
             f AS (SELECT conv_id, list_reduce(list_prepend(m, regexp_extract_all(m, '(?m){_FENCE}')), lambda a, x: replace(a, x, repeat('x', length(x)))) AS t FROM c)
        SELECT conv_id, CASE WHEN list_max(list_transform(string_split_regex(t, '\r?\n([ \t]*\r?\n)+'), lambda s: length(rtrim(s, chr(13) || chr(10))))) > 3000 THEN 'inside_block' ELSE 'between_blocks' END AS cut_kind FROM f"""
_HTML = r'<!--|</?[A-Za-z][A-Za-z0-9]*(:[a-z]+)?(\s+[A-Za-z-]+\s*=\s*("[^"]*"|\x27[^\x27]*\x27|[^\s>"\x27]+))*\s*/?>|&(#[0-9]+|[A-Za-z]{2,8}[0-9]?);'
_WIKI = r'(?m)\[\[[^\[\]\n]+\]\]|\{\{|^[ \t]*\{\||\x27\x27[^\s\x27]|__[A-Z]{3,}__|^={1,6}[^=\n]+={1,6}[ \t\r]*$|\[https?://[^\s\]]+ [^\]\n]+\]'
_LATEX = r'(?m)\\[A-Za-z]{2,}\*?(\[[^\]\n]*\])?\{|\\(maketitle|noindent|bf|it|hline|item)\b|[0-9]\\[,%]|\\\\[ \t\r]*$'
P1 = rf"""
        WITH c AS (SELECT DISTINCT conv_id, markdown AS m FROM conversions WHERE markdown IS NOT NULL),
             a AS (SELECT conv_id, regexp_replace(m, '(?m){_FENCE}|`[^`\n]+`|``[^\n]+?``|\$\$(?s:.+?)\$\$', '', 'g') AS m FROM c),
             b AS (SELECT conv_id, regexp_replace(regexp_replace(m, '\$[^\s$]([^$\n]*[^\s$\\])?\$([^0-9$]|$)', '\2', 'g'), '[A-Za-z]:\\\S*', '', 'g') AS m FROM a)
        SELECT conv_id, kind FROM (SELECT conv_id, unnest([CASE WHEN regexp_matches(m, '{_HTML}') THEN 'html' END, CASE WHEN regexp_matches(m, '{_WIKI}') THEN 'wiki' END, CASE WHEN regexp_matches(m, '{_LATEX}') THEN 'latex' END]) AS kind FROM b) WHERE kind IS NOT NULL"""

ORACLE: dict[str, str] = {
    "p1_found": P1,
    "p2_found": P2,
    "p5_found": P5,
    "p4_found": """
        WITH r AS (SELECT DISTINCT ON (run_id) lower(trim(provider)) AS provider, lower(trim(model)) AS model,
                          strftime(started_at, '%Y-%m-%d') AS run_day, processing_time AS v
                   FROM extract_runs WHERE processing_time > 0 AND isfinite(processing_time)),
             m AS (SELECT provider, model, quantile_disc(v, 0.5) AS p50 FROM r GROUP BY ALL)
        SELECT r.provider, r.model, r.run_day FROM r JOIN m ON r.provider IS NOT DISTINCT FROM m.provider AND r.model IS NOT DISTINCT FROM m.model
        GROUP BY r.provider, r.model, r.run_day, p50 HAVING quantile_disc(v, 0.95) > 3 * p50""",
    "p7_found": r"""
        WITH RECURSIVE seen AS (SELECT doc_id, text AS t, 0 AS k FROM documents
            UNION ALL SELECT doc_id, regexp_replace(t, '\{\{[^{}]*\}\}|\{\{\{[^{}]*\}\}\}', '', 'g'), k + 1 FROM seen WHERE k < 6 AND t LIKE '%{{%'),
        last AS (SELECT doc_id, arg_max(t, k) AS t FROM seen GROUP BY doc_id),
        a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '<!--(.|\n)*?-->', '', 'g'), '</?[A-Za-z][A-Za-z0-9:]*(\s[^<>]*)?/?>', '', 'g'),
                  '\[\[(?:[^\[\]|\n]*\|)?([^\[\]|]*)\]\]', '\1', 'g') AS t FROM last),
        b AS (SELECT doc_id, replace(replace(replace(regexp_replace(t, '''{2,5}', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&ndash;', '-') AS t FROM a),
        w AS (SELECT doc_id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM b WHERE t IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
        p AS (SELECT item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') AS w FROM eval_items),
        h AS (SELECT DISTINCT item_id, array_to_string(w[i:i+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS i FROM p WHERE len(w) >= 12))
        SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g)""",
    "p8_found": """
        WITH d AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
        SELECT lower(trim(m.source)) AS source FROM mix_targets m LEFT JOIN d ON d.source = lower(trim(m.source))
        WHERE m.max_repeats * coalesce(d.n, 0) < m.weight * (SELECT sum(n) FROM d)""",
}
