"""Registered queries over report pages and their text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionhour.constants import (
    BLOCK_MARKER_WINDOW,
    BLOCK_MARKERS,
    CHAR_EXPANSIONS,
    CHAR_REPLACEMENTS,
    CHARS_REMOVED,
    MONTHS,
    REPORT_URL_PATTERNS,
)
from regionhour.functions import text
from regionhour.functions.markup import content_text
from regionhour.operators import reports as ops
from regionhour.plans.alarm_queries import day_text, round_columns
from regionhour.plans.lenses import BASE_DAY, Lenses, with_views

PHRASE = "the"
LEXICON = ["the", "and", "ing", "les", "der", "que"]


def with_text(v: Lenses) -> DataFrame:
    return ops.extract_report_text(v.reports)


def plain_text(v: Lenses) -> DataFrame:
    """Report rows with the page's raw text, which plain SQL can compute too."""
    return v.reports.withColumn("text", content_text(F.col("html")))


def existing(v: Lenses) -> DataFrame:
    return v.reports.where(F.col("page_id") % 5 == 0)


def classified(v: Lenses, force: bool = False) -> DataFrame:
    return ops.classify_report(plain_text(v), existing(v), force, PHRASE)


def text_digest(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("text_length"))


def candidates(v: Lenses) -> DataFrame:
    return ops.candidate_urls(v.reports)


def captures(v: Lenses) -> DataFrame:
    """Captured pages: of each date one or two of the seven addresses, or none."""
    tried = candidates(v).join(v.reports.select("report_date", "page_id", "html"), "report_date")
    hit = (F.col("priority") == F.col("page_id") % 9) | (F.col("priority") == F.col("page_id") % 11)
    return tried.where(hit).select("url", F.coalesce("html", F.lit("x")).alias("html"))


def first_successful_candidate(v: Lenses) -> DataFrame:
    found = ops.first_successful_candidate(candidates(v), captures(v))
    return found.select(
        day_text("report_date").alias("report_date"), "url", F.md5(F.col("html").cast("binary")).alias("html_md5"),
        F.col("found").cast("int").alias("found"),
    )


def results(v: Lenses) -> DataFrame:
    """Outcomes with longer runs of blocked pages."""
    page = F.col("page_id")
    blocked = page % 16 > 9
    return v.reports.select(
        "report_date",
        F.when(blocked, "no_content").when(page % 5 == 0, "skipped").when(page % 6 == 0, "not_found")
        .when(page % 17 == 0, "odd").otherwise("ok").alias("status"),
        F.when(blocked, "Missing validation phrase — possibly blocked").otherwise("").alias("error_message"),
    )


_RESULTS = """
    SELECT report_date, page_id % 16 > 9 AS blocked,
           CASE WHEN page_id % 16 > 9 THEN 'no_content' WHEN page_id % 5 = 0 THEN 'skipped' WHEN page_id % 6 = 0 THEN 'not_found'
                WHEN page_id % 17 = 0 THEN 'odd' ELSE 'ok' END AS status
    FROM reports"""


def latest_report_asof(v: Lenses) -> DataFrame:
    outcomes = v.gapped_reports.select("report_date", "url").join(results(v).select("report_date", "status"), "report_date")
    out = ops.latest_report_asof(ops.spine_between(v.gapped_reports), outcomes)
    return out.select(day_text("as_of").alias("as_of"), day_text("report_date").alias("report_date"), "url", "age_days")


def document_days(v: Lenses) -> DataFrame:
    """Documents as report text, a hundred days of them."""
    day = F.date_add(F.lit(BASE_DAY).cast("date"), (F.col("doc_id") % 100).cast("int"))
    return v.table("documents").select(day.alias("report_date"), "text")


def escalation_score(v: Lenses) -> DataFrame:
    out = ops.escalation_score(ops.tokenize_daily(document_days(v)), LEXICON)
    return round_columns(out.withColumn("report_date", day_text("report_date")), "score", "per_1000")


def tokenize_daily(v: Lenses) -> DataFrame:
    return ops.tokenize_daily(document_days(v)).withColumn("report_date", day_text("report_date"))


def sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_MARKERS = " + ".join(f"CAST(contains(head, '{m}') AS INT)" for m in BLOCK_MARKERS)
ARTICLE = """
    SELECT page_id, report_date, url, html,
           array_to_string([replace(trim(piece, concat(' ', chr(1), chr(9))), chr(1), chr(10)) FOR piece IN string_split(
             replace(replace(replace(replace(regexp_replace(replace(regexp_extract(html, '<article>(.*)</article>', 1, 's'), chr(10), chr(1)),
               '<[^>]*>', chr(10), 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10))
             IF trim(piece, concat(' ', chr(1), chr(9))) <> ''], chr(10)) AS text
    FROM reports WHERE html LIKE '%<article>%'
    UNION ALL SELECT page_id, report_date, url, html, regexp_extract(html, '</title>(.*)</html>', 1) FROM reports WHERE html IS NULL OR html NOT LIKE '%<article>%'"""
_STATUS = f"""
    SELECT *, CASE WHEN present THEN 'skipped' WHEN html IS NULL THEN 'not_found'
                   WHEN length(html) < 500 OR chars < 200 OR NOT contains(lower(text), '{PHRASE}') THEN 'no_content' ELSE 'ok' END AS status,
           CASE WHEN present OR html IS NULL THEN '' WHEN length(html) < 500 THEN concat('HTML only ', length(html), ' bytes')
                WHEN chars < 200 THEN concat('Text ', chars, ' chars')
                WHEN NOT contains(lower(text), '{PHRASE}') THEN 'Missing validation phrase — possibly blocked' ELSE '' END AS error_message
    FROM (SELECT *, coalesce(length(text), 0) AS chars, page_id % 5 = 0 AS present FROM article)"""
_CLASSIFIED = {"article": ARTICLE, "classified": _STATUS}
_CANDIDATES = "SELECT page_id, report_date, html, priority, url FROM (" + " UNION ALL ".join(
    f"SELECT page_id, report_date, html, {i} AS priority, "
    + "replace(replace(replace(replace(" + sql_text(p)
    + ", '{month}', month_name), '{day}', CAST(day(report_date) AS VARCHAR)), '{day_padded}', strftime(report_date, '%d')), "
    + "'{year}', CAST(year(report_date) AS VARCHAR)) AS url "
    + f"FROM (SELECT *, {MONTHS}[month(report_date)] AS month_name FROM reports)"
    for i, p in enumerate(REPORT_URL_PATTERNS)
) + ")"
_WORDS = {
    "days": "SELECT DATE '" + BASE_DAY + "' + CAST(doc_id % 100 AS INT) AS report_date, text FROM documents",
    "tokens": "SELECT report_date, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM days",
}
_PLAIN = "text"
for _fancy, _simple in {**CHAR_REPLACEMENTS, **dict.fromkeys(CHARS_REMOVED, ""), **CHAR_EXPANSIONS}.items():
    _PLAIN = f"replace({_PLAIN}, chr({ord(_fancy)}), {sql_text(_simple)})"



def daily_scores(tokens: str) -> str:
    """SQL of the daily score over a view of tokens."""
    return f"""
        SELECT report_date, tokens, hits, per_1000, round(1 + 9 * percent_rank() OVER (ORDER BY per_1000), 6) AS score
        FROM (SELECT report_date, count(*) AS tokens, count(*) FILTER (token IN {tuple(LEXICON)}) AS hits,
                     round(count(*) FILTER (token IN {tuple(LEXICON)}) * 1000.0 / count(*), 6) AS per_1000
              FROM {tokens} GROUP BY 1)"""


QUERIES = {
    "extract_report_text": (lambda v: text_digest(plain_text(v), "page_id"), with_views(
        "SELECT page_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS text_length FROM article",
        "reports", extra={"article": ARTICLE})),
    "clean_report_text": (lambda v: text_digest(with_text(v), "page_id"), None),
    "normalize_unicode": (
        lambda v: v.typographic_documents.select("doc_id", text.normalize_unicode(F.col("text")).alias("text")), None),
    "replace_characters": (
        lambda v: text_digest(v.typographic_documents.withColumn("text", text.replace_characters(F.col("text"))), "doc_id"),
        with_views(f"SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS text_length FROM (SELECT doc_id, {_PLAIN} AS t FROM typographic_documents)",
                   "typographic_documents")),
    "strip_refs_urls": (
        lambda v: text_digest(v.marked_documents.withColumn("text", text.strip_refs_urls(F.col("text"))), "doc_id"),
        with_views(r"""
        SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS text_length
        FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
                '\[\s*(?:\d+(?:\s*[,\-]\s*\d+)*|[a-zA-Z]+)\s*\]', '', 'g'), 'https?://\S+', '', 'g'), '[ \t]+', ' ', 'g') AS t
              FROM marked_documents)""", "marked_documents")),
    "collapse_blank_lines": (
        lambda v: text_digest(v.marked_documents.withColumn("text", text.collapse_blank_lines(F.col("text"))), "doc_id"),
        with_views(r"""
        SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS text_length
        FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]*\n[ \t\r\f\v]*', chr(10), 'g'),
                '\n{4,}', concat(chr(10), chr(10), chr(10)), 'g'), '^\s+|\s+$', '', 'g') AS t
              FROM marked_documents)""", "marked_documents")),
    "detect_block_page": (
        lambda v: v.reports.select("page_id", text.count_block_markers(F.col("html")).alias("markers"),
                                   text.is_block_page(F.col("html")).cast("int").alias("blocked")),
        with_views(f"""
        SELECT page_id, {_MARKERS} AS markers, CAST({_MARKERS} >= 2 AS INT) AS blocked
        FROM (SELECT page_id, lower(substr(html, 1, {BLOCK_MARKER_WINDOW})) AS head FROM reports)""", "reports")),
    "classify_report": (
        lambda v: classified(v).select("page_id", "status", "error_message", "chars"),
        with_views("""
        SELECT page_id, status, error_message, CAST(CASE WHEN status = 'ok' THEN chars ELSE 0 END AS INT) AS chars FROM classified""",
                   "reports", extra=_CLASSIFIED)),
    "report_document": (
        lambda v: ops.report_document(classified(v)).withColumn("text", F.md5(F.col("text").cast("binary"))),
        with_views("""
        SELECT strftime(report_date, '%Y-%m-%d') AS date, url, status, CAST(chars AS INT) AS char_count, md5(text) AS text
        FROM classified WHERE status = 'ok'""", "reports", extra=_CLASSIFIED)),
    "scrape_status_rollup": (lambda v: ops.scrape_status_rollup(results(v)), with_views("""
        SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'skipped') AS skipped,
               count(*) FILTER (status = 'not_found') AS not_found, count(*) FILTER (status = 'no_content') AS no_content,
               count(*) FILTER (status = 'odd') AS error, count(*) FILTER (status IN ('not_found', 'no_content', 'odd')) AS failed
        FROM results""", "reports", extra={"results": _RESULTS})),
    "failed_dates_head": (
        lambda v: ops.failed_dates_head(results(v)).withColumn("report_date", day_text("report_date")),
        with_views("""
        SELECT strftime(report_date, '%Y-%m-%d') AS report_date, status,
               (SELECT greatest(count(*) - 20, 0) FROM results WHERE status IN ('not_found', 'no_content')) AS not_listed
        FROM results WHERE status IN ('not_found', 'no_content') ORDER BY results.report_date LIMIT 20""",
                   "reports", extra={"results": _RESULTS})),
    "block_runs": (
        lambda v: ops.block_runs(results(v)).withColumns({"run_start": day_text("run_start"), "run_end": day_text("run_end")}),
        with_views("""
        SELECT strftime(min(report_date), '%Y-%m-%d') AS run_start, strftime(max(report_date), '%Y-%m-%d') AS run_end,
               count(*) AS length, count(*) // 3 AS triggers
        FROM (SELECT *, row_number() OVER (ORDER BY report_date) - row_number() OVER (PARTITION BY blocked ORDER BY report_date) AS run
              FROM results) WHERE blocked GROUP BY run""", "reports", extra={"results": _RESULTS})),
    "extract_title": (
        lambda v: text.with_page_title(v.table("pages")).select("page_id", "title"),
        r"""
        SELECT page_id, CASE WHEN length(t) > 200 THEN concat(substr(t, 1, 197), '...') WHEN t = '' THEN '[EMPTY TITLE]' ELSE t END AS title
        FROM (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'),
                '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g')) AS t FROM pages)"""),
    "date_spine": (
        lambda v: ops.spine_between(v.gapped_reports).select(day_text("report_date").alias("report_date")),
        with_views("""
        SELECT strftime(unnest(range(CAST(min(report_date) AS TIMESTAMP), CAST(max(report_date) AS TIMESTAMP) + INTERVAL 1 DAY,
                        INTERVAL 1 DAY)), '%Y-%m-%d') AS report_date FROM gapped_reports""", "gapped_reports")),
    "missing_report_dates": (
        lambda v: ops.missing_report_dates(ops.spine_between(v.gapped_reports), v.gapped_reports).select(day_text("report_date").alias("report_date")),
        with_views("""
        SELECT strftime(d, '%Y-%m-%d') AS report_date
        FROM (SELECT unnest(range(CAST(min(report_date) AS TIMESTAMP), CAST(max(report_date) AS TIMESTAMP), INTERVAL 1 DAY)) AS d FROM gapped_reports)
        WHERE CAST(d AS DATE) NOT IN (SELECT report_date FROM gapped_reports)""", "gapped_reports")),
    "candidate_urls": (
        lambda v: candidates(v).withColumn("report_date", day_text("report_date")),
        with_views("SELECT strftime(report_date, '%Y-%m-%d') AS report_date, priority, url FROM c", "reports", extra={"c": _CANDIDATES})),
    "first_successful_candidate": (first_successful_candidate, with_views("""
        SELECT strftime(report_date, '%Y-%m-%d') AS report_date,
               coalesce(arg_min(c.url, priority) FILTER (page IS NOT NULL), arg_min(c.url, priority)) AS url,
               md5(arg_min(page, priority) FILTER (page IS NOT NULL)) AS html_md5, CAST(bool_or(page IS NOT NULL) AS INT) AS found
        FROM c LEFT JOIN (SELECT DISTINCT url, coalesce(html, 'x') AS page FROM c
                          WHERE priority = page_id % 9 OR priority = page_id % 11) captured USING (url)
        GROUP BY report_date""", "reports", extra={"c": _CANDIDATES})),
    "latest_report_asof": (latest_report_asof, with_views("""
        SELECT strftime(d, '%Y-%m-%d') AS as_of, strftime(coalesce(t.report_date, y.report_date), '%Y-%m-%d') AS report_date,
               coalesce(t.url, y.url) AS url,
               CASE WHEN t.report_date IS NOT NULL THEN 0 WHEN y.report_date IS NOT NULL THEN 1 END AS age_days
        FROM (SELECT CAST(unnest(range(CAST(min(report_date) AS TIMESTAMP), CAST(max(report_date) AS TIMESTAMP) + INTERVAL 1 DAY,
                     INTERVAL 1 DAY)) AS DATE) AS d FROM gapped_reports)
        LEFT JOIN usable t ON t.report_date = d LEFT JOIN usable y ON y.report_date = d - 1""",
        "gapped_reports", extra={"results": _RESULTS, "usable": """
        SELECT g.* FROM gapped_reports g JOIN results USING (report_date) WHERE status IN ('ok', 'skipped')"""})),
    "report_to_hours": (
        lambda v: ops.report_to_hours(v.reports.select("report_date", "page_id")).withColumn("report_date", day_text("report_date")),
        with_views("""
        SELECT strftime(report_date, '%Y-%m-%d') AS report_date, page_id, CAST(unnest(range(0, 24)) AS INT) AS hour FROM reports""", "reports")),
    "tokenize_daily": (tokenize_daily, with_views(
        "SELECT strftime(report_date, '%Y-%m-%d') AS report_date, token, count(*) AS n FROM tokens GROUP BY 1, 2", extra=_WORDS)),
    "escalation_score": (escalation_score, with_views(
        "SELECT * REPLACE (strftime(report_date, '%Y-%m-%d') AS report_date) FROM scored", extra={**_WORDS, "scored": daily_scores("tokens")})),
}
