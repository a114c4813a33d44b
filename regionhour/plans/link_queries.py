"""Registered queries over report links and source references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regionhour.constants import (
    BLOCKED_DOMAINS,
    DEAD_STATUSES,
    INTERNAL_DOMAINS,
    NON_HTML_CONTENT_TYPES,
    NON_HTML_EXTENSIONS,
    TELEGRAM_RESERVED,
    X_DOMAINS,
    X_PROFILE_RESERVED,
    X_RESERVED,
)
from regionhour.functions import urls
from regionhour.operators import links as ops
from regionhour.plans.alarm_queries import round_columns
from regionhour.plans.lenses import Lenses, with_views
from regionhour.session import stored


def cleaned(v: Lenses) -> DataFrame:
    return v.links.select("page_id", "pos", urls.clean_url(F.col("href")).alias("url"))


def chosen_urls(v: Lenses) -> DataFrame:
    return ops.unique_report_urls(ops.select_footnote_links(v.links, "page_id"), "page_id")


def fetched(v: Lenses) -> DataFrame:
    return ops.classify_fetch(v.fetch_log)


def all_urls(v: Lenses) -> DataFrame:
    """Addresses of reports: those of their links, then those of the fetch log."""
    logged = v.fetch_log.select("page_id", (F.col("pos") + 8).alias("pos"), "url")
    return chosen_urls(v).select("page_id", "pos", "url").unionByName(logged)


def cache(v: Lenses) -> DataFrame:
    """Entries of the addresses on even pages, as an earlier run left them."""
    known = all_urls(v).where(F.col("page_id") % 2 == 0).groupBy("url").agg(F.min("page_id").alias("page"))
    return known.select(
        "url", F.concat(F.lit("cached "), F.col("page").cast("string")).alias("title"),
        F.when(F.col("page") % 3 == 0, "redirect_loop").otherwise("ok").alias("status"),
        F.lit(200).alias("http_code"), F.lit("text/html").alias("content_type"),
        F.lit(None).cast("string").alias("final_url"), F.lit(None).cast("string").alias("error_detail"),
    )


def fetched_by_url(v: Lenses) -> DataFrame:
    """One entry per address; the log may hold an address of several pages."""
    entry = F.min(F.struct("page_id", "pos", *[c for c in ops.ENTRY if c != "url"])).alias("e")
    return fetched(v).groupBy("url").agg(entry).select("url", "e.*").drop("page_id", "pos")


def entries(v: Lenses, force: bool = False) -> DataFrame:
    return ops.resolve_with_cache(all_urls(v), cache(v), fetched_by_url(v), force)


def attempts(v: Lenses) -> DataFrame:
    """Fetch log with a second attempt where the first was worth a retry, and a third where that failed too."""
    first = v.fetch_log.withColumn("attempt", F.lit(1))
    again = first.where("http_code in (429, 503)").withColumns({
        "attempt": F.lit(2),
        "http_code": F.when(F.col("page_id") % 3 == 0, 429).when(F.col("page_id") % 3 == 1, 503).otherwise(200),
    })
    third = again.where("http_code = 503").withColumns({"attempt": F.lit(3), "http_code": F.lit(404)})
    columns = ["url", "page_id", "pos", "attempt", "http_code", "failure", "failure_detail"]
    return first.select(columns).unionByName(again.select(columns)).unionByName(third.select(columns))


def listed(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def in_domains(domain: str, values: list[str]) -> str:
    return "(" + " OR ".join(f"{domain} = '{d}' OR ends_with({domain}, '.{d}')" for d in values) + ")"


_CLEAN = r"rtrim(regexp_replace(split_part(trim({}), '#', 1), '[.,;:)}}\]]+$', ''), '/')"
_DOMAIN = r"lower(regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1))"
_PATH = r"regexp_extract({}, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_FILE = rf"regexp_matches(lower({_PATH.format('url')}), '\.(?:{'|'.join(NON_HTML_EXTENSIONS)})$')"
_VALID = r"regexp_matches(url, '^(?i:https?)://[^/?#]')"
_CLEANED = f"SELECT page_id, pos, {_CLEAN.format('href')} AS url FROM links"
_MARKED = r"regexp_matches(link_text, '^\[\s*\d+\s*\]') OR parent_marked OR in_list"
_CHOSEN = f"""
    SELECT * FROM (SELECT *, {_MARKED} AS marked, max({_MARKED}) OVER (PARTITION BY page_id) AS any_marked FROM links)
    WHERE marked OR NOT any_marked"""
_UNIQUE = f"""
    SELECT page_id, url, min(pos) AS pos FROM (SELECT page_id, pos, {_CLEAN.format('href')} AS url FROM chosen)
    WHERE {_VALID} AND NOT {in_domains(_DOMAIN.format('url'), INTERNAL_DOMAINS)} GROUP BY 1, 2"""
_SPECIAL = rf"""
    SELECT url, CASE WHEN messenger AND nick <> '' AND lower(nick) NOT IN {listed(TELEGRAM_RESERVED)}
                       THEN concat('[Telegram: @', nick, CASE WHEN post <> '' THEN concat(' (Post ', post, ')') ELSE '' END, ']')
                     WHEN messenger THEN '[Telegram]'
                     WHEN short AND author <> '' AND lower(author) NOT IN {listed(X_RESERVED)} THEN concat('[X: @', author, ' (Tweet ', number, ')]')
                     WHEN short AND author = '' AND profile <> '' AND lower(profile) NOT IN {listed(X_PROFILE_RESERVED)} THEN concat('[X: @', profile, ']')
                     WHEN short THEN '[X]' WHEN blocked THEN concat('[BLOCKED: ', domain, ']')
                     WHEN file THEN concat('[NON-HTML: ', upper(regexp_extract(path, '[^/](\.[^./]+)$', 1)), ']') END AS title,
           CASE WHEN messenger THEN CASE WHEN nick <> '' AND lower(nick) NOT IN {listed(TELEGRAM_RESERVED)} THEN 'ok' ELSE 'blocked' END
                WHEN short THEN CASE WHEN author <> '' AND lower(author) NOT IN {listed(X_RESERVED)} THEN 'ok'
                                     WHEN author = '' AND profile <> '' AND lower(profile) NOT IN {listed(X_PROFILE_RESERVED)} THEN 'ok'
                                     ELSE 'blocked' END
                WHEN blocked THEN 'blocked' WHEN file THEN 'non_html' END AS status
    FROM (SELECT url, domain, contains(domain, 't.me') OR contains(domain, 'telegram') AS messenger, domain IN {listed(X_DOMAINS)} AS short,
                 {in_domains('domain', BLOCKED_DOMAINS)} AS blocked, {_FILE} AS file, {_PATH.format('url')} AS path,
                 regexp_extract(url, 't\.me/(?:s/)?([a-zA-Z0-9_]+)(?:/(\d+))?', 1) AS nick,
                 regexp_extract(url, 't\.me/(?:s/)?([a-zA-Z0-9_]+)(?:/(\d+))?', 2) AS post,
                 regexp_extract(url, '(?:x|twitter)\.com/(?:#!/)?(\w+)/status(?:es)?/(\d+)', 1) AS author,
                 regexp_extract(url, '(?:x|twitter)\.com/(?:#!/)?(\w+)/status(?:es)?/(\d+)', 2) AS number,
                 regexp_extract(url, '(?:x|twitter)\.com/(\w+)', 1) AS profile
          FROM (SELECT url, {_DOMAIN.format('url')} AS domain FROM (SELECT DISTINCT url FROM {{source}})))"""
_TITLE = r"""
    trim(regexp_replace(replace(replace(replace(replace(regexp_extract(body, '<title>(.*?)</title>', 1, 's'),
      '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '\s+', ' ', 'g'))"""
_IS_FILE = "(" + " OR ".join(f"starts_with(lower(coalesce(content_type, '')), '{t}')" for t in NON_HTML_CONTENT_TYPES) + ")"
_FETCHED = f"""
    SELECT page_id, pos, url, title, status, CASE WHEN failure IS NULL AND NOT retried THEN http_code END AS http_code,
           CASE WHEN failure IS NULL AND (file OR (NOT large AND http_code = 200)) THEN trim(split_part(content_type, ';', 1)) END AS content_type,
           CAST(NULL AS VARCHAR) AS final_url,
           CASE failure WHEN 'redirects' THEN 'Too many redirects' WHEN 'timeout' THEN 'Timeout after 15s' WHEN 'ssl' THEN 'reset by peer'
                WHEN 'connection' THEN 'reset by peer'
                ELSE CASE WHEN file THEN NULL WHEN large THEN concat('Content-Length: ', content_length)
                          WHEN retried THEN concat('Failed after 2 retries: ', CASE WHEN http_code >= 500 THEN concat('HTTP ', http_code) ELSE '' END) END
           END AS error_detail
    FROM (SELECT *, {_IS_FILE} AS file, coalesce(content_length > 5000000, false) AS large,
                 failure IS NULL AND NOT {_IS_FILE} AND NOT coalesce(content_length > 5000000, false)
                   AND (http_code = 429 OR http_code >= 500) AS retried,
                 CASE WHEN failure = 'redirects' THEN '[REDIRECT LOOP]' WHEN failure = 'ssl' THEN '[SSL ERROR]'
                      WHEN failure = 'timeout' THEN '[TIMEOUT]' WHEN failure = 'connection' THEN '[CONNECTION ERROR]'
                      WHEN {_IS_FILE} THEN concat('[NON-HTML: ', trim(split_part(content_type, ';', 1)), ']')
                      WHEN content_length > 5000000 THEN '[TOO LARGE]' WHEN http_code = 404 THEN '[DEAD LINK]'
                      WHEN http_code = 410 THEN '[GONE]' WHEN http_code = 403 THEN '[ACCESS DENIED]'
                      WHEN http_code = 451 THEN '[UNAVAILABLE FOR LEGAL REASONS]' WHEN http_code = 429 THEN '[FAILED: ]'
                      WHEN http_code >= 500 THEN concat('[FAILED: HTTP ', http_code, ']')
                      WHEN http_code <> 200 THEN concat('[HTTP ', http_code, ']')
                      WHEN length(t) > 200 THEN concat(substr(t, 1, 197), '...') WHEN t = '' THEN '[EMPTY TITLE]' ELSE t END AS title,
                 CASE WHEN failure = 'redirects' THEN 'redirect_loop' WHEN failure = 'ssl' THEN 'error'
                      WHEN failure = 'timeout' THEN 'timeout' WHEN failure = 'connection' THEN 'connection_error'
                      WHEN {_IS_FILE} OR content_length > 5000000 THEN 'non_html' WHEN http_code IN (404, 410) THEN 'dead_link'
                      WHEN http_code IN (403, 451) THEN 'blocked' WHEN http_code <> 200 THEN 'error' ELSE 'ok' END AS status
          FROM (SELECT *, {_TITLE} AS t FROM fetch_log))"""
URL_VIEWS = {
    "chosen": _CHOSEN,
    "unique_urls": _UNIQUE,
    "all_urls": "SELECT page_id, pos, url FROM unique_urls UNION ALL SELECT page_id, pos + 8, url FROM fetch_log",
}
ENTRY_VIEWS = {
    **URL_VIEWS,
    "fetched": _FETCHED,
    "special": _SPECIAL.format(source="all_urls"),
    "cached": """
        SELECT url, concat('cached ', min(page_id)) AS title, CASE WHEN min(page_id) % 3 = 0 THEN 'redirect_loop' ELSE 'ok' END AS status,
               200 AS http_code, 'text/html' AS content_type, CAST(NULL AS VARCHAR) AS final_url, CAST(NULL AS VARCHAR) AS error_detail
        FROM all_urls WHERE page_id % 2 = 0 GROUP BY url""",
    "fetched_once": """
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, pos) AS rn FROM fetched) WHERE rn = 1""",
    "entries": """
        SELECT u.page_id, u.pos, u.url,
               CASE WHEN c.url IS NOT NULL THEN c.title WHEN s.title IS NOT NULL THEN s.title WHEN f.url IS NOT NULL THEN f.title
                    ELSE '[UNRESOLVED]' END AS title,
               CASE WHEN c.url IS NOT NULL THEN c.status WHEN s.title IS NOT NULL THEN s.status WHEN f.url IS NOT NULL THEN f.status
                    ELSE 'unresolved' END AS status,
               CASE WHEN c.url IS NOT NULL THEN c.http_code WHEN s.title IS NULL THEN f.http_code END AS http_code,
               CASE WHEN c.url IS NOT NULL THEN c.content_type WHEN s.title IS NULL THEN f.content_type END AS content_type,
               CAST(NULL AS VARCHAR) AS final_url,
               CASE WHEN c.url IS NULL AND s.title IS NULL THEN f.error_detail END AS error_detail,
               CASE WHEN c.url IS NOT NULL THEN 'cache' WHEN s.title IS NOT NULL THEN 'special' WHEN f.url IS NOT NULL THEN 'fetch'
                    ELSE 'none' END AS origin
        FROM all_urls u LEFT JOIN cached c USING (url) LEFT JOIN special s USING (url) LEFT JOIN fetched_once f USING (url)""",
}
_ROLLUP = f"""
    SELECT page_id, count(*) AS sources_count, count(*) FILTER (status = 'ok') AS resolved_count,
           count(*) FILTER (status IN {listed(DEAD_STATUSES)}) AS dead_count, count(*) FILTER (status = 'blocked') AS blocked_count,
           count(*) FILTER (status = 'non_html') AS non_html_count
    FROM entries GROUP BY 1"""
_ENTRY_COLUMNS = ", ".join(ops.ENTRY)


def flag(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("int") for n in names})


def special(v: Lenses) -> DataFrame:
    return urls.with_special_title(cleaned(v).select("url").distinct())


def rollup(v: Lenses) -> DataFrame:
    return ops.report_rollup(entries(v), "page_id")


def nested_sources(v: Lenses) -> DataFrame:
    nested = ops.nest_report_sources(entries(v), "page_id")
    return nested.select(
        "page_id", F.size("sources").cast("long").alias("n"), F.element_at("sources", 1)["url"].alias("first_url"),
        F.element_at("sources", -1)["title"].alias("last_title"),
    )


_ATTEMPT_ROWS = """
    SELECT url, page_id, pos, 1 AS attempt, http_code, failure FROM fetch_log
    UNION ALL SELECT url, page_id, pos, 2, CASE page_id % 3 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 200 END, failure
    FROM fetch_log WHERE http_code IN (429, 503)
    UNION ALL SELECT url, page_id, pos, 3, 404, failure FROM fetch_log WHERE http_code IN (429, 503) AND page_id % 3 = 1"""

QUERIES = {
    "extract_links": (
        lambda v: flag(ops.extract_links(v.linked_pages, ["page_id"]), "parent_marked", "in_list"),
        with_views("""
        SELECT page_id, pos, href, link_text, CAST(link_text LIKE '[%' OR (page_id + pos) % 17 = 0 AS INT) AS parent_marked, 1 AS in_list
        FROM links""", "links")),
    "extract_page_links": (lambda v: flag(ops.extract_links(v.table("pages"), ["page_id"]), "parent_marked", "in_list"), None),
    "extract_footnote_links": (
        lambda v: ops.extract_footnote_links(v.linked_pages, ["page_id"]).select("page_id", "pos", "href", "link_text"),
        with_views("SELECT page_id, pos, href, link_text FROM links", "links")),
    "select_footnote_links": (
        lambda v: ops.select_footnote_links(v.links, "page_id").select("page_id", "pos", "href"),
        with_views("SELECT page_id, pos, href FROM chosen", "links", extra={"chosen": _CHOSEN})),
    "clean_url": (cleaned, with_views(_CLEANED, "links")),
    "valid_url": (
        lambda v: flag(cleaned(v).withColumn("valid", urls.is_valid_url(F.col("url"))), "valid"),
        with_views(f"SELECT *, CAST({_VALID} AS INT) AS valid FROM c", "links", extra={"c": _CLEANED})),
    "url_domain": (
        lambda v: cleaned(v).withColumn("domain", urls.url_domain(F.col("url"))),
        with_views(f"SELECT *, {_DOMAIN.format('url')} AS domain FROM c", "links", extra={"c": _CLEANED})),
    "domain_in_set": (
        lambda v: flag(cleaned(v).withColumns({"internal": urls.is_internal(F.col("url")), "blocked": urls.is_blocked_domain(F.col("url"))}),
                       "internal", "blocked"),
        with_views(f"""SELECT page_id, pos, url, CAST({in_domains('d', INTERNAL_DOMAINS)} AS INT) AS internal,
                              CAST({in_domains('d', BLOCKED_DOMAINS)} AS INT) AS blocked
                       FROM (SELECT *, {_DOMAIN.format('url')} AS d FROM c)""", "links", extra={"c": _CLEANED})),
    "non_html_url": (
        lambda v: flag(cleaned(v).withColumn("non_html", urls.is_non_html(F.col("url"))), "non_html"),
        with_views(f"SELECT *, CAST({_FILE} AS INT) AS non_html FROM c", "links", extra={"c": _CLEANED})),
    "unique_report_urls": (chosen_urls, with_views(
        "SELECT * FROM unique_urls", "links", extra={"chosen": _CHOSEN, "unique_urls": _UNIQUE})),
    "special_title": (special, with_views(_SPECIAL.format(source="c"), "links", extra={"c": _CLEANED})),
    "classify_fetch": (fetched, with_views(_FETCHED, "fetch_log")),
    "collapse_attempts": (
        lambda v: ops.collapse_attempts(attempts(v)).select("url", "page_id", "pos", "http_code", "failure", "last_error"),
        with_views("""
        SELECT url, page_id, pos, http_code, failure, coalesce(last_error, '') AS last_error
        FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY attempt DESC, page_id DESC, pos DESC) AS rn,
                     arg_max(error, CASE WHEN error IS NOT NULL THEN attempt END) OVER (PARTITION BY url) AS last_error
              FROM (SELECT *, CASE WHEN failure = 'timeout' THEN 'Timeout' WHEN failure = 'connection' THEN 'Connection error: reset by peer'
                                   WHEN http_code >= 500 THEN concat('HTTP ', http_code) END AS error FROM tries))
        WHERE rn = 1""", "fetch_log", extra={"tries": _ATTEMPT_ROWS})),
    "resolve_with_cache": (entries, with_views("SELECT * FROM entries", "links", "fetch_log", extra=ENTRY_VIEWS)),
    "upsert_cache": (
        lambda v: ops.upsert_cache(cache(v), stored(entries(v), "source_entries")),
        with_views(f"""
        SELECT * FROM cached UNION ALL
        SELECT DISTINCT {_ENTRY_COLUMNS} FROM entries WHERE url NOT IN (SELECT url FROM cached)""", "links", "fetch_log", extra=ENTRY_VIEWS)),
    "upsert_cache_forced": (
        lambda v: ops.upsert_cache(cache(v), fetched_by_url(v), force=True),
        with_views(f"""
        SELECT {_ENTRY_COLUMNS} FROM fetched_once UNION ALL
        SELECT * FROM cached WHERE url NOT IN (SELECT url FROM fetched_once)""", "links", "fetch_log", extra=ENTRY_VIEWS)),
    "report_rollup": (rollup, with_views(_ROLLUP, "links", "fetch_log", extra=ENTRY_VIEWS)),
    "nest_report_sources": (nested_sources, with_views("""
        SELECT page_id, count(*) AS n, arg_min(url, pos) AS first_url, arg_max(title, pos) AS last_title
        FROM entries GROUP BY 1""", "links", "fetch_log", extra=ENTRY_VIEWS)),
    "process_rollup": (
        lambda v: ops.process_rollup(rollup(v), v.table("pages"), "page_id", v.table("pages").where("page_id % 9 = 4")),
        with_views("""
        SELECT count(*) AS total_reports, count(*) FILTER (page_id % 9 <> 4) AS processed, count(*) FILTER (page_id % 9 = 4) AS skipped,
        """ + ", ".join(f"CAST(coalesce(sum({c}_count) FILTER (page_id % 9 <> 4), 0) AS BIGINT) AS {name}" for name, c in (
            ("total_sources", "sources"), ("resolved", "resolved"), ("dead", "dead"), ("blocked", "blocked"), ("non_html", "non_html")))
        + " FROM pages LEFT JOIN roll USING (page_id)", "links", "fetch_log", extra={**ENTRY_VIEWS, "roll": _ROLLUP})),
    "status_breakdown": (
        lambda v: round_columns(ops.status_breakdown(entries(v)), "pct"),
        with_views("SELECT status, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM entries), 6) AS pct FROM entries GROUP BY 1",
                   "links", "fetch_log", extra=ENTRY_VIEWS)),
    "top_domains": (
        lambda v: ops.top_domains(all_urls(v)),
        with_views(f"""SELECT * FROM (SELECT {_DOMAIN.format('url')} AS domain, count(*) AS n FROM all_urls GROUP BY 1)
                       WHERE domain <> '' ORDER BY n DESC, domain LIMIT 20""", "links", "fetch_log", extra=URL_VIEWS)),
}
