"""Source references: extraction, selection, classification, cache and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from regionhour.constants import (
    DEAD_STATUSES,
    FOOTNOTE_MARK,
    MAX_ATTEMPTS,
    MAX_RESPONSE_BYTES,
    NON_HTML_CONTENT_TYPES,
    REQUEST_TIMEOUT_SECONDS,
)
from regionhour.functions.markup import content_links
from regionhour.functions.text import with_page_title
from regionhour.functions.urls import clean_url, is_internal, is_valid_url, url_domain, with_special_title

ENTRY = ["url", "title", "status", "http_code", "content_type", "final_url", "error_detail"]


def extract_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per link of the page's source section."""
    return pages.select(*keys, F.explode(content_links(F.col(html))).alias("link")).select(*keys, "link.*")


def _is_marked(link_text: Column, parent_marked: Column, in_list: Column) -> Column:
    """A footnote mark opens the link's text or stands beside it, or the link is in a list."""
    return F.coalesce(link_text.rlike(r"(?U)\A" + FOOTNOTE_MARK), F.lit(False)) | parent_marked | in_list


def extract_footnote_links(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Links marked as footnotes, straight from pages; all links of a page that has none.

    The choice is made on the page's own array of links: each page is parsed
    once and nothing is shuffled.
    """
    def marked(link: Column) -> Column:
        return _is_marked(link["link_text"], link["parent_marked"], link["in_list"])

    parsed = pages.select(*keys, content_links(F.col(html)).alias("links"))
    chosen = F.when(F.exists("links", marked), F.filter("links", marked)).otherwise(F.col("links"))
    return parsed.select(*keys, F.explode(chosen).alias("link")).select(*keys, "link.*")


def select_footnote_links(links: DataFrame, report: str) -> DataFrame:
    """The same choice over a stored table of links.

    Reports with a mark are found by a combined aggregate and taken out of the
    rest by an anti join, so no report is gathered in one window.
    """
    marked = _is_marked(F.col("link_text"), F.col("parent_marked"), F.col("in_list"))
    flagged = links.withColumn("_marked", marked)
    chosen = flagged.where("_marked")
    rest = flagged.where("not _marked").join(chosen.select(report).distinct(), report, "left_anti")
    return chosen.unionByName(rest).drop("_marked")


def unique_report_urls(links: DataFrame, report: str) -> DataFrame:
    """Clean, valid, external addresses per report, each at its first position."""
    cleaned = links.select(report, "pos", clean_url(F.col("href")).alias("url"))
    kept = cleaned.where(is_valid_url(F.col("url")) & ~is_internal(F.col("url")))
    return kept.groupBy(report, "url").agg(F.min("pos").alias("pos"))


def _is_file_type() -> Column:
    prefixes = "^(?:" + "|".join(NON_HTML_CONTENT_TYPES) + ")"
    return F.coalesce(F.lower("content_type").rlike(prefixes), F.lit(False))


def _is_too_large() -> Column:
    return F.coalesce(F.col("content_length") > MAX_RESPONSE_BYTES, F.lit(False))


def body_to_title(log: DataFrame) -> DataFrame:
    """Replace ``body`` by ``page_title``, read where a title will be asked for.

    Bodies are the bulk of a log; done first, they are never shuffled.
    """
    readable = F.col("failure").isNull() & (F.col("http_code") == 200)
    if "content_type" in log.columns:
        readable = readable & ~_is_file_type() & ~_is_too_large()
    shown = log.withColumn("_body", F.coalesce(F.when(readable, F.col("body")), F.lit("")))
    return with_page_title(shown, "_body", "page_title").drop("_body", "body")


def collapse_attempts(log: DataFrame) -> DataFrame:
    """Last attempt per address, with the last retryable error seen up to then; a log may hold any number of attempts."""
    error = (
        F.when(F.col("failure") == "timeout", "Timeout")
        .when(F.col("failure") == "connection", F.concat(F.lit("Connection error: "), F.substring("failure_detail", 1, 80)))
        .when(F.col("http_code") >= 500, F.concat(F.lit("HTTP "), F.col("http_code").cast("string")))
    )
    if "body" in log.columns:
        log = body_to_title(log)
    kept = [c for c in log.columns if c not in ("url", "attempt")]
    return log.withColumn("_error", error).groupBy("url").agg(
        F.max(F.struct("attempt", *kept)).alias("last"),
        F.max_by("_error", F.when(F.col("_error").isNotNull(), F.col("attempt"))).alias("last_error"),
    ).select("url", *[F.col("last")[c].alias(c) for c in kept], F.coalesce("last_error", F.lit("")).alias("last_error"))


def classify_fetch(log: DataFrame) -> DataFrame:
    """Source entry of each captured fetch: one ordered chain of rules over the log.

    ``log`` has url, http_code, content_type, content_length, failure,
    failure_detail, final_url and body, or the form ``collapse_attempts`` gives it.
    """
    if "body" in log.columns:
        log = body_to_title(log)
    if "last_error" not in log.columns:
        log = log.withColumn(
            "last_error",
            F.when(F.col("http_code") >= 500, F.concat(F.lit("HTTP "), F.col("http_code").cast("string"))).otherwise(""),
        )
    failure, code = F.col("failure"), F.col("http_code")
    raw_type = F.coalesce("content_type", F.lit(""))
    kind = F.trim(F.substring_index(raw_type, ";", 1))
    retried_out = (code == 429) | (code >= 500)

    rules = [
        (failure == "redirects", "[REDIRECT LOOP]", "redirect_loop"),
        (failure == "ssl", "[SSL ERROR]", "error"),
        (failure == "timeout", "[TIMEOUT]", "timeout"),
        (failure == "connection", "[CONNECTION ERROR]", "connection_error"),
        (failure == "request", "[REQUEST ERROR]", "error"),
        (failure.isNotNull() | code.isNull(), "[CRITICAL PARSE ERROR]", "error"),
        (_is_file_type(), F.concat(F.lit("[NON-HTML: "), kind, F.lit("]")), "non_html"),
        (_is_too_large(), "[TOO LARGE]", "non_html"),
        (code == 404, "[DEAD LINK]", "dead_link"),
        (code == 410, "[GONE]", "dead_link"),
        (code == 403, "[ACCESS DENIED]", "blocked"),
        (code == 451, "[UNAVAILABLE FOR LEGAL REASONS]", "blocked"),
        (retried_out, F.concat(F.lit("[FAILED: "), F.col("last_error"), F.lit("]")), "error"),
        (code != 200, F.concat(F.lit("[HTTP "), code.cast("string"), F.lit("]")), "error"),
    ]
    rule = F.lit(len(rules))
    for i in range(len(rules) - 1, -1, -1):
        rule = F.when(rules[i][0], i).otherwise(rule)
    numbered = log.withColumn("_rule", rule)

    def by_rule(values: list, default: Column | str) -> Column:
        chain = F.when(F.col("_rule") == 0, values[0])
        for i, value in enumerate(values[1:], start=1):
            chain = chain.when(F.col("_rule") == i, value)
        return chain.otherwise(default)

    after_retries = F.col("_rule") == 12
    failed = F.col("_rule") <= 5
    detail = (
        F.when(failed & (failure == "redirects"), "Too many redirects")
        .when(failed & (failure == "timeout"), f"Timeout after {REQUEST_TIMEOUT_SECONDS}s")
        .when(failed, F.substring("failure_detail", 1, 100))
        .when(F.col("_rule") == 7, F.concat(F.lit("Content-Length: "), F.col("content_length").cast("string")))
        .when(after_retries, F.concat(F.lit(f"Failed after {MAX_ATTEMPTS} retries: "), F.col("last_error")))
    )
    keeps_type = F.col("_rule").isin(6, len(rules))
    keeps_final = F.col("_rule").isin(6, 8, 9, 10, 11, 13, len(rules))
    final = F.when(F.col("final_url") != F.col("url"), F.col("final_url"))
    carried = [c for c in log.columns if c not in (*ENTRY, "failure", "failure_detail", "content_length", "page_title", "last_error")]
    return numbered.select(
        *carried, "url",
        by_rule([title for _, title, _ in rules], F.col("page_title")).alias("title"),
        by_rule([status for _, _, status in rules], "ok").alias("status"),
        F.when(~failed & ~after_retries, code).alias("http_code"),
        F.when(keeps_type, F.nullif(kind, F.lit(""))).alias("content_type"),
        F.when(keeps_final, final).alias("final_url"),
        F.nullif(detail, F.lit("")).alias("error_detail"),
    )


def special_entries(urls: DataFrame) -> DataFrame:
    """Entries of addresses that need no fetch."""
    return with_special_title(urls.select("url")).where(F.col("title").isNotNull())


def one_entry_per_url(entries: DataFrame) -> DataFrame:
    """The least entry of each address, fields compared in order, so that reruns agree."""
    least = F.min(F.struct(*[c for c in ENTRY if c != "url"])).alias("_entry")
    return entries.groupBy("url").agg(least).select("url", "_entry.*")


def resolve_with_cache(urls: DataFrame, cache: DataFrame, fetched: DataFrame, force: bool = False) -> DataFrame:
    """Entry of each address: cached (unless ``force``), else special, else fetched, else unresolved.

    Of several cached or fetched rows of one address the least entry counts. The first rule
    that applies decides every field of the entry.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return one_entry_per_url(df).select("url", F.struct(*[c for c in ENTRY if c != "url"]).alias(name))

    nothing = F.lit(None).cast("string")
    titled = with_special_title(urls, "url", "_special_title", "_special_status")
    title, status = F.col("_special_title"), F.col("_special_status")
    joined = titled.join(side(fetched, "_fetched"), "url", "left")
    known = F.lit(None).cast(side(cache, "_c").schema["_c"].dataType)
    if not force:
        joined = joined.join(side(cache, "_cached"), "url", "left")
        known = F.col("_cached")
    from_cache = known.isNotNull()
    special = F.struct(
        title.alias("title"), status.alias("status"), F.lit(None).cast("int").alias("http_code"),
        nothing.alias("content_type"), nothing.alias("final_url"), nothing.alias("error_detail"),
    )
    unresolved = F.struct(
        F.lit("[UNRESOLVED]").alias("title"), F.lit("unresolved").alias("status"), F.lit(None).cast("int").alias("http_code"),
        nothing.alias("content_type"), nothing.alias("final_url"), nothing.alias("error_detail"),
    )
    entry = (
        F.when(from_cache, known)
        .when(title.isNotNull(), special)
        .when(F.col("_fetched").isNotNull(), F.col("_fetched"))
        .otherwise(unresolved)
    )
    origin = (
        F.when(from_cache, "cache").when(title.isNotNull(), "special")
        .when(F.col("_fetched").isNotNull(), "fetch").otherwise("none")
    )
    return joined.select(*urls.columns, entry.alias("_entry"), origin.alias("origin")).select(
        *urls.columns, "_entry.*", "origin"
    )


def upsert_cache(cache: DataFrame, entries: DataFrame, force: bool = False) -> DataFrame:
    """Next version of the cache, one row per address; ``force`` lets new entries replace old ones.

    Of several entries of one address the least counts.
    """
    fresh, known = one_entry_per_url(entries), one_entry_per_url(cache)
    if force:
        return known.join(fresh.select("url"), "url", "left_anti").unionByName(fresh)
    return known.unionByName(fresh.join(known.select("url"), "url", "left_anti"))


def report_rollup(entries: DataFrame, report: str) -> DataFrame:
    """Counts per report. Some statuses belong to no bucket, so buckets need not add up."""
    status = F.col("status")
    return entries.groupBy(report).agg(
        F.count(F.lit(1)).alias("sources_count"),
        F.count_if(status == "ok").alias("resolved_count"),
        F.count_if(status.isin(DEAD_STATUSES)).alias("dead_count"),
        F.count_if(status == "blocked").alias("blocked_count"),
        F.count_if(status == "non_html").alias("non_html_count"),
    )


def nest_report_sources(entries: DataFrame, report: str) -> DataFrame:
    """One document per report: its sources as an array in the order of ``pos``.

    The long table ``entries`` (report, pos, fields) is the form without a size limit;
    a document holds what one page lists.
    """
    return (
        entries.groupBy(report)
        .agg(F.array_sort(F.collect_list(F.struct("pos", *ENTRY))).alias("_ordered"))
        .select(report, F.transform("_ordered", lambda s: F.struct(*[s[c].alias(c) for c in ENTRY])).alias("sources"))
    )


def report_sources(reports: DataFrame, entries: DataFrame, report: str) -> DataFrame:
    """Documents per report: counters and sources; a report without sources keeps an empty array."""
    counts = report_rollup(entries, report)
    nested = nest_report_sources(entries, report)
    zero = ["sources_count", "resolved_count", "dead_count", "blocked_count", "non_html_count"]
    return (
        reports.join(counts, report, "left").fillna(0, zero)
        .join(nested, report, "left")
        .withColumn("sources", F.coalesce("sources", F.array().cast(nested.schema["sources"].dataType)))
    )


def process_rollup(rollups: DataFrame, reports: DataFrame, report: str, existing: DataFrame | None = None) -> DataFrame:
    """Totals over reports. Those with output in ``existing`` are skipped; all others are processed, also without sources."""
    sums = {
        "total_sources": "sources_count", "resolved": "resolved_count", "dead": "dead_count",
        "blocked": "blocked_count", "non_html": "non_html_count",
    }
    seen, done = reports.select(report).join(rollups, report, "left"), F.lit(False)
    if existing is not None:
        seen = seen.join(existing.select(report).distinct().withColumn("_done", F.lit(True)), report, "left")
        done = F.coalesce("_done", F.lit(False))
    return seen.agg(
        F.count(F.lit(1)).alias("total_reports"),
        F.count_if(~done).alias("processed"),
        F.count_if(done).alias("skipped"),
        *[F.coalesce(F.sum(F.when(~done, F.col(c))), F.lit(0)).alias(name) for name, c in sums.items()],
    )


def status_breakdown(entries: DataFrame) -> DataFrame:
    """Count and share per status, largest first. The window runs over one row per status."""
    counts = entries.groupBy(F.coalesce("status", F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("pct", F.col("n") * 100.0 / total).orderBy(F.desc("n"), "status")


def top_domains(entries: DataFrame, k: int = 20) -> DataFrame:
    named = entries.select(url_domain(F.col("url")).alias("domain")).where(F.col("domain") != "")
    return named.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "domain").limit(k)
