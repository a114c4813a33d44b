"""Daily reports: candidate addresses, text, status, coverage and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.constants import (
    BLOCKS_PER_TRIGGER,
    ESCALATION_LEXICON,
    MIN_HTML_LENGTH,
    MIN_TEXT_LENGTH,
    MONTHS,
    REPORT_URL_PATTERNS,
    VALIDATION_PHRASE,
)
from regionhour.functions.markup import content_text
from regionhour.functions.text import clean_text, words
from regionhour.operators.running import percent_rank_by_value, running_totals

PRESENT = "_present"


def date_spine(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Every day from start to end, both included."""
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return spark.range(1).select(F.explode(days).alias("report_date"))


def spine_between(reports: DataFrame) -> DataFrame:
    """Every day between the first and the last report."""
    return reports.agg(F.min("report_date").alias("lo"), F.max("report_date").alias("hi")).select(
        F.explode(F.sequence("lo", "hi")).alias("report_date")
    )


def missing_report_dates(spine: DataFrame, reports: DataFrame) -> DataFrame:
    return spine.join(reports.select("report_date"), "report_date", "left_anti")


def candidate_urls(dates: DataFrame, patterns: list[str] = REPORT_URL_PATTERNS) -> DataFrame:
    """One row per date and address pattern, in the order the patterns are tried.

    The patterns are a fixed array, so each date row expands in place.
    """
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("report_date"))
    fields = {
        "{month}": month,
        "{day}": F.dayofmonth("report_date").cast("string"),
        "{day_padded}": F.date_format("report_date", "dd"),
        "{year}": F.year("report_date").cast("string"),
    }

    def filled(pattern: str) -> Column:
        return reduce(lambda url, kv: F.replace(url, F.lit(kv[0]), kv[1]), fields.items(), F.lit(pattern))

    options = F.array(*[F.struct(F.lit(i).alias("priority"), filled(p).alias("url")) for i, p in enumerate(patterns)])
    return dates.select("report_date", F.explode(options).alias("option")).select("report_date", "option.*")


def first_successful_candidate(candidates: DataFrame, captures: DataFrame) -> DataFrame:
    """Per date the first address with a captured page; otherwise not found at the first address.

    The choice is made on addresses alone; only the chosen page is then fetched
    from the captures. Of several captures of one address the least page counts, so reruns agree.
    """
    pages = captures.where(F.col("html").isNotNull()).groupBy("url").agg(F.min("html").alias("html"))
    tried = candidates.join(pages.select("url", F.lit(True).alias("hit")), "url", "left")
    chosen = tried.groupBy("report_date").agg(
        F.coalesce(F.min_by("url", F.when(F.col("hit"), F.col("priority"))), F.min_by("url", "priority")).alias("url"),
        F.coalesce(F.max("hit"), F.lit(False)).alias("found"),
    )
    return chosen.join(pages, "url", "left").select("report_date", "url", "html", "found")


def extract_report_text(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Add the cleaned text of the main content; null where a page has none."""
    return pages.withColumn(text, clean_text(content_text(F.col(html))))


def mark_present(reports: DataFrame, existing: DataFrame) -> DataFrame:
    """Add whether a report of the date exists already."""
    dates = existing.select("report_date").distinct().withColumn(PRESENT, F.lit(True))
    return reports.join(dates, "report_date", "left").withColumn(PRESENT, F.coalesce(PRESENT, F.lit(False)))


def classify_report(
    reports: DataFrame, existing: DataFrame | None = None, force: bool = False, phrase: str = VALIDATION_PHRASE
) -> DataFrame:
    """Add status, reason and text length. Dates in ``existing``, or marked as present before, are skipped unless ``force``."""
    html, text = F.col("html"), F.col("text")
    size = F.coalesce(F.length(text), F.lit(0))
    if existing is not None and not force:
        reports = mark_present(reports, existing)
    present = F.col(PRESENT) if PRESENT in reports.columns and not force else F.lit(False)

    too_short_page = F.length(html) < MIN_HTML_LENGTH
    too_short_text = size < MIN_TEXT_LENGTH
    no_phrase = ~F.contains(F.lower(text), F.lit(phrase.lower()))
    status = (
        F.when(present, "skipped")
        .when(html.isNull(), "not_found")
        .when(too_short_page | too_short_text | no_phrase, "no_content")
        .otherwise("ok")
    )
    reason = (
        F.when(present | html.isNull(), "")
        .when(too_short_page, F.concat(F.lit("HTML only "), F.length(html).cast("string"), F.lit(" bytes")))
        .when(too_short_text, F.concat(F.lit("Text "), size.cast("string"), F.lit(" chars")))
        .when(no_phrase, "Missing validation phrase — possibly blocked")
        .otherwise("")
    )
    return (
        reports.withColumns({"status": status, "error_message": reason})
        .withColumn("chars", F.when(F.col("status") == "ok", size).otherwise(0))
        .drop(PRESENT)
    )


def report_document(classified: DataFrame) -> DataFrame:
    """The stored form of accepted reports."""
    return classified.where(F.col("status") == "ok").select(
        F.date_format("report_date", "yyyy-MM-dd").alias("date"), "url", "status",
        F.length("text").alias("char_count"), "text",
    )


def scrape_status_rollup(results: DataFrame) -> DataFrame:
    """Results per status; a status outside the four known ones is an error."""
    known = ["ok", "skipped", "not_found", "no_content"]
    status = F.col("status")
    other = ~F.coalesce(status.isin(known), F.lit(False))
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == s).alias(s) for s in known],
        F.count_if(other).alias("error"),
        F.count_if(status.isin("not_found", "no_content") | other).alias("failed"),
    )


def failed_dates_head(results: DataFrame, k: int = 20) -> DataFrame:
    """First failed dates in order, each with the number of failures not listed."""
    failed = results.where(F.col("status").isin("not_found", "no_content", "error")).select("report_date", "status")
    remaining = failed.agg(F.greatest(F.count(F.lit(1)) - k, F.lit(0)).alias("n")).scalar()
    return failed.orderBy("report_date").limit(k).withColumn("not_listed", remaining)


def block_runs(results: DataFrame, every: int = BLOCKS_PER_TRIGGER) -> DataFrame:
    """Runs of consecutive blocked results in date order and how often each run triggers a pause.

    Positions are running totals over yearly chunks, so a long history is never
    sorted in one task.
    """
    blocked = (F.col("status") == "no_content") & F.contains(F.lower("error_message"), F.lit("blocked"))
    flagged = results.select("report_date", F.coalesce(blocked, F.lit(False)).alias("blocked"))
    placed = running_totals(
        flagged,
        {"position": F.lit(1), "blocked_so_far": F.col("blocked").cast("int")},
        ["report_date"], F.year("report_date"), [],
    )
    return (
        placed.where("blocked")
        .groupBy((F.col("position") - F.col("blocked_so_far")).alias("run"))
        .agg(F.min("report_date").alias("run_start"), F.max("report_date").alias("run_end"), F.count(F.lit(1)).alias("length"))
        .withColumn("triggers", F.floor(F.col("length") / every))
        .drop("run")
    )


def latest_report_asof(days: DataFrame, reports: DataFrame) -> DataFrame:
    """Per day its own report, else the one of the day before; where ``reports`` has a status, only an accepted or stored one.

    Each report serves two days, so it is offered to both and the nearer one wins.
    """
    if "status" in reports.columns:
        reports = reports.where(F.col("status").isin("ok", "skipped"))
    offers = reports.select(
        "report_date", "url", F.explode(F.array(F.lit(0), F.lit(1))).alias("age_days")
    ).select(
        F.date_add("report_date", F.col("age_days")).alias("as_of"), "report_date", "url", "age_days"
    )
    best = offers.groupBy("as_of").agg(F.min(F.struct("age_days", "report_date", "url")).alias("best"))
    return days.join(best, days["report_date"] == best["as_of"], "left").select(
        days["report_date"].alias("as_of"),
        F.col("best.report_date").alias("report_date"), F.col("best.url").alias("url"),
        F.col("best.age_days").alias("age_days"),
    )


def report_to_hours(reports: DataFrame) -> DataFrame:
    """Each report on the 24 hours of its day."""
    return reports.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))


def tokenize_daily(reports: DataFrame) -> DataFrame:
    """Words per day with their counts."""
    return (
        reports.select("report_date", F.explode(words(F.col("text"))).alias("token"))
        .groupBy("report_date", "token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def escalation_score(tokens: DataFrame, lexicon: list[str] = ESCALATION_LEXICON) -> DataFrame:
    """Daily score from 1 to 10: the day's rank by lexicon words per 1000 words.

    The source material only announces such a score; this definition is ours.
    """
    daily = tokens.groupBy("report_date").agg(
        F.sum("n").alias("tokens"),
        F.sum(F.when(F.col("token").isin(lexicon), F.col("n")).otherwise(0)).alias("hits"),
    ).withColumn("per_1000", F.round(F.col("hits") * 1000.0 / F.col("tokens"), 6))
    return percent_rank_by_value(daily, "per_1000").withColumn("score", 1 + 9 * F.col("pct_rank")).drop("pct_rank")
