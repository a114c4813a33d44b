"""Address rules for report links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.constants import (
    BLOCKED_DOMAINS,
    INTERNAL_DOMAINS,
    NON_HTML_EXTENSIONS,
    TELEGRAM_RESERVED,
    X_DOMAINS,
    X_PROFILE_RESERVED,
    X_RESERVED,
)
from regionhour.functions.text import strip

_SCHEME = r"(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?"
# A host holds both kinds of bracket or none.
_HOST = r"(?:[^/?#\[\]]{least}|(?=[^/?#]*\[)(?=[^/?#]*\])[^/?#]+)(?=[/?#]|\z)"


def clean_url(href: Column) -> Column:
    """Trim, cut the fragment, then trailing punctuation, then trailing slashes."""
    text = F.substring_index(strip(href), "#", 1)
    text = F.regexp_replace(text, r"[.,;:)}\]]+\z", "")
    return F.rtrim(text, F.lit("/"))


def _one_line(url: Column) -> Column:
    return F.regexp_replace(url, r"\A[\x00-\x20]+|[\t\r\n]", "")


def url_domain(url: Column) -> Column:
    """Host with user part and port, lower-cased; blank when there is none or a bracket is open."""
    return F.lower(F.regexp_extract(_one_line(url), rf"\A{_SCHEME}//({_HOST.replace('{least}', '*')})", 1))


def is_valid_url(url: Column) -> Column:
    pattern = rf"\A(?i:https?)://{_HOST.replace('{least}', '+')}"
    return F.coalesce(_one_line(url).rlike(pattern), F.lit(False))


def _listed(domains: list[str]) -> str:
    """Pattern of the listed domains and everything below them."""
    return r"(?:[^/?#]*\.)?(?:" + "|".join(d.replace(".", r"\.") for d in domains) + ")"


def domain_in(domain: Column, listed: list[str]) -> Column:
    """Equal to a listed domain or below one; one match, whatever the length of the list."""
    return domain.rlike(rf"\A{_listed(listed)}\z")


def is_internal(url: Column) -> Column:
    return domain_in(url_domain(url), INTERNAL_DOMAINS)


def is_blocked_domain(url: Column) -> Column:
    return domain_in(url_domain(url), BLOCKED_DOMAINS)


def url_path(url: Column) -> Column:
    """Path without query, fragment and parameters of its last segment."""
    path = F.regexp_extract(_one_line(url), rf"\A{_SCHEME}(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*\z", "")


def path_is_file(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(NON_HTML_EXTENSIONS) + r")\z")


def is_non_html(url: Column) -> Column:
    return path_is_file(url_path(url))


def with_special_title(df: DataFrame, url: str = "url", title: str = "title", status: str = "status") -> DataFrame:
    """Add title and status of addresses that need no fetch, else nulls.

    The order of the rules matters: messenger, short-post site, blocked domain,
    file. The messenger test is a substring test on the domain. The parts are
    taken in steps, so each pattern runs once per row.
    """
    address = F.col(url)
    channel_pattern = r"(?U)t\.me/(?:s/)?([a-zA-Z0-9_]+)(?:/(\d+))?"
    post_pattern = r"(?U)(?:x|twitter)\.com/(?:#!/)?(\w+)/status(?:es)?/(\d+)"
    parts = df.withColumns({
        "_domain": url_domain(address),
        "_path": url_path(address),
        "_channel": F.regexp_extract(address, channel_pattern, 1),
        "_post": F.regexp_extract(address, channel_pattern, 2),
        "_author": F.regexp_extract(address, post_pattern, 1),
        "_number": F.regexp_extract(address, post_pattern, 2),
        "_profile": F.regexp_extract(address, r"(?U)(?:x|twitter)\.com/(\w+)", 1),
    })

    def named(part: str, reserved: list[str]) -> Column:
        return (F.col(part) != "") & ~F.lower(part).isin(reserved)

    domain = F.col("_domain")
    rules = parts.withColumns({
        "_messenger": F.contains(domain, F.lit("t.me")) | F.contains(domain, F.lit("telegram")),
        "_short": domain.isin(X_DOMAINS),
        "_blocked": domain_in(domain, BLOCKED_DOMAINS),
        "_file": path_is_file(F.col("_path")),
        "_channel_ok": named("_channel", TELEGRAM_RESERVED),
        "_author_ok": named("_author", X_RESERVED),
        "_profile_ok": (F.col("_author") == "") & named("_profile", X_PROFILE_RESERVED),
    })
    post = F.when(F.col("_post") != "", F.format_string(" (Post %s)", "_post")).otherwise("")
    suffix = F.upper(F.regexp_extract("_path", r"[^/](\.[^./]+)\z", 1))
    messenger, short, blocked, file_link = map(F.col, ("_messenger", "_short", "_blocked", "_file"))
    accepted = F.col("_author_ok") | F.col("_profile_ok")
    titled = rules.withColumns({
        title: F.when(messenger & F.col("_channel_ok"), F.format_string("[Telegram: @%s%s]", "_channel", post))
        .when(messenger, "[Telegram]")
        .when(short & F.col("_author_ok"), F.format_string("[X: @%s (Tweet %s)]", "_author", "_number"))
        .when(short & F.col("_profile_ok"), F.format_string("[X: @%s]", "_profile"))
        .when(short, "[X]")
        .when(blocked, F.format_string("[BLOCKED: %s]", "_domain"))
        .when(file_link, F.format_string("[NON-HTML: %s]", suffix)),
        status: F.when(messenger, F.when(F.col("_channel_ok"), "ok").otherwise("blocked"))
        .when(short, F.when(accepted, "ok").otherwise("blocked"))
        .when(blocked, "blocked")
        .when(file_link, "non_html"),
    })
    return titled.select(*df.columns, title, status)
