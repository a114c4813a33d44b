"""Text rules for report pages.

Whitespace and digits are meant in the Unicode sense. Whitespace is spelled out,
which is faster than a class with ``(?U)`` and includes the separators x1c-x1f.
"""

from __future__ import annotations

import html as html_entities
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from regionhour.constants import (
    BLOCK_MARKER_WINDOW,
    BLOCK_MARKERS,
    CHAR_EXPANSIONS,
    CHAR_REPLACEMENTS,
    CHARS_REMOVED,
    TITLE_LIMIT,
)

_BLANKS = r"\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE = rf"[\t-\r{_BLANKS}]"
NOT_SPACE = rf"[^\t-\r{_BLANKS}]"
SPACE_IN_LINE = rf"[\t\x0b-\r{_BLANKS}]"
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACES))


@F.pandas_udf(StringType())
def _nfkd(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKD", t), na_action="ignore")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html_entities.unescape, na_action="ignore")


def decompose(c: Column) -> Column:
    """NFKD form. Plain ASCII text is already in it and is not sent to Python."""
    return F.coalesce(_nfkd(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def unescape(c: Column) -> Column:
    """Character references resolved; only text with an ampersand goes to Python."""
    return F.coalesce(_unescape(F.when(F.contains(c, F.lit("&")), c)), c)


def replace_characters(c: Column) -> Column:
    """Dashes, quotes, bullets and invisible characters in plain form."""
    plain = F.translate(
        c,
        "".join([*CHAR_REPLACEMENTS, *CHARS_REMOVED]),
        "".join(CHAR_REPLACEMENTS.values()),
    )
    return reduce(lambda t, kv: F.replace(t, F.lit(kv[0]), F.lit(kv[1])), CHAR_EXPANSIONS.items(), plain)


def normalize_unicode(c: Column) -> Column:
    return replace_characters(decompose(c))


def strip_refs_urls(c: Column) -> Column:
    """Drop bracketed reference marks and addresses, then fold runs of blanks."""
    marks = rf"(?U)\[{SPACE}*(?:\d+(?:{SPACE}*[,\-]{SPACE}*\d+)*|[a-zA-Z]+){SPACE}*\]"
    text = F.regexp_replace(c, marks, "")
    text = F.regexp_replace(text, rf"https?://{NOT_SPACE}+", "")
    return F.regexp_replace(text, r"[ \t]+", " ")


def collapse_blank_lines(c: Column) -> Column:
    """Trim every line, keep at most two blank lines in a row, trim the ends."""
    text = F.regexp_replace(c, rf"{SPACE_IN_LINE}++\n", "\n")
    text = F.regexp_replace(text, rf"\n{SPACE_IN_LINE}++", "\n")
    return strip(F.regexp_replace(text, r"\n{4,}", "\n\n\n"))


def clean_text(c: Column) -> Column:
    return collapse_blank_lines(strip_refs_urls(normalize_unicode(c)))


def count_block_markers(page: Column) -> Column:
    """Challenge pages announce themselves early: the rule looks at the opening only."""
    head = F.lower(F.substring(page, 1, BLOCK_MARKER_WINDOW))
    return reduce(
        lambda total, marker: total + F.contains(head, F.lit(marker)).cast("int"),
        BLOCK_MARKERS,
        F.lit(0),
    )


def is_block_page(page: Column) -> Column:
    return count_block_markers(page) >= 2


def fold_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{SPACE}+", " "))


def with_page_title(df: DataFrame, page: str = "html", title: str = "title") -> DataFrame:
    """Add the title of a page, cut to the title limit.

    The page is matched in a first step and the short results are worked on in
    later ones, so the patterns run once per page.
    """
    found = df.withColumns({
        "_tag": F.regexp_extract(page, r"(?is)<title(?:\s[^>]*)?>(?:.*?)(?:</title|\z)", 0),
        "_meta": F.regexp_extract(page, r"""(?is)<meta\s(?=[^>]*property\s*=\s*["']?og:title["'\s/>])[^>]*>""", 0),
    })
    raw = found.withColumns({
        "_raw": F.regexp_replace("_tag", r"(?is)\A<title[^>]*>|</title\z", ""),
        "_og": F.regexp_extract("_meta", r"""(?is)\scontent\s*=\s*(?:"[^"]*"|'[^']*')""", 0),
    })
    plain = raw.withColumns({
        "_title": unescape(F.col("_raw")),
        "_og": unescape(F.regexp_replace("_og", r"""(?is)\A\scontent\s*=\s*["']|["']\z""", "")),
    }).withColumns({"_title": fold_spaces(F.col("_title")), "_has_og": F.col("_og") != ""})
    cut = F.regexp_replace("_title", rf"(?s)\A(.{{{TITLE_LIMIT - 3}}}).{{4,}}\z", "$1...")
    chosen = (
        F.when(F.col("_tag") != "", F.when(F.col("_title") == "", "[EMPTY TITLE]").otherwise(cut))
        .when(F.col("_has_og"), F.substring(fold_spaces(F.col("_og")), 1, TITLE_LIMIT))
        .otherwise("[NO TITLE]")
    )
    return plain.withColumn(title, chosen).select(*[c for c in df.columns if c != title], title)


def words(c: Column) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+)"), F.lit(1))


def hhmm(started: Column) -> Column:
    """Clock part of an ISO time; shorter texts pass through, a missing one is blank."""
    text = F.coalesce(started, F.lit(""))
    return F.when(F.length(text) > 16, F.substring(text, 12, 5)).otherwise(text)


def region_display_name(c: Column) -> Column:
    lowered = F.lower(F.substring(c, 2, 2_147_483_647))
    return F.replace(F.concat(F.upper(F.substring(c, 1, 1)), lowered), F.lit("_"), F.lit(" "))


def city_key(address: Column) -> Column:
    """Text before the first comma, trimmed and lower-cased."""
    return F.lower(F.trim(F.substring_index(address, ",", 1)))


def name_key(name: Column) -> Column:
    return F.lower(F.trim(name))
