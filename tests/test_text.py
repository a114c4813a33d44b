"""Text, markup and address rules on small cases."""

from __future__ import annotations

import unicodedata

import pytest
from pyspark.sql import functions as F

from regionhour.functions import calendar, numeric, text, urls
from regionhour.functions.markup import page_links, page_text


def apply(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


def test_normalize_unicode(spark):
    raw = ["ﬁve – six — “x” … a b\u200bc", "é•ü", "plain", None]
    got = apply(spark, raw, text.normalize_unicode)
    assert got[0] == 'five - six  -  "x" ... a bc'
    assert got[1] == unicodedata.normalize("NFKD", "é") + " " + unicodedata.normalize("NFKD", "ü")
    assert got[2:] == ["plain", None]


def test_strip_refs_urls(spark):
    raw = ["a[1] b[ 2 , 3-5 ]c [note] [a1] [] https://x.org/a?b=1 end", "tab\t\t  two http://y"]
    assert apply(spark, raw, text.strip_refs_urls) == ["a bc [a1] [] end", "tab two "]


def test_collapse_blank_lines(spark):
    raw = [" a \n\n\n\n\n b \t\n c  ", "\n\nx\n \n  \ny ", "one"]
    assert apply(spark, raw, text.collapse_blank_lines) == ["a\n\n\nb\nc", "x\n\n\ny", "one"]


def test_block_page_looks_at_the_opening_only(spark):
    late = "x" * 3000 + "just a moment cloudflare"
    got = apply(spark, ["Just A Moment ... Ray ID", "just a moment", late], text.is_block_page)
    assert got == [True, False, False]


@pytest.mark.parametrize("page,title", [
    ("<title> A &amp;\n  B </title>", "A & B"),
    ("<head><title></title>", "[EMPTY TITLE]"),
    ("<p>none</p>", "[NO TITLE]"),
    ('<meta property="og:title" content="O  &quot;G&quot;">', 'O "G"'),
    ("<title>" + "t" * 201 + "</title>", "t" * 197 + "..."),
    ("<title>" + "t" * 200 + "</title>", "t" * 200),
    ('<TITLE lang="x">Up</TITLE>', "Up"),
])
def test_page_title(spark, page, title):
    df = spark.createDataFrame([(page,)], "html string")
    assert text.with_page_title(df).first()["title"] == title


def test_noise_words_match_inside_class_names():
    body = "<body><div class='research'>gone</div><div id='shareholder'>gone</div><p>kept</p></body>"
    assert page_text(body) == "kept"


def test_longest_container_of_the_first_selector_wins():
    page = (
        "<body><article>longest of all the articles here</article>"
        "<div class='field-item'>short</div><div class='x field-item'>rather longer<p>text</p></div></body>"
    )
    assert page_text(page) == "rather longer\ntext"


def test_text_skips_removed_tags_and_comments():
    page = "<html><body>a<script>var x='<p>'</script><nav>n</nav><p>b<!-- c -->d&amp;e<p>f</body></html>"
    assert page_text(page) == "a\nb\nd&e\nf"
    assert page_text("<p>no body</p>") == "no body"
    assert page_text("<html><body> </body></html>") in (None, "")


def test_links_of_the_footnote_section():
    page = (
        "<a href='/out'>x</a><div><h3>Endnotes</h3><p>[1] <a href='http://a.org'>A</a></p>"
        "<a href='http://b.org'>[2]</a><ol><li><a href='http://c.org'>C</a></ol><a>no address</a></div>"
    )
    found = [(l["pos"], l["href"], l["link_text"], l["parent_marked"], l["in_list"]) for l in page_links(page)]
    assert found == [
        (0, "http://a.org", "A", True, False), (1, "http://b.org", "[2]", True, False), (2, "http://c.org", "C", False, True),
    ]


def test_links_without_a_section_use_the_article_then_the_page():
    assert [l["href"] for l in page_links("<a href='1'></a><article><a href='2'></a></article>")] == ["2"]
    assert [l["href"] for l in page_links("<p><a href='1'></a></p><a href='2'></a>")] == ["1", "2"]


def test_clean_url(spark):
    raw = ["  http://a.org/x#frag ", "http://a.org/x).", "http://a.org//", "a./", "http://a.org/b];"]
    got = apply(spark, raw, urls.clean_url)
    assert got == ["http://a.org/x", "http://a.org/x", "http://a.org", "a.", "http://a.org/b"]
    assert all("#" not in u and not u.endswith("/") for u in got)


def test_valid_url_and_domain(spark):
    raw = ["HTTP://A.org:8080/x", "https://", "ftp://a.org", "//a.org/b", "http://[bad/x", "mailto:a@b", "http://u@h.org?q", None]
    assert apply(spark, raw, urls.is_valid_url) == [True, False, False, False, False, False, True, False]
    assert apply(spark, raw, urls.url_domain) == ["a.org:8080", "", "a.org", "a.org", "", "", "u@h.org", None]


def test_domain_sets(spark):
    raw = ["https://www.understandingwar.org/x", "https://a.isw.pub", "https://notisw.pub", "https://isw.pub.com"]
    assert apply(spark, raw, urls.is_internal) == [True, True, False, False]


@pytest.mark.parametrize("url,title,status", [
    ("https://t.me/some_chan/12", "[Telegram: @some_chan (Post 12)]", "ok"),
    ("https://t.me/s/some_chan", "[Telegram: @some_chan]", "ok"),
    ("https://t.me/joinchat/abc", "[Telegram]", "blocked"),
    ("https://smart.media.org/x.pdf", "[Telegram]", "blocked"),
    ("https://telegram.org/", "[Telegram]", "blocked"),
    ("https://x.com/user/status/5", "[X: @user (Tweet 5)]", "ok"),
    ("https://x.com/i/status/5", "[X]", "blocked"),
    ("https://twitter.com/user", "[X: @user]", "ok"),
    ("https://twitter.com/intent", "[X]", "blocked"),
    ("https://sub.facebook.com/p", "[BLOCKED: sub.facebook.com]", "blocked"),
    ("https://a.org/b.tar.gz?x=1", "[NON-HTML: .GZ]", "non_html"),
    ("https://a.org/b.PDF;v=1", "[NON-HTML: .PDF]", "non_html"),
    ("https://a.org/b.html", None, None),
])
def test_special_title(spark, url, title, status):
    row = urls.with_special_title(spark.createDataFrame([(url,)], "url string")).first()
    assert (row["title"], row["status"]) == (title, status)


def test_numbers(spark):
    assert apply(spark, ["1.5", " ", "", "bad", None, " 2 ", "inf"], numeric.safe_double) == [1.5, None, None, None, None, 2.0, float("inf")]
    assert apply(spark, [0.5, 1.5, 2.5, -0.5], numeric.round_half_even, "double") == [0.0, 2.0, 2.0, 0.0]
    assert apply(spark, [0.0, 22.4, 22.5, 337.5, 350.0, 360.0], numeric.wind_compass, "double") == ["N", "N", "NE", "N", "N", "N"]
    bands = apply(spark, [0.8, 0.79, 0.6, 0.4, 0.2, 0.19], numeric.prob_to_level, "double")
    assert bands == ["critical", "high", "high", "medium", "low", "safe"]


def test_clock_and_date_text(spark):
    clocks = ["13:00:00", "2024-01-05 07:30:00", "", "x", None, "24:00:00"]
    assert apply(spark, clocks, calendar.text_hour) == [13, 7, None, None, None, None]
    dates = apply(spark, ["2024-01-05", "2024-01-05T10:00:00", "n/a", "2024-02-30"], calendar.text_date)
    assert [d and d.isoformat() for d in dates] == ["2024-01-05", "2024-01-05", None, None]


def test_hhmm(spark):
    assert apply(spark, ["2024-03-05T12:34:00Z", "2024-03-05T12:34", None], text.hhmm) == ["12:34", "2024-03-05T12:34", ""]


def test_clamp_range(spark):
    df = spark.sql("""
        SELECT * FROM VALUES (1, DATE'2020-01-01', DATE'2030-01-01'), (2, DATE'2025-01-01', DATE'2024-01-01'),
          (3, DATE'2025-06-01', NULL), (4, NULL, NULL), (5, DATE'2020-01-01', DATE'2021-01-01') AS t(i, s, e)""")
    bounds = calendar.clamp_range(F.col("s"), F.col("e"), F.lit("2025-03-01").cast("date"))
    rows = df.select("i", *[c.alias(n) for n, c in bounds.items()]).orderBy("i").collect()
    assert [r["valid"] for r in rows] == [True, False, False, True, False]
    assert (str(rows[0]["range_start"]), str(rows[0]["range_end"])) == ("2022-02-24", "2025-03-01")
