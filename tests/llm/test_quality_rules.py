"""Quality rules: counts against brute force, held-out labels, rules as conditions, odd rows."""

from __future__ import annotations

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from regionhour.llm import quality_rules as rules
from regionhour.llm import registry

SMALL = "/root/testdata/sf0.001"


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = collections.defaultdict(list)
    for i in range(len(words) - 7):
        windows[tuple(words[i:i + 8])].append(i)
    repeated = {i + k for places in windows.values() if len(places) > 1 for i in places for k in range(8)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_counts_against_brute_force(spark, sf):
    path = f"/root/testdata/{sf}"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()}
    rows = registry.queries()["op12_quality_rules"](spark, path).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in rules.BASE) == want
        assert r["base_failed"] == base_failed(want[0], want[4]) and r["kept"] == (not r["base_failed"] and r["rule"] is None)


def test_held_out_labels(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet").filter(F.expr("crc32(cast(doc_id as string)) % 4 = 2"))
    docs = spark.read.parquet(f"{path}/documents.parquet").join(labels, "doc_id")
    model = rules.learn(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    got = rules.judge(docs.select("doc_id", "text", "quality"), model).select("quality", F.col("rule").isNull().alias("passed")).toPandas()
    assert model.rules and all(len(r) <= rules.MOST_CONDITIONS for r in model.rules)
    assert (~got.passed[got.quality == 0]).mean() > 0.9 and got.passed[got.quality == 1].mean() > 0.98


ODD = [(1, None), (2, ""), (3, " \n\t \x0b"), (4, "one\ntwo\n\none\n two\none"), (5, "a b c d e f g h " * 3), (6, "x " * 30_000), (7, "é" * 200_000),
       (8, "w1 w2 w3 w4 w5 w6 w7 w8 z w1 w2 w3 w4 w5 w6 w7 w8 w9"), (9, "#|*$ <b> 100% & x\r\n#|*$"), (9, "#|*$ <b> 100% & x\r\n#|*$"), (None, "plain words"),
       (10, "a b c d e f g"), (11, "   word \U0001F600 end")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "keep me", "clash") for i, t in ODD], "doc_id bigint, text string, mine string, kept string")
    got = rules.judge(df, rules.DecisionList()).collect()
    assert collections.Counter((r["doc_id"], *(r[c] for c in rules.BASE)) for r in got) == collections.Counter((i, *counts(t)) for i, t in ODD)
    assert all(r["mine"] == "keep me" and r["rule"] is None and r["kept"] == (not r["base_failed"]) for r in got)
    assert rules.judge(df.limit(0), rules.DecisionList()).count() == 0
    labels = spark.createDataFrame([(1, 1), (2, 1), (4, None), (None, 0)], "doc_id bigint, quality int")
    assert rules.learn(df, labels).rules == [] and rules.learn(df, labels.limit(0)).rules == [] and rules.learn(df.limit(0), labels).rules == []


def test_random_texts_against_brute_force(spark):
    pick = random.Random(4)
    texts = ["".join(pick.choices(["a ", "b ", "c\n", "d\t", "#", "\n", "e  "], k=pick.randrange(120))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: tuple(r[c] for c in rules.BASE) for r in rules.measured(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}


def test_a_conjunction_is_found_and_ordered(spark):
    """Poor texts have many marks and short lines at once; neither alone tells them."""
    pick = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        marks, short = pick.random() < 0.5, pick.random() < 0.5
        words = [("x,,," if marks else "xabc") + str(k) for k in range(40)]
        rows.append((i, ("\n" if short else " ").join(words)))
        labels.append((i, int(not (marks and short))))
    df, known = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")
    model = rules.learn(df, known)
    assert len(model.rules) == 1 and len(model.rules[0]) == 2
    got = {r["doc_id"]: int(r["rule"] is None) for r in rules.judge(df, model).collect()}
    assert got == dict(labels)
    first = rules.DecisionList([[rules.Condition("n_words", True, 40.0)], model.rules[0]])
    assert {r["rule"] for r in rules.judge(df, first).collect()} == {"n_words >= 40"}


def test_held_out_rows_are_not_learned_from(spark):
    rows = [(i, "good words here " * 10 if zlib.crc32(str(i).encode()) % 4 == 2 else "###" * 30) for i in range(60)]
    labels = [(i, 0 if zlib.crc32(str(i).encode()) % 4 == 2 else 1) for i in range(60)]
    assert rules.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int")).rules == []
