"""Conversation repair against every sequence of edits, against SQL, and as a long stream."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest

from regionhour.llm import conversation_repair as repair
from regionhour.llm import registry
from tests.compare import connect, differences

SMALL = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
GAPS = ["", "u", "a", "ua", "au"]


def every_edit(codes: str) -> tuple[int, str]:
    """The least (cost, audit) over all edits with at most two insertions in a gap."""
    best = (10 ** 9, "")
    choices = []
    for c in codes:
        cut = 3 * c.isupper()
        choices.append([("D", "", 4)] + ([] if c in "bd" else [("K", c.lower(), cut), ("R", "u", 3 + cut), ("R", "a", 3 + cut)]))
    for rows in itertools.product(*choices):
        for gaps in itertools.product(GAPS, repeat=len(codes) + 1):
            roles = "".join(g + r[1] for g, r in zip(gaps, rows)) + gaps[-1]
            cost = sum(r[2] for r in rows) + 3 * sum(map(len, gaps))
            if cost <= best[0] and LEGAL.fullmatch(roles):
                best = min(best, (cost, "".join("I" * len(g) + r[0] for g, r in zip(gaps, rows)) + "I" * len(gaps[-1])))
    return best


@pytest.mark.parametrize("length", [0, 1, 2])
def test_least_cost_and_audit(length):
    for codes in itertools.product("suaoSUAObd", repeat=length):
        assert repair.parse("".join(codes)) == every_edit("".join(codes)), codes


def test_least_cost_and_audit_of_longer_rows():
    pick = random.Random(3)
    for _ in range(25):
        codes = "".join(pick.choices("suaoSUbd", k=4))
        assert repair.parse(codes) == every_edit(codes), codes


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_agrees_with_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    query = registry.queries()["op11_conversation_repair"](spark, path)
    assert differences(query, connect(path), registry.oracle_sql()["op11_conversation_repair"]) is None


ODD = [
    (1, None, None, None), (1, None, "user", "hi."), (1, 0, "user", "hi."), (1, 3, "", "end."), (1, 3, "", "end."), (1, 3, "a", "x"),
    (2, 5, "system", "only"), (3, 1, "assistant", " \n\t"), (None, 1, "user", "who?"), (None, None, "user", "who?"), (None, 2, "assistant", "me!  \n"),
    (4, 1, "user", "a:b"), (4, 2, "user:a", "b"), (4, 3, "Ünder", "é."), (5, -3, "user", "word " * 20_000), (5, 9, "assistant", "."), (6, 1, "user", "?"),
] + [(7, i % 40, ["user", "assistant", "tool"][i % 3], f"text {i % 50}" + ".!? "[i % 4]) for i in range(300)]


def test_odd_rows_agree_with_sql(spark):
    df = spark.createDataFrame([r + ("clash", 1) for r in ODD], "conv_id bigint, turn bigint, role string, text string, conv string, code int").repartition(3)
    con = connect(SMALL)
    con.execute("DROP VIEW conversations")
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ODD)
    assert differences(repair.reports(repair.damaged(df)), con, repair.OP11_SQL) is None
    assert repair.reports(df.limit(0)).count() == 0 and repair.repaired_turns(df.limit(0)).count() == 0
    # The repeated texts' table joined by shuffle gives the same.
    limit, repair.BROADCAST_ROWS = repair.BROADCAST_ROWS, 0
    try:
        assert differences(repair.reports(repair.damaged(df)), con, repair.OP11_SQL) is None
    finally:
        repair.BROADCAST_ROWS = limit


def test_repaired_turns_are_legal_and_hashed(spark):
    df = spark.createDataFrame(ODD, "conv_id bigint, turn bigint, role string, text string")
    turns = repair.repaired_turns(df).toPandas().sort_values("position")
    for row in repair.reports(df).collect():
        own = turns[turns.conv_id.isna()] if row["conv_id"] is None else turns[turns.conv_id == row["conv_id"]]
        assert LEGAL.fullmatch("".join(r[:1] for r in own.role)) and "".join(own.edit) == row["audit"].replace("D", "")
        said = "\n".join(f"{r}:{t}" for r, t in zip(own.role, own.text))
        assert hashlib.sha256(said.encode()).hexdigest() == row["repaired_sha256"]


def test_a_long_conversation_is_written_as_it_is_decided():
    pick = random.Random(8)
    codes = pick.choices("uauauasoUAbd", k=6000) + ["b"] * 3000 + pick.choices("uaua", k=500)
    whole = repair.Parser()
    for code in codes:
        whole.row(code)
    turns, most = [], 0
    talk = repair.Conversation(1, lambda *turn: turns.append(turn))
    for k, code in enumerate(codes):
        talk._take(code, None if code in "bd" else ({"s": "system", "u": "user", "a": "assistant", "o": "tool"}[code.lower()], str(k)))
        most = max(most, len(talk.waiting)) if k < 6000 else most
    report = talk.end()
    assert (report["cost"], report["audit"]) == whole.end() and most < 4 * repair.SETTLE
    assert LEGAL.fullmatch("".join(t[2][:1] for t in turns)) and [t[1] for t in turns] == list(range(len(turns)))
