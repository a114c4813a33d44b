"""Conversation repair: generalised LR over the role grammar with weighted delete, rerole and insert actions.

The grammar of role initials is ``T -> (empty) | P | s P``, ``P -> u a | P u a``; its LR automaton is built from
these productions. All stacks that are alive after a row share one graph: a node is a state over the node below
it, made once, and every stack top holds the cheapest way to reach it. A row may be kept (shift its
initial), reroled (shift u or a), deleted, or preceded by insertions (shift u or a without a row). Ways that
reach the same node are merged by the least (cost, audit), where audit is the string of edits so far. Two ways of equal cost
never have audits of which one begins the other, as both have one letter other than I per row and each I costs,
so comparing them early is safe.

Faults are found by Spark: blank and truncated rows by column functions, repeated ones by counts per (conversation,
role and text) joined back, so that a conversation's texts are never held as a set. The rows of a conversation then pass through one task as a
sorted stream: its hash is one chain over the repaired text and can't be cut into parts. That task holds the stack graph
(at most nine nodes) and the rows since the last edit on which all tops agree, however long the conversation is.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import BLANKS, step, table

GRAMMAR = [("Z", "T"), ("T", ""), ("T", "P"), ("T", "sP"), ("P", "ua"), ("P", "Pua")]
ROLES = {"s": "system", "u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# A top that costs more than this beyond the cheapest one can't win: two insertions bring any stack to the end of a pair, and
# from there one insertion (a user) or one deletion (a system row) lets it follow whatever the other top would do.
SLACK = 2 * INSERT + max(INSERT, DELETE)
SHORT = 64  # rows up to which a conversation's codes are parsed at once and remembered
SETTLE = 512  # letters of audit after which agreed edits are written out
BROADCAST_ROWS = 200_000  # repeated texts up to which their table is copied to every task: about 12 MB


class Stacks:
    """The LR automaton and the graph of stacks: node 0 is the bottom, others are (state, node below)."""

    def __init__(self, grammar: list[tuple[str, str]] = GRAMMAR):
        self.grammar = grammar
        self.states: list[frozenset] = []
        self.goto: dict[tuple[int, str], int] = {}
        self._state({(0, 0)})
        for state in self.states:  # grows while it is read
            for symbol in sorted({grammar[p][1][dot] for p, dot in state if dot < len(grammar[p][1])}):
                moved = {(p, dot + 1) for p, dot in state if grammar[p][1][dot:dot + 1] == symbol}
                self.goto[self.states.index(state), symbol] = self._state(moved)
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.known = {(0, -1): 0}

    def _state(self, kernel: set) -> int:
        items, open_ = set(kernel), list(kernel)
        while open_:
            p, dot = open_.pop()
            for q, (head, _) in enumerate(self.grammar):
                if self.grammar[p][1][dot:dot + 1] == head and (q, 0) not in items:
                    items.add((q, 0))
                    open_.append((q, 0))
        state = frozenset(items)
        if state not in self.states:
            self.states.append(state)
        return self.states.index(state)

    def _push(self, below: int, symbol: str) -> int | None:
        state = self.goto.get((self.nodes[below][0], symbol))
        if state is None:
            return None
        if (state, below) not in self.known:
            self.known[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.known[state, below]

    def _reduced(self, node: int, heads: str) -> int:
        """``node`` after all reductions to the named heads."""
        for p, dot in self.states[self.nodes[node][0]]:
            head, body = self.grammar[p]
            if dot == len(body) and head in heads:
                below = node
                for _ in body:
                    below = self.nodes[below][1]
                pushed = self._push(below, head)
                if pushed is not None:
                    return self._reduced(pushed, heads)
        return node

    def shift(self, node: int, initial: str) -> int | None:
        """The stack after one role, with its pairs reduced; None if the role can't follow."""
        pushed = self._push(node, initial)
        return None if pushed is None else self._reduced(pushed, "P")

    def accepts(self, node: int) -> bool:
        return self.nodes[self._reduced(node, "PT")][0] == self.goto[0, "T"]

    def insertions(self, node: int) -> list[tuple[str, int]]:
        """Runs of inserted roles and where they lead; none visits a stack twice."""
        found, open_, seen = [("", node)], [("", node)], {node}
        while open_:
            run, at = open_.pop(0)
            for role in "ua":
                then = self.shift(at, role)
                if then is not None and then not in seen:
                    seen.add(then)
                    found.append((run + "I", then))
                    open_.append((run + "I", then))
        return found

    @lru_cache(maxsize=None)
    def moves(self, node: int, code: str) -> list[tuple[int, str, int]]:
        """(cost, edits, stack) for a row of this code; of several ways to one stack the least (cost, edits).

        Codes: b and d are rows that must go; s, u, a, o name the initial, in upper case if the text is truncated.
        Insertions come right before a kept row: before a deleted one they would give a greater audit.
        """
        ways = [(DELETE, "D", node)]
        if code not in "bd":
            cut = TRUNCATED * code.isupper()
            for run, at in self.insertions(node):
                for cost, edit, role in [(KEEP, "K", code.lower()), (REROLE, "R", "u"), (REROLE, "R", "a")]:
                    then = self.shift(at, role)
                    if then is not None:
                        ways.append((INSERT * len(run) + cost + cut, run + edit, then))
        best: dict[int, tuple[int, str]] = {}
        for cost, edits, then in ways:
            best[then] = min(best.get(then, (cost, edits)), (cost, edits))
        return [(cost, edits, then) for then, (cost, edits) in best.items()]


class Parser:
    """Tops of the graph with their least (cost, audit); ``settled`` hands out the edits that all tops share."""

    stacks = Stacks()

    def __init__(self) -> None:
        self.tops: dict[int, tuple[int, str]] = {0: (0, "")}
        self.room = SETTLE

    def row(self, code: str) -> None:
        after: dict[int, tuple[int, str]] = {}
        for node, (cost, audit) in self.tops.items():
            for more, edits, then in self.stacks.moves(node, code):
                way = (cost + more, audit + edits)
                if then not in after or way < after[then]:
                    after[then] = way
        limit = min(after.values())[0] + SLACK
        self.tops = {node: way for node, way in after.items() if way[0] <= limit}

    def settled(self) -> str:
        audits = [audit for _, audit in self.tops.values()]
        if max(map(len, audits)) < self.room:
            return ""
        shared = commonprefix(audits)
        # Insertions at its end belong to a row that is not decided yet.
        shared = shared[:max(shared.rfind(edit) for edit in "DKR") + 1]
        self.tops = {node: (cost, audit[len(shared):]) for node, (cost, audit) in self.tops.items()}
        self.room = SETTLE + 2 * max(len(audit) for _, audit in self.tops.values())
        return shared

    def end(self) -> tuple[int, str]:
        return min((cost + INSERT * len(run), audit + run) for node, (cost, audit) in self.tops.items()
                   for run, at in self.stacks.insertions(node) if self.stacks.accepts(at))


@lru_cache(maxsize=100_000)
def parse(codes: str) -> tuple[int, str]:
    """(cost, audit) of a short conversation."""
    parser = Parser()
    for code in codes:
        parser.row(code)
    return parser.end()


class Conversation:
    """One conversation as a stream of rows: its counts, edits and repaired turns."""

    def __init__(self, ident, emit: Callable):
        self.ident, self.emit = ident, emit
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.rows = 0
        self.low = self.high = self.last = None
        self.initial: str | None = None
        self.codes: list[str] = []
        self.parser: Parser | None = None
        self.waiting: deque = deque()
        self.audit: list[str] = []
        self.follow, self.place = "u", 0

    def row(self, turn, role: str, text: str | None, code: str, copies: int, same: bool) -> None:
        """``copies`` equal rows; ``same`` if the row before had this turn, role and text, too."""
        initial = role[:1]
        for k in range(copies):
            fault = code if code in "bd" else "d" if same or k else code
            self.blank += fault == "b"
            self.duplicate += fault == "d"
            self.truncated += fault not in "bd" and fault.isupper()
            if self.initial is not None:
                self.illegal += self.initial + initial not in ("su", "ua", "au")
            self.initial = initial
            self._take(fault, None if fault in "bd" else (role, text))
        if turn is not None:
            self.turns += turn != self.last
            self.low = turn if self.low is None else self.low
            self.high = self.last = turn

    def _take(self, code: str, kept: tuple[str, str] | None) -> None:
        self.rows += 1
        self.waiting.append(kept)
        if self.parser is None:
            self.codes.append(code)
            if len(self.codes) <= SHORT:
                return
            self.parser = Parser()
            for earlier in self.codes:
                self.parser.row(earlier)
        else:
            self.parser.row(code)
        self._write(self.parser.settled())

    def _write(self, edits: str) -> None:
        if edits:
            self.audit.append(edits)
        for edit in edits:
            kept = self.waiting.popleft() if edit != "I" else ("", "")
            if edit == "D":
                continue
            role, text = kept if edit == "K" else (ROLES[self.follow], kept[1])
            self.follow = "u" if role[:1] in ("s", "a") else "a"
            self.emit(self.ident, self.place, role, text, edit)
            self.place += 1

    def end(self) -> dict:
        cost, rest = parse("".join(self.codes)) if self.parser is None else self.parser.end()
        self._write(rest)
        return {"gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns, "blank": self.blank, "duplicate": self.duplicate,
                "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": "".join(self.audit)}


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


def _faulty(rows: DataFrame) -> DataFrame:
    """``conv, turn, role, text, copies, code``: every row with its fault or initial; rows with no copies only name their conversation."""
    blank = F.rtrim(F.col("text"), F.lit(BLANKS)) == ""
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    # The role's length keeps ("a", "bc") and ("ab", "c") apart.
    rows = rows.withColumn("said", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    seen = step(rows.filter("copies > 0").groupBy("conv", "said").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("first")).filter(
        "n > 1").select(F.col("conv").alias("_conv"), F.col("said").alias("_said"), F.col("first.turn").alias("_first")), "repeats")
    seen = F.broadcast(seen) if seen.count() <= BROADCAST_ROWS else seen
    joined = rows.join(seen, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("said") == F.col("_said")), "left")
    # The least turn, nulls first: a row of a later turn repeats it, rows of the same turn are neighbours in the stream.
    later = F.col("_said").isNotNull() & F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin(*ROLES), initial).otherwise("o")
    code = F.when(blank, "b").when(later, "d").when(last.isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    return joined.select("conv", "turn", "role", "text", "copies", code.alias("code")).withColumn(
        "text", F.when(F.col("copies") > 0, F.col("text")))


def _streams(rows: DataFrame, conversation: str) -> tuple[DataFrame, str]:
    kind = rows.schema[conversation].dataType.simpleString()
    space = F.lit(" ")
    plain = rows.select(F.col(conversation).alias("conv"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"),
                        F.coalesce("text", space).alias("text"), (F.col("copies") if "copies" in rows.columns else F.lit(1)).cast("int").alias("copies"))
    faulty = _faulty(plain)
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "text"]
    return faulty.repartition("conv").sortWithinPartitions(*order), kind


def _walk(batches: Iterator[pa.RecordBatch], emit: Callable, done: Callable) -> Iterator[bool]:
    """Passes the sorted rows to their conversations; yields after every batch and at the end."""
    current, before, first = None, None, True
    for batch in batches:
        for conv, turn, role, text, copies, code in zip(*(column.to_pylist() for column in batch.columns)):
            if first or conv != current.ident:
                if not first:
                    done(current.ident, current.end())
                current, before, first = Conversation(conv, emit), None, False
            if copies:
                current.row(turn, role, text, code, copies, before == (turn, role, text))
                before = (turn, role, text)
        yield True
    if not first:
        done(current.ident, current.end())
    yield True


def reports(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """One row per conversation: faults, the cheapest repair's cost and audit, and the SHA-256 of the repaired ``role:text`` lines.

    ``rows`` has ``turn``, ``role``, ``text`` and may have ``copies`` (equal rows side by side; 0 only names the conversation). Rows are taken by turn, nulls
    first, then by role and text. A null role or text is one space. Rows whose conversation is null are one conversation. Further columns are not read.
    """
    sorted_rows, kind = _streams(rows, conversation)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, state = [], [hashlib.sha256(), False]

        def emit(conv, place, role, text, edit) -> None:
            state[0].update((("\n" if state[1] else "") + f"{role}:{text}").encode())
            state[1] = True

        def done(conv, report) -> None:
            out.append({"conv": conv} | report | {"repaired_sha256": state[0].hexdigest()})
            state[:] = [hashlib.sha256(), False]

        for _ in _walk(batches, emit, done):
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out.clear()

    schema = pa.schema([("conv", _arrow(kind)), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        ("audit", pa.string()), ("repaired_sha256", pa.string())])
    return sorted_rows.mapInArrow(run, f"conv {kind}, {REPORT}").withColumnRenamed("conv", conversation)


def repaired_turns(rows: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The repaired conversations: ``position`` from 0, ``role``, ``text`` and ``edit`` (K kept, R role set, I inserted). Rows as in ``reports``."""
    sorted_rows, kind = _streams(rows, conversation)
    schema = pa.schema([("conv", _arrow(kind)), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for _ in _walk(batches, lambda *turn: out.append(turn), lambda *_: None):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()

    return sorted_rows.mapInArrow(run, f"conv {kind}, position bigint, role string, text string, edit string").withColumnRenamed("conv", conversation)


def _arrow(kind: str) -> pa.DataType:
    known = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    if kind not in known:
        raise ValueError(f"conversations are named by bigint, int or string, not {kind}")
    return known[kind]


def damaged(rows: DataFrame) -> DataFrame:
    """The rows with the damage that ``crc32(conv_id:turn) % 20`` names; nulls are one space. Dropped rows stay with no copies."""
    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = name("text")
    return rows.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(name("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports(damaged(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def _add(way: str, cost: int | str, edits: str) -> str:
    """SQL: a way is its cost in eight digits, then its audit; null if there is none."""
    return f"lpad(CAST(CAST(left({way}, 8) AS INT) + {cost} AS VARCHAR), 8, '0') || substr({way}, 9) || '{edits}'"


_SPACES = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_FILLED_U = f"least(u, {_add('z', 3, 'I')}, {_add('s', 3, 'I')}, {_add('a', 3, 'I')})"
_FILLED_A = f"least(a, {_add('u', 3, 'I')}, {_add('z', 6, 'II')}, {_add('s', 6, 'II')})"


def _step(before: str, initial: str, state: str) -> str:
    used = _add("p." + before, f"(CASE WHEN initial = '{initial}' THEN cut ELSE cut + 3 END)", "")
    letter = f"(CASE WHEN initial = '{initial}' THEN 'K' ELSE 'R' END)"
    return f"least({_add('p.' + state, 4, 'D')}, CASE WHEN fault THEN NULL ELSE {used} || {letter} END)"


# A table of states by row instead of stacks: z nothing yet, s after system, u after user, a after assistant.
OP11_SQL = f"""
    WITH RECURSIVE bytes AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
            lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS v FROM range(256) r(i))),
    keys AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
            coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    kinds AS (SELECT *, xor(CAST(4294967295 AS BIGINT), list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS kind FROM keys, bytes),
    after AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
            CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
        FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
    places AS (SELECT *, left(role, 1) AS initial, rtrim(text, {_SPACES}) AS core,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM after),
    seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM places),
    faults AS (SELECT *, core = '' AS blank, core <> '' AND again AS duplicate, core <> '' AND NOT again AND right(core, 1) NOT IN ('.', '!', '?') AS truncated,
            lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM seen),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
            count(*) FILTER (truncated) AS truncated, count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n_rows
        FROM faults GROUP BY 1),
    ids AS (SELECT DISTINCT conv_id FROM conversations),
    ways AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM ids
        UNION ALL
        SELECT p.conv_id, f.i, {_add('p.z', 4, 'D')},
            least({_add('p.s', 4, 'D')}, CASE WHEN NOT fault AND initial = 's' THEN {_add('p.z', 'cut', 'K')} END),
            {_step('fu', 'u', 'u')}, {_step('fa', 'a', 'a')}
        FROM (SELECT *, least(z, s, {_FILLED_A}) AS fu, {_FILLED_U} AS fa FROM ways) p
        JOIN (SELECT *, blank OR duplicate AS fault, CASE WHEN truncated THEN 3 ELSE 0 END AS cut FROM faults) f
          ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1),
    best AS (SELECT w.conv_id, least(z, {_FILLED_A}) AS way FROM ways w LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(c.n_rows, 0)),
    edits AS (SELECT conv_id, pos, substr(way, 8 + pos, 1) AS edit, length(replace(substr(way, 9, pos), 'I', '')) AS i
        FROM (SELECT conv_id, way, unnest(range(1, length(way) - 7)) AS pos FROM best)),
    turns AS (SELECT e.conv_id, pos, edit, f.role, CASE WHEN edit = 'I' THEN '' ELSE f.text END AS text, row_number() OVER w AS n,
            first_value(edit = 'K' AND f.initial = 's') OVER w AS led
        FROM edits e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE edit <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY pos)),
    lines AS (SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (n - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
            chr(10) ORDER BY pos) AS repaired FROM turns GROUP BY 1)
    SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
           coalesce(illegal, 0) AS illegal, CAST(left(way, 8) AS BIGINT) AS cost, substr(way, 9) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
    FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN lines l ON l.conv_id IS NOT DISTINCT FROM b.conv_id"""
