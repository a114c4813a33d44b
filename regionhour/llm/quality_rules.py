r"""Quality rules: a decision list learned by sequential covering, as ordered Spark conditions.

Every text is measured by column functions. Labelled rows are cut into bins at quantiles of either class; a rule grows
by the threshold of greatest information gain (FOIL) among all measures on two thirds of the rows, and is pruned to the
beginning that does best on the other third. Rows that it covers go, and the next rule is grown from the rest, until
a rule fails on the pruning rows. Every step is one aggregation of the stored sample: a histogram per measure, at most
``len(MEASURES) * 2 * (CUTS + 1)`` rows of it reach the driver. The rules become one ``CASE`` expression, first match first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import BLANKS, held_out, step, table

WINDOW = 8  # words of a window that may repeat
CUTS = 24  # quantiles of either class where a measure is cut
TRAINING_ROWS = 20_000  # labelled rows, the least by hash
MOST_RULES, MOST_CONDITIONS = 12, 4
PURITY = 0.8  # (poor + 1) / (all + 2) that a rule must reach on the pruning rows: three poor ones and no other will do
FEWEST_WORDS, MOST_REPEATED = 20, 30  # base limits: words, and repeated words in a hundred
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = ["n_words", "mean_word", "symbol_share", "duplicate_line_share", "repeated_word_share", "capital_share", "digit_share",
            "mark_share", "distinct_word_share", "words_per_line"]


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with the base counts (long) and ``MEASURES`` (shares of the characters, words or lines; 0 where there are none).

    A null text has no words. Words are runs of anything but the space and the control characters 9 to 13; lines end at ``\\n``.
    """
    others = [c for c in docs.columns if c != text_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.struct(*others).alias("_row"), text.alias("_text"))
    cut = base.withColumn("_words", F.filter(F.split("_text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).withColumn(
        "_lines", F.filter(F.split("_text", "\n"), lambda line: F.trim(line, F.lit(BLANKS)) != ""))
    hashed = cut.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    n = F.size("_words")
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_hashes", i, F.lit(WINDOW))))
    hashed = hashed.withColumn("_windows", F.when(n >= WINDOW, windows))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    # Only texts that repeat something sort their windows; a second hash of the eight words guards the first.
    placed = F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_windows") - 1), lambda k: F.struct(
        F.get("_windows", k).alias("h"), F.hash(F.slice("_hashes", k + 1, F.lit(WINDOW))).alias("g"), k.alias("i"))))
    hashed = hashed.withColumn("_sorted", F.when(repeats, placed))

    def same(k: Column, other: Column) -> Column:
        a, b = F.get("_sorted", k), F.get("_sorted", other)
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    places = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda k: F.when(
        same(k, k - 1) | same(k, k + 1), F.get("_sorted", k)["i"])), lambda i: i.isNotNull()))
    none = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).alias("end"))
    covered = F.aggregate(places, none, lambda at, i: F.struct(
        (at["covered"] + F.least(F.lit(WINDOW), i + WINDOW - at["end"])).alias("covered"), (i + WINDOW).alias("end")))["covered"]

    def without(pattern: str) -> Column:
        return (F.length("_text") - F.length(F.regexp_replace("_text", pattern, ""))).cast("long")

    counted = hashed.select(
        "_row.*", n.cast("long").alias("n_words"), F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        without(r"[#*$%&|<>]+").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered).otherwise(F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").alias("_n_lines"), F.size(F.array_distinct("_hashes")).alias("_distinct"),
        without("[A-Z]+").alias("_capitals"), without("[0-9]+").alias("_digits"), without(r"[!-/:-@\[-`{-~]+").alias("_marks"))

    def share(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part).cast("double"), F.col(whole)), F.lit(0.0))

    shares = {"mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "duplicate_line_share": ("n_dup_lines", "_n_lines"),
              "repeated_word_share": ("n_repeat_words", "n_words"), "capital_share": ("_capitals", "word_chars"), "digit_share": ("_digits", "word_chars"),
              "mark_share": ("_marks", "word_chars"), "distinct_word_share": ("_distinct", "n_words"), "words_per_line": ("n_words", "_n_lines")}
    return counted.withColumns({name: share(*parts) for name, parts in shares.items()}).drop("_n_lines", "_distinct", "_capitals", "_digits", "_marks")


@dataclass(frozen=True)
class Condition:
    """``measure >= cut`` or ``measure < cut``."""

    measure: str
    above: bool
    cut: float

    def column(self) -> Column:
        value = F.col(self.measure)
        return value >= self.cut if self.above else value < self.cut

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.cut:.6g}"


@dataclass
class DecisionList:
    rules: list[list[Condition]] = field(default_factory=list)

    def rule(self) -> Column:
        """The first rule that fits, as text; null if none does."""
        found = F.lit(None).cast("string")
        for conditions in reversed(self.rules):
            found = F.when(_all(conditions), " and ".join(map(str, conditions))).otherwise(found)
        return found


def _all(conditions: list[Condition]) -> Column:
    fits = F.lit(True)
    for condition in conditions:
        fits = fits & condition.column()
    return fits


def _cuts(sample: DataFrame, cuts: int) -> dict[str, list[float]]:
    """The quantiles of either class, per measure; at most ``2 * cuts`` numbers each."""
    marks = [k / (cuts + 1) for k in range(1, cuts + 1)]
    found = sample.groupBy("poor").agg(*[F.percentile(m, F.array(*map(F.lit, marks))).alias(m) for m in MEASURES]).collect()
    return {m: sorted({float(x) for row in found for x in row[m]}) for m in MEASURES}


def _gains(rows: DataFrame, cuts: dict[str, list[float]]) -> list[tuple[float, Condition]]:
    """Information gain of every threshold on ``rows``, from one histogram per measure."""
    bins = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_bin_{m}").alias("bin")) for m in MEASURES])
    histogram = rows.select("poor", F.explode(bins).alias("b")).groupBy("b.measure", "b.bin").agg(
        F.sum("poor").alias("poor"), F.count(F.lit(1)).alias("n")).collect()
    counts = {m: [[0, 0] for _ in range(len(cuts[m]) + 1)] for m in MEASURES}
    for row in histogram:
        counts[row["measure"]][row["bin"]] = [row["poor"], row["n"]]
    whole = [sum(x) for x in zip(*counts[MEASURES[0]])]
    gains = []
    for measure, per_bin in counts.items():
        below = [0, 0]
        for cut, here in zip(cuts[measure], per_bin):
            below = [below[0] + here[0], below[1] + here[1]]
            for above, (poor, n) in ((True, [whole[0] - below[0], whole[1] - below[1]]), (False, below)):
                if poor:
                    gains.append((poor * (math.log2(poor / n) - math.log2(whole[0] / whole[1])), Condition(measure, above, cut)))
    return gains


def learn(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, cuts: int = CUTS) -> DecisionList:
    """Rules for poor texts (quality 0) from at most ``rows`` labelled rows that are not held out.

    Rows without a label or id are passed over; of several labels of a document the greatest counts. With one class
    only, or none, there are no rules. Equal gains go to the measure that is listed first, then to the lower cut.
    """
    known = F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    chosen = labels.select("doc_id", "quality").filter(known).groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(
        F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The table of chosen ids has at most ``rows`` rows.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "text", (F.col("quality") <= 0).cast("int").alias("poor"), (F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0).alias("pruning"))
    sample = step(measured(texts).coalesce(8), "quality-sample")
    found = DecisionList()
    edges = _cuts(sample, cuts)
    if sample.agg(F.count_distinct("poor").alias("n")).first()["n"] < 2:
        return found
    binned = step(sample.withColumns({f"_bin_{m}": F.size(F.filter(F.array(*[F.lit(c) for c in edges[m]]), lambda c: c <= F.col(m))) for m in MEASURES}), "quality-bins")
    growing, pruning = binned.filter("NOT pruning"), binned.filter("pruning")
    while len(found.rules) < MOST_RULES:
        rule: list[Condition] = []
        while len(rule) < MOST_CONDITIONS:
            gains = [g for g in _gains(growing.filter(_all(rule)), edges) if g[1] not in rule]
            gain, best = max(gains, key=lambda g: g[0], default=(0.0, None))
            if gain <= 1e-9:
                break
            rule.append(best)
        if not rule:
            break
        fits = [_all(rule[:k + 1]).cast("long") for k in range(len(rule))]
        sums = pruning.agg(*[F.coalesce(F.sum(fit * F.col("poor")), F.lit(0)).alias(f"p{k}") for k, fit in enumerate(fits)],
                           *[F.coalesce(F.sum(fit), F.lit(0)).alias(f"n{k}") for k, fit in enumerate(fits)]).first()
        # The shortest beginning of the greatest (poor - good) / all.
        worth = [(2 * sums[f"p{k}"] - sums[f"n{k}"]) / sums[f"n{k}"] if sums[f"n{k}"] else -1.0 for k in range(len(rule))]
        length = worth.index(max(worth))
        if (sums[f"p{length}"] + 1) / (sums[f"n{length}"] + 2) < PURITY:
            break
        found.rules.append(rule[:length + 1])
        covered = _all(found.rules[-1])
        growing, pruning = growing.filter(~covered), pruning.filter(~covered)
    return found


def judge(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Base counts, ``base_failed``, ``kept`` and the ``rule`` (text, null if none fits) per row; columns of ``docs`` other than text stay.

    An empty or null text has no words and fails the base limits.
    """
    clash = [c for c in docs.columns if c in {*BASE, *MEASURES, "base_failed", "kept", "rule"}]
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = measured(docs.drop(*clash)).withColumn("rule", rules.rule()).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()).drop(*[m for m in MEASURES if m not in BASE])


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    rules = learn(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return judge(docs, rules).select("doc_id", *BASE, "base_failed", "kept", "rule")
