"""Toxicity: maximum-scoring segments of token log-odds, judged by extreme-value statistics.

Tokens are counted by label over the training rows; a token's score is its log-odds
ratio under a Dirichlet prior, less a gap that makes ordinary text drift down. A
linear scan (all maximal segments) finds every passage whose score is locally
greatest. Its significance follows from the extreme-value law of such
segments: E = K n exp(-lambda S), with both constants measured on clean rows that the
scores have not seen. A document's significant passages add up to one
figure, which a logistic curve, fitted across folds, turns into a probability.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import held_out, table

TOKEN = re.compile(r"\w+")
BUCKETS = 1 << 20  # tokens are hashed, so the table has a fixed size
BLOCK = 1 << 12  # buckets whose counts travel to the driver as one packed row
PRIOR = 3.0  # tokens of the Dirichlet prior that stand behind each bucket
GAP = 1.5
TRAINING_ROWS = 20_000  # labelled rows, the least by hash
THRESHOLD = 0.3
SIGNIFICANT = 1.0  # greatest E value of a passage that counts: as many are expected in a clean text of its length
OUT = "doc_id bigint, held_out boolean, score double, predicted int, passages array<struct<start:int,stop:int,score:double,e_value:double>>"


class _Buckets(dict):
    """Token to bucket; forgets when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bucket = self[token] = zlib.crc32(token.encode()) & (BUCKETS - 1)
        return bucket


def buckets_of(text: str, known: dict[str, int]) -> np.ndarray:
    """One bucket per token of the text as it is, by the token's lower form."""
    low = text.lower()
    # A character whose lower form has two code points may split a token: tokens are then taken first.
    tokens = TOKEN.findall(low) if len(low) == len(text) else [t.lower() for t in TOKEN.findall(text)]
    return np.fromiter(map(known.__getitem__, tokens), np.int32, len(tokens))


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (begin, end, score) in linear time.

    Stretches of tokens without a gain are one step each. Every entry of the
    stack has the sums left of and through it; a new one is merged down to the
    nearest entry that starts lower, as long as that entry ends lower.
    """
    gains = np.flatnonzero(scores > 0)
    if not len(gains):
        return []
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    stack: list[list] = []  # begin, end, left sum, right sum, index of the nearest entry with a lower left sum
    for k in gains.tolist():
        begin, end, left, right = k, k + 1, float(sums[k]), float(sums[k + 1])
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= right:
                stack.append([begin, end, left, right, j])
                break
            begin, left = stack[j][0], stack[j][2]
            del stack[j:]
    return [(b, e, r - lo) for b, e, lo, r, _ in stack]


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Score of each bucket; 0 counts give the gap alone."""
    n1, n0 = max(toxic.sum(), 1.0), max(clean.sum(), 1.0)
    share = n1 / (n1 + n0)
    odds = np.log((toxic + PRIOR * share) / (clean + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return (odds - GAP).astype(np.float32)


def tail_law(segments: float, total: float, tokens: float) -> tuple[float, float]:
    """(lambda, K) of clean text from the number and total score of its segments: their scores fall off exponentially."""
    return (segments + 1) / (total + 1), (segments + 1) / (tokens + 1)


class Model:
    def __init__(self, scores: np.ndarray, rate: float, k: float, curve: tuple[float, float]):
        self.scores, self.rate, self.k, self.curve = scores, rate, k, curve

    def passages(self, buckets: np.ndarray) -> list[tuple[int, int, float, float]]:
        """Significant segments as token spans with score and E value."""
        n = max(len(buckets), 1)
        found = [(b, e, s, self.k * n * np.exp(-self.rate * s)) for b, e, s in maximal_segments(self.scores[buckets])]
        return [x for x in found if x[3] <= SIGNIFICANT]

    def evidence(self, passages) -> float:
        """The passages' significance in nats, added up and damped; 0 if there is none."""
        return float(np.log1p(sum(max(0.0, np.log(SIGNIFICANT) - np.log(max(x[3], 1e-300))) for x in passages)))

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * evidence, -50, 50))))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (never falling) by Newton steps, pulled a little towards 0."""
    w = np.zeros(2)
    a = np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -50, 50)))
        grad = a.T @ (p - y) + np.array([1e-3, 1e-2]) * w
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-3, 1e-2]), grad)
    return (float(w[0]), float(w[1])) if w[1] > 0 else (float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), 0.0)


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> Model:
    """Fits on at most ``rows`` labelled rows that are not held out.

    Rows without a label, id or text are passed over; of several labels of a document
    the greatest counts. Counts of either fold score the other one to fit the curve.
    Without both labels the model gives one half or less to every text.
    """
    spark = docs.sparkSession
    chosen = labels.select("doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The table of chosen ids has at most ``rows`` rows.
    sample = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).cast("int"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets()
        sums = np.zeros((2, 2, BUCKETS), np.int64)
        for batch in batches:
            for text, toxic, fold in zip(batch.text, batch.toxic, batch.fold):
                sums[fold, int(toxic > 0)] += np.bincount(buckets_of(text, known), minlength=BUCKETS) if len(text) > 200_000 else 0
                if len(text) <= 200_000:
                    which, n = np.unique(buckets_of(text, known), return_counts=True)
                    sums[fold, int(toxic > 0), which] += n
        fold, toxic, which = np.nonzero(sums)
        for k in range(0, len(which), 100_000):
            at = slice(k, k + 100_000)
            yield pd.DataFrame({"fold": fold[at], "toxic": toxic[at], "bucket": which[at], "n": sums[fold[at], toxic[at], which[at]]})

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((4, BLOCK), np.int64)
        counts[2 * rows.fold.to_numpy() + rows.toxic.to_numpy(), rows.bucket.to_numpy() % BLOCK] = rows.n.to_numpy()
        return pd.DataFrame({"block": [int(rows.bucket.iloc[0]) // BLOCK], "counts": [counts.tobytes()]})

    # At most BUCKETS / BLOCK rows of 32 bytes a bucket, whatever the corpus and whether or not Arrow is on.
    counted = sample.mapInPandas(count, "fold int, toxic int, bucket int, n bigint").groupBy("fold", "toxic", "bucket").agg(F.sum("n").alias("n"))
    packed = counted.groupBy(F.expr(f"bucket div {BLOCK}")).applyInPandas(pack, "block int, counts binary")
    sums = np.zeros((2, 2, BUCKETS), np.int64)
    for row in packed.toLocalIterator():
        sums[:, :, row["block"] * BLOCK:(row["block"] + 1) * BLOCK] = np.frombuffer(row["counts"], np.int64).reshape(2, 2, BLOCK)
    unseen = [log_odds(sums[1 - k, 1], sums[1 - k, 0]) for k in (0, 1)]
    tables = spark.sparkContext.broadcast(unseen)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, own = _Buckets(), np.zeros(3)
        for batch in batches:
            for text, fold in zip(batch.text, batch.fold):
                buckets = buckets_of(text, known)
                found = maximal_segments(tables.value[fold][buckets])
                own += len(found), sum(x[2] for x in found), len(buckets)
        yield pd.DataFrame([own], columns=["segments", "total", "tokens"])

    tail = sample.filter(F.col("toxic") <= 0).mapInPandas(tails, "segments double, total double, tokens double").agg(
        *[F.coalesce(F.sum(c), F.lit(0.0)) for c in ("segments", "total", "tokens")]).first()
    law = tail_law(*tail)
    tables.destroy()
    shared = spark.sparkContext.broadcast([Model(x, *law, (0.0, 1.0)) for x in unseen])

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Buckets()
        for batch in batches:
            model = shared.value
            yield pd.DataFrame({"evidence": [model[f].evidence(model[f].passages(buckets_of(t, known))) for t, f in zip(batch.text, batch.fold)],
                                "toxic": (batch.toxic > 0).astype("int32")})

    # At most ``rows`` small rows.
    points = sample.mapInPandas(weigh, "evidence double, toxic int").toPandas()
    shared.destroy()
    scores = log_odds(sums[:, 1].sum(0), sums[:, 0].sum(0))
    curve = logistic(points.evidence.to_numpy(float), points.toxic.to_numpy(float)) if points.toxic.nunique() == 2 else (-3.0, 0.0)
    return Model(scores, *law, curve)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted, passages`` per row of ``docs`` (doc_id, text).

    Passages are code-point spans of the whole text with score and E value. Null and
    empty texts have none and get the score of no evidence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, known = shared.value, _Buckets()
        for batch in batches:
            passages, scores = [], []
            for text in batch.text:
                text = text if isinstance(text, str) else ""
                found = own.passages(buckets_of(text, known))
                scores.append(own.probability(own.evidence(found)))
                if found:
                    at = [m.span() for m in TOKEN.finditer(text)]
                    found = [(at[b][0], at[e - 1][1], s, x) for b, e, s, x in found]
                passages.append([dict(zip(("start", "stop", "score", "e_value"), f)) for f in found])
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "held_out": batch.held_out, "score": scores,
                                "predicted": [int(s >= THRESHOLD) for s in scores], "passages": passages})

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(scored, OUT)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those the model rejects, in their own columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own, known = shared.value, _Buckets()
        for texts in parts:
            yield pd.Series([own.probability(own.evidence(own.passages(buckets_of(t or "", known)))) for t in texts])

    return docs.filter(probability("text") < THRESHOLD)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
