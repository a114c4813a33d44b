"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a classifier decides.

Candidates are the spans of the base patterns and spans of looser ones (addresses
with a spelled-out at-sign, bracketed dots, national telephone numbers, digit groups
with other separators). Labelers (pattern, gazetteer, context, checksum or
range, surroundings) vote yes, no or abstain. Expectation-maximisation over
the counts of all vote patterns of the corpus estimates each labeler's reliability;
its posteriors train the final span classifier. Base spans always stay; looser ones
are added where the classifier says yes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import step, table

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
LABELERS = 5  # pattern, gazetteer, context, check, surroundings
SHAPES = 8  # three yes/no traits of a span
THRESHOLD = 0.5

# Gazetteers and cue words (our own short lists).
ENDINGS = set("com org net edu gov mil int info biz io co eu de fr es it uk us ca au ch at nl be pl pt se".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49",
                 "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|62|35|30[0-5]|36|38")
CUES = {
    EMAIL: set("email mail e-mail contact write reach correo courriel contacto kontakt".split()),
    IP: set("ip host server address addr login from client adresse".split()),
    CARD: set("card visa mastercard amex credit debit payment pan karte carte tarjeta".split()),
    PHONE: set("phone tel telephone call mobile cell fax telefon teléfono téléphone whatsapp".split()),
}
AGAINST = set("version v release isbn issn order invoice build section chapter page port ref item model serial rev".split())

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
SPELLED_AT = re.compile(r" ?(?:\((?:at|AT)\)|\[(?:at|AT)\]) ?")
SPELLED_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:(?:\.| ?(?:\((?:dot|DOT)\)|\[(?:dot|DOT)\]) ?)[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOTTED = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])")
SPACED = re.compile(r"(?<![0-9])[0-9]{4}(?:[._/][0-9]{4}){2,3}(?![0-9])")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _local_start(text: str, at: int, floor: int) -> int:
    while at > floor and text[at - 1] in LOCAL:
        at -= 1
    return at


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, stop) of the base patterns, in linear time: leftmost, not overlapping within a kind."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = _local_start(text, at, end)
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((EMAIL, start, end))
        # The runs before two at-signs never overlap, so each character is stepped over once.
        end = max(end, at + 1)
        at = text.find("@", end)
    for run in NUMBERS.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k:k + 4]
            stop = at + sum(map(len, four)) + 3
            if all(map(_small, four)):
                out.append((IP, at, stop))
            at = stop + 1
    for run in DIGITS.finditer(text):
        if 12 <= run.end() - run.start() <= 37:
            digits = run[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((CARD, *run.span()))
    for run in PLUS.finditer(text):
        if 9 <= sum(c.isdigit() for c in run[0]) <= 15:
            out.append((PHONE, *run.span()))
    return out


def loose_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the looser patterns that touch no base span, none overlapping another."""
    found = []
    if "(" in text or "[" in text:
        for at in SPELLED_AT.finditer(text):
            start = _local_start(text, at.start(), 0)
            host = SPELLED_DOMAIN.match(text, at.end())
            if start < at.start() and host:
                found.append((EMAIL, start, host.end()))
        found += [(IP, *m.span()) for m in DOTTED.finditer(text)]
    found += [(CARD, *m.span()) for m in SPACED.finditer(text)]
    found += [(PHONE, *m.span()) for m in NATIONAL.finditer(text)]
    taken = sorted((a, b) for _, a, b in base)
    out, last = [], -1
    k = 0
    for kind, start, stop in sorted(found, key=lambda s: (s[1], s[0])):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= last and not (k < len(taken) and taken[k][0] < stop):
            out.append((kind, start, stop))
            last = stop
    return out


def pattern_of(text: str, kind: int, start: int, stop: int, strict: bool) -> int:
    """Votes (0 no, 1 abstains, 2 yes) and shape of a span as one number below KINDS x 3^LABELERS x SHAPES."""
    span = text[start:stop]
    digits = re.sub(r"[^0-9]", "", span)
    before = re.findall(r"[^\W_][\w-]*", text[max(0, start - 40):start].lower())[-3:]
    if kind == EMAIL:
        gazetteer = 2 if re.split(r"[^A-Za-z0-9]+", span.lower())[-1] in ENDINGS else 1
        check = 2 if re.search(r"[A-Za-z]", span) else 0
    elif kind == IP:
        parts = re.findall("[0-9]+", span)
        gazetteer = 0 if parts[0].lstrip("0") in ("", "255") else 1
        check = 2 if all(map(_small, parts)) else 0
    elif kind == CARD:
        gazetteer = 2 if ISSUERS.match(digits) else 0
        check = 2 if luhn(digits) else 0
    else:
        gazetteer = 2 if digits.startswith(COUNTRY_CODES) or digits[:1] in "23456789" else 0
        check = 2 if 9 <= len(digits) <= 15 else 0
    context = 2 if CUES[kind].intersection(before) else 0 if AGAINST.intersection(before) else 1
    glued = (start > 0 and text[start - 1].isalnum()) or (stop < len(text) and text[stop].isalnum())
    votes = (2 if strict else 1, gazetteer, context, check, 0 if glued else 2)
    shape = (len(span) > 16) + 2 * bool(re.search(r"[\x20()-]", span)) + 4 * (len(set(digits)) > 4)
    number = kind
    for v in votes:
        number = number * 3 + v
    return number * SHAPES + shape


def _unpack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, votes as columns, shape bits as columns)."""
    shape, rest = numbers % SHAPES, numbers // SHAPES
    votes = np.stack([rest // 3 ** (LABELERS - 1 - k) % 3 for k in range(LABELERS)], axis=1)
    return rest // 3 ** LABELERS, votes, np.stack([shape >> k & 1 for k in range(3)], axis=1)


def expectation_maximisation(votes: np.ndarray, n: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, reliability[labeler, class, vote]) from counted vote patterns.

    Starts from the votes' balance; every probability is smoothed by one vote.
    """
    q = 1 / (1 + np.exp(-(votes - 1).sum(axis=1)))
    for _ in range(rounds):
        both = np.stack([1 - q, q]) * n
        prior = (both.sum(axis=1) + 1) / (n.sum() + 2)
        # A labeler is trusted to be right rather than wrong before anything is seen.
        table_ = np.array([[[both[c][votes[:, k] == v].sum() + 1 + (v == 2 * c) for v in range(3)] for c in (0, 1)] for k in range(votes.shape[1])])
        table_ /= table_.sum(axis=2, keepdims=True)
        log = np.log(prior)[:, None] + sum(np.log(table_[k][:, votes[:, k]]) for k in range(votes.shape[1]))
        q = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return q, table_


def fit_classifier(numbers: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Probability of every counted pattern by a logistic span classifier for each kind, trained on EM's posteriors."""
    kind, votes, shape = _unpack(numbers)
    out = np.zeros(len(numbers))
    for k in range(len(KINDS)):
        at = kind == k
        if not at.any():
            continue
        q, _ = expectation_maximisation(votes[at], n[at])
        x = np.concatenate([np.ones((at.sum(), 1)), votes[at] - 1, shape[at]], axis=1).astype(float)
        w, ridge = np.zeros(x.shape[1]), np.r_[1e-3, np.full(x.shape[1] - 1, 0.1)]
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n[at] * (p - q)) + ridge * w
            w = w - np.linalg.solve((x * (n[at] * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), slope)
        out[at] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return out


SPANS = "array<struct<start:int,kind:int,stop:int,pattern:int>>"


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def row(text: str, spans, strict: bool) -> list[dict]:
        return [{"start": a, "kind": k, "stop": b, "pattern": pattern_of(text, k, a, b, strict)} for k, a, b in spans]

    for batch in batches:
        base, loose = [], []
        for text in batch.text:
            text = text if isinstance(text, str) else ""
            sure = base_spans(text)
            base.append(row(text, sure, True))
            loose.append(row(text, loose_spans(text, sure), False))
        yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "base": base, "loose": loose})


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, base, added`` per row of ``docs`` (doc_id, text): arrays of (start, kind, stop, pattern).

    Null texts count as empty and have no spans; repeated rows are answered alike. Texts are
    read once; spans are stored, and only counts of patterns reach the driver.
    """
    found = step(docs.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(_candidates, f"doc_id bigint, base {SPANS}, loose {SPANS}"), "spans")
    # At most kinds x 3^LABELERS x SHAPES rows.
    counts = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy("s.pattern").count().orderBy("pattern").collect()
    numbers, n = np.array([r[0] for r in counts], int), np.array([r[1] for r in counts], float)
    accepted = numbers[fit_classifier(numbers, n) >= THRESHOLD].tolist() if len(numbers) else []
    wanted = F.array(*map(F.lit, accepted)).cast("array<int>")
    return found.select("doc_id", "base", F.filter("loose", lambda s: F.array_contains(wanted, s["pattern"])).alias("added"))


def listed(spans: Column) -> Column:
    """kind:start:stop by start, then kind as listed, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.sort_array(spans), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return spans.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
