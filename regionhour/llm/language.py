"""Language identification by cross-parsing entropy.

A suffix automaton of each language's training text finds longest matches: a text
is cut greedily into the longest phrases that occur there. The language that needs
the fewest phrases, times the bits to point at one (log2 of its training length),
wins. Texts are parsed in windows of ``WINDOW`` characters, side by side as numpy
lanes, over their whole length; a phrase ends at a window's border. Greedy phrases are the fewest there are and parts of phrases are phrases,
so a text gets at most one phrase more for each border, in every language alike.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import held_out, table

WINDOW = 512
ROWS_PER_LANGUAGE = 24  # training rows of a language, the least by hash, one in each of so many buckets
LONGEST_TRAINING_ROW = 4096  # characters; of a longer row a span of so many is learned from, at a place given by its hash
LETTERS = 95  # the most frequent characters of the training texts have columns of a table; rarer ones are looked up
MOST_CELLS = 1 << 27  # of all languages' tables, 4 bytes each: with many languages fewer characters have columns, which changes no count
SHARPNESS = 0.7
UNDETERMINED = "und"
MAYBE_LETTER = re.compile(r"[^\W\d_]")  # also superscripts and fractions, which are none


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


class SuffixAutomaton:
    """States of all substrings of a text; ``next[state]`` maps a character code to a state."""

    def __init__(self, codes: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.length, self.link, last = [0], [-1], 0
        for c in codes:
            new = self._add({}, self.length[last] + 1, 0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                if self.length[q] != self.length[p] + 1:
                    copy = self._add(dict(self.next[q]), self.length[p] + 1, self.link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = self.link[p]
                    self.link[q] = q = copy
                self.link[new] = q
            last = new

    def _add(self, following: dict[int, int], length: int, link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1


class Parser:
    """Counts phrases of many texts against all languages at once."""

    def __init__(self, training: dict[str, str]):
        self.languages = sorted(training)
        seen = Counter(c for t in training.values() for c in t.lower())
        letters = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        self.code = np.zeros(max(map(ord, letters), default=0) + 2, np.int32)  # 0: in no training text, matches nothing
        for n, c in enumerate(letters, 1):
            self.code[ord(c)] = n
        # An automaton has at most twice as many states as its text has characters.
        states = sum(2 * len(t.lower()) + 1 for t in training.values())
        self.width = width = max(1, min(min(len(letters), LETTERS) + 1, MOST_CELLS // max(1, states)))
        if states * width >= 1 << 31:
            raise ValueError(f"{states} states of training texts do not fit; give fewer rows for each language")
        tables, self.roots, self.bits = [], [], []
        rare_keys, rare_cells = [], []  # transitions by characters without a column
        self.rare_starts = np.zeros((len(self.languages), len(letters) + 1 - width), np.int32)
        offset = 0
        for name in self.languages:
            codes = self.codes(training[name].lower())
            automaton = SuffixAutomaton(codes.tolist())
            # A cell holds where to go; its complement says that a new phrase begins there.
            start = np.full(len(letters) + 1, ~offset, np.int32)
            for c, to in automaton.next[0].items():
                start[c] = ~(offset + to * width)
            self.rare_starts[len(tables)] = start[width:]
            cells = np.tile(start[:width], (len(automaton.next), 1))
            keys, targets = [], []
            for state, following in enumerate(automaton.next[1:], 1):
                for c, to in following.items():
                    if c < width:
                        cells[state, c] = offset + to * width
                    else:
                        keys.append(offset + state * width << 21 | c)
                        targets.append(offset + to * width)
            order = np.argsort(np.array(keys, np.int64))
            rare_keys.append(np.array(keys, np.int64)[order])
            rare_cells.append(np.array(targets, np.int32)[order])
            tables.append(cells.ravel())
            self.roots.append(offset)
            self.bits.append(np.log2(max(2, len(codes))))
            offset += cells.size
        self.cells = np.concatenate(tables) if tables else np.zeros(0, np.int32)
        # Sorted by state (languages follow each other) and character, with a last key that nothing equals.
        self.rare_keys = np.concatenate([*rare_keys, [np.iinfo(np.int64).max]]).astype(np.int64)
        self.rare_cells = np.concatenate([*rare_cells, [0]]).astype(np.int32)

    def codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        return self.code[np.minimum(points, len(self.code) - 1)]

    def rarely(self, state: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Where characters without a column lead, as in ``cells``; states are languages by lanes."""
        keys = state.astype(np.int64) << 21 | codes
        at = np.searchsorted(self.rare_keys, keys)
        return np.where(self.rare_keys[at] == keys, self.rare_cells[at], self.rare_starts[:, codes - self.width])

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases needed, texts by languages."""
        codes = self.codes("".join(texts))
        sizes = np.array([len(t) for t in texts])
        lanes = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = (np.cumsum(sizes) - sizes)[owner] + nth * WINDOW
        length = np.minimum(sizes[owner] - nth * WINDOW, WINDOW)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        live = np.searchsorted(-length, -np.arange(1, WINDOW + 1), side="right")
        state = np.repeat(np.array(self.roots, np.int32)[:, None], len(owner), axis=1)
        found = np.zeros(state.shape, np.int32)
        for t in range(int(length[0]) if len(length) else 0):
            m = int(live[t])
            now = codes[begin[:m] + t]
            lanes_rare = np.flatnonzero(now >= self.width)
            if len(lanes_rare):
                to = self.cells.take(state[:, :m] + np.where(now < self.width, now, 0))
                to[:, lanes_rare] = self.rarely(state[:, lanes_rare], now[lanes_rare])
            else:
                to = self.cells.take(state[:, :m] + now)
            sign = to >> 31
            found[:, :m] -= sign
            state[:, :m] = to ^ sign
        out = np.zeros((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, found[k], minlength=len(texts))
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language, share of confidence); ties go to the first language by name."""
        phrases = self.phrases(texts)
        cost = phrases * np.array(self.bits)
        best = cost.argmin(axis=1)
        # Bits are saved phrase by phrase; the damped root keeps long texts from being all ones.
        gap = (cost - cost.min(axis=1, keepdims=True)) / np.sqrt(np.maximum(cost.min(axis=1, keepdims=True), 1.0))
        return [self.languages[k] for k in best], 1 / np.exp(-SHARPNESS * np.minimum(gap, 500)).sum(axis=1)


def training_texts(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE, longest: int = LONGEST_TRAINING_ROW) -> dict[str, str]:
    """Texts to learn from by language, at most ``rows`` x ``longest`` characters each.

    Of the rows that are not held out and have a language and a text that is not empty, the least by hash in each of ``rows``
    buckets, whatever their length; of a text over ``longest`` characters a span of so many counts, at a place its hash gives.
    The choice covers all rows and takes one pass without their texts being moved.
    """
    key = F.xxhash64("doc_id", "text")
    begin = F.pmod(key, F.greatest(F.length("text") - longest, F.lit(0)) + 1) + 1
    able = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & (F.length("text") >= 1)).select(
        "lang", F.substring("text", begin.cast("int"), F.lit(longest)).alias("text"), key.alias("key"))
    # At most languages x rows numbers.
    chosen = able.groupBy("lang", F.pmod("key", F.lit(rows)).alias("bucket")).agg(F.min("key").alias("key")).select("lang", "key")
    out: dict[str, set[str]] = {}
    for r in able.join(F.broadcast(chosen), ["lang", "key"]).collect():
        out.setdefault(r["lang"], set()).add(r["text"])
    return {name: "\n".join(sorted(texts)) for name, texts in out.items()}


_PARSERS: dict[int, Parser] = {}


def _parser(training: dict[str, str]) -> Parser:
    """The parser of this training; a Python worker builds it once."""
    key = hash(tuple(sorted(training.items())))
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(training)
    return _PARSERS[key]


def identify(docs: DataFrame, training: dict[str, str], slice_chars: int = 4_000_000) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` per row of ``docs`` (doc_id, text).

    ``und`` with score 0 where the text is null or has no letter, or nothing could
    be learned. Repeated rows are answered alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(training)

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parser = _parser(shared.value)
        for batch in batches:
            texts = [t if isinstance(t, str) and has_letter(t) else None for t in batch.text]
            names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            todo = [i for i, t in enumerate(texts) if t is not None] if parser.languages else []
            while todo:
                size = n = 0
                while n < len(todo) and (n == 0 or size < slice_chars):
                    size += len(texts[todo[n]])
                    n += 1
                part, todo = todo[:n], todo[n:]
                langs, sure = parser.predict([texts[i].lower() for i in part])
                scores[part] = sure
                for i, name in zip(part, langs):
                    names[i] = name
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "held_out": batch.held_out, "lang_pred": names, "score": scores})

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInPandas(predicted, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return identify(docs.select("doc_id", "text"), training_texts(docs))
