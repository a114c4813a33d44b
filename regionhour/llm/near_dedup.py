"""Near duplicates by DartMinHash over five-word shingles.

1. Sign: every (shingle, weight strip) of a text throws a Poisson stream of hashed
   darts into its region; only darts below a height that yields about k ln k of them
   are made. Each dart falls on one of ``k`` coordinates; the earliest per coordinate stays.
2. Band: equal bands of coordinates put texts into one bucket. The member that meets most others
   over all its buckets (the likely original of a group) and the least member are the
   bucket's pivots (of three members always two different ones); all members are compared with both.
3. Verify: pairs are compared exactly by weighted Jaccard of their shingles.
4. Connect: links are contracted to classes: to trees inside each task, then by rounds that hook and shorten them.
5. The rest: a bucket that still holds several classes is compared chunk by chunk
   inside tasks, on a finer signature of its members; only pairs of different
   classes that this signature puts near the threshold leave the task, and are verified.

Equal texts are one node throughout, so a group of copies counts once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import digest, release, step, table

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 6  # a pair at 0.8 shares a band with probability 0.9993
# The rest's signature: 1024 coordinates of 8 bits. A pair at 0.8 is estimated below 0.75 with probability 3e-5.
FINE, FINE_CUT = 1024, 0.75
CHUNK = 512
FOREST = 300_000  # nodes that a task keeps in memory before it writes their trees
WORD = re.compile(r"\w+")
EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str, known: dict[str, int], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, counts). A text of fewer words is one shingle of them all; one without words has none."""
    tokens = WORD.findall(text.lower())
    if not tokens:
        return EMPTY, np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(out, return_counts=True)


def _darts(keys: np.ndarray, part: np.ndarray, height: float) -> tuple[np.ndarray, np.ndarray]:
    """(arrival, hash) of all darts of the strips ``keys`` below ``height``; a strip holds the lower ``part`` of its darts."""
    arrivals, hashes = [], []
    if height < 4:
        n, time = 0, np.zeros(len(keys))
        while len(keys):
            h = mix(keys + np.uint64((2 * n + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            time = time - np.log1p(-(h >> np.uint64(11)).astype(float) / (1 << 53))
            low = time < height
            keys, part, time, h = keys[low], part[low], time[low], h[low]
            arrivals.append(time)
            hashes.append(mix(h))
            n += 1
            if (part < 1).any():
                inside = (mix(h + np.uint64(5)) >> np.uint64(11)).astype(float) / (1 << 53) < part
                arrivals[-1], hashes[-1] = time[inside], mix(h)[inside]
        return np.concatenate(arrivals or [np.zeros(0)]), np.concatenate(hashes or [EMPTY])
    columns = int(height + 6 * math.sqrt(height) + 10)
    while True:
        with np.errstate(over="ignore"):
            salt = (2 * np.arange(columns, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)
        h = mix(keys[:, None] + salt)
        time = -np.log1p(-(h >> np.uint64(11)).astype(float) / (1 << 53)).cumsum(axis=1)
        if (time[:, -1] >= height).all():
            break
        columns *= 2
    low = time < height
    if (part < 1).any():
        low &= (mix(h + np.uint64(5)) >> np.uint64(11)).astype(float) / (1 << 53) < part[:, None]
    return time[low], mix(h[low])


def dart_signature(keys: np.ndarray, weights: np.ndarray, k: int) -> np.ndarray:
    """``k`` dart hashes of a weighted set; two sets agree at a coordinate with the probability of their weighted Jaccard similarity."""
    strips = np.ceil(weights).astype(np.int64)
    nth = np.arange(int(strips.sum())) - np.repeat(np.cumsum(strips) - strips, strips)
    part = np.minimum(1.0, np.repeat(weights, strips) - nth)
    units = mix(np.repeat(keys, strips) + nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
    height = k * (math.log(k) + 4) / float(weights.sum())
    while True:
        arrival, h = _darts(units, part, height)
        at = (h % np.uint64(k)).astype(np.int64)
        order = np.argsort(-arrival, kind="stable")  # the earliest is written last
        signature, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
        signature[at[order]] = h[order]
        filled[at] = True
        if filled.all():
            return signature
        height *= 2


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = signature.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return out.view(np.int64)


def node_of(text: Column) -> Column:
    """128 bits of the SHA-256 of a text; null counts as empty."""
    return F.unhex(F.substring(digest(text), 1, 32))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, node, weight, bands`` per row."""
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            bands, weights = [], []
            with np.errstate(over="ignore"):
                for text in batch.text:
                    keys, counts = shingles(text if isinstance(text, str) else "", known)
                    weights.append(int(counts.sum()))
                    bands.append(band_keys(dart_signature(keys, counts.astype(float), BANDS * ROWS)) if len(keys) else np.zeros(0, np.int64))
            yield pd.DataFrame({"doc_id": batch.doc_id.astype("Int64"), "node": batch.node, "weight": weights, "bands": bands})

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), node_of(F.col(text_col)).alias("node"), F.col(text_col).alias("text"))
    return rows.mapInPandas(signed, "doc_id bigint, node binary, weight bigint, bands array<bigint>")


def prints_of(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, print`` of the ``wanted`` nodes (node, doc_id): distinct shingles and their counts as bytes."""
    def printed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            with np.errstate(over="ignore"):
                both = [shingles(t, known) for t in batch.text]
            yield pd.DataFrame({"node": batch.node, "print": [keys.tobytes() + counts.astype(np.uint64).tobytes() for keys, counts in both]})

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), node_of(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = wanted.select("node", F.col("doc_id").alias("_own"))
    # Rows repeated in full would print twice; the pairs they make are reduced to one link.
    found = rows.join(own, (rows["node"] == own["node"]) & F.col("_id").eqNullSafe(F.col("_own"))).select(rows["node"], "text")
    return found.mapInPandas(printed, "node binary, print binary")


def similarity(one: bytes, two: bytes) -> float:
    """Weighted Jaccard of two prints."""
    a, b = (np.frombuffer(x, np.uint64).reshape(2, -1) for x in (one, two))
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][i], b[1][j]).sum())
    whole = int(a[1].sum() + b[1].sum()) - common
    return common / whole if whole else 1.0


def verified(pairs: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of at least that similarity."""
    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            same = [similarity(x, y) >= least for x, y in zip(batch.one, batch.two)]
            yield batch.loc[same, ["a", "b"]]

    one, two = prints.select(F.col("node").alias("a"), F.col("print").alias("one")), prints.select(F.col("node").alias("b"), F.col("print").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInPandas(compared, "a binary, b binary")


def _forest(edges: DataFrame) -> DataFrame:
    """``u, v``: each task's edges as trees of height one, v the least node that the task links to u. No shuffle."""
    def contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (above := parent.get(x)) is not None:
                top = parent.get(above)
                if top is None:
                    return above
                parent[x] = x = top
            return x

        def trees() -> pd.DataFrame:
            return pd.DataFrame({"u": list(parent), "v": [root(x) for x in list(parent)]})

        for batch in batches:
            for one, two in zip(batch.u, batch.v):
                one, two = root(one), root(two)
                if one != two:
                    parent[max(one, two)] = min(one, two)
            if len(parent) > FOREST:
                yield trees()
                parent.clear()
        yield trees()

    return edges.select("u", "v").mapInPandas(contracted, "u binary, v binary")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or linked to one centre only."""
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("up"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(None).cast("binary").alias("up"), F.lit(1).alias("centre")))
    each = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max("centre").alias("centre"))
    return each.filter("low <> high or (low is not null and centre = 1)").isEmpty()


def _shortened(edges: DataFrame) -> DataFrame:
    """Edges (u, v) of trees, one round on: parents of one node are linked to the least of them, then each edge leads to its parent's parent.

    A node has at most one parent for each task that wrote it, so its parents fit one row. A centre's many edges
    are joined by a key of their own, so that it can be split.
    """
    gathered = edges.groupBy("u").agg(F.collect_set("v").alias("ups")).withColumn("low", F.array_min("ups"))
    hooked = gathered.select(F.explode(F.array_union(F.array("u"), F.array_remove("ups", F.col("low")))).alias("u"), F.col("low").alias("v"))
    above = hooked.groupBy("u").agg(F.min("v").alias("up")).select(F.hex("u").alias("_v"), "up")
    return hooked.withColumn("_v", F.hex("v")).join(above, "_v", "left").select("u", F.coalesce("up", "v").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """``node, class`` of all linked nodes; classes are named by their least node.

    Edges are contracted to trees inside each task that reads them, and shortened by joins until only stars are left.
    """
    edges = step(_forest(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "edges")
    while not _are_stars(edges):
        shorter = step(_shortened(edges), "edges")
        before, edges = edges, step(_forest(shorter), "edges")
        release(before, shorter)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("class")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("class"))).distinct()


def unlike_members(left: DataFrame, prints: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of different classes in one bucket that the fine signature doesn't rule out.

    ``left`` has ``bucket, chunks, node, class``. Members are dealt to chunks by hash and
    every two chunks of a bucket meet in one task, so a bucket of any size is spread.
    """
    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fine, weights = [], []
            with np.errstate(over="ignore"):
                for raw in batch.print:
                    keys, counts = np.frombuffer(raw, np.uint64).reshape(2, -1)
                    fine.append((dart_signature(keys, counts.astype(float), FINE) >> np.uint64(56)).astype(np.uint8).tobytes())
                    weights.append(int(counts.sum()))
            yield pd.DataFrame({"node": batch.node, "fine": fine, "weight": weights})

    def compared(block: pd.DataFrame) -> pd.DataFrame:
        own, other = (block[block.chunk == k].sort_values("node") for k in (block.i.iloc[0], block.j.iloc[0]))
        if own.empty or other.empty:
            return pd.DataFrame({"a": [], "b": []})
        grid = np.frombuffer(b"".join(other.fine), np.uint8).reshape(len(other), -1)
        nodes, classes, weights = other.node.to_numpy(), other["class"].to_numpy(), other.weight.to_numpy()
        out = []
        for node, kind, fine, weight in zip(own.node, own["class"], own.fine, own.weight):
            able = np.flatnonzero((classes != kind) & (np.minimum(weights, weight) >= least * np.maximum(weights, weight)))
            near = (grid[able] == np.frombuffer(fine, np.uint8)).sum(axis=1) >= (FINE_CUT - SIMILARITY + least) * FINE
            out += [(min(node, x), max(node, x)) for x in nodes[able[near]]]
        return pd.DataFrame(out, columns=["a", "b"])

    named = left.select("node").distinct()
    fine = step(prints.join(named, "node", "left_semi").mapInPandas(signed, "node binary, fine binary, weight bigint"), "fine")
    chunk = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = left.withColumn("chunk", chunk).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "bucket", F.least("chunk", "with").alias("i"), F.greatest("chunk", "with").alias("j"), "chunk", "node", "class")
    return dealt.join(fine, "node").groupBy("bucket", "i", "j").applyInPandas(compared, "a binary, b binary").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``doc_id, node, class, class_id, class_size, kept`` per row of ``docs``.

    Texts linked by pairs of at least ``least`` similarity, and equal texts, are one
    class; ``class_id`` is its smallest id, whose rows are kept (all of them, if they
    repeat it). Null ids lose against others; a class of null ids keeps its rows. Texts
    without words, null ones among them, are like equal texts only.
    """
    signed = step(signatures(docs, id_col, text_col), "signatures")
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("weight").alias("weight"))
    member = signed.select(F.explode("bands").alias("bucket"), "node").distinct()
    buckets = step(member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = step(signed.select(F.explode("bands").alias("bucket"), "node").join(buckets, "bucket").distinct(), "members")
    met = members.groupBy("node").agg(F.sum("n").alias("met")).select(F.hex("node").alias("_node"), "met")
    pivots = members.withColumn("_node", F.hex("node")).join(met, "_node").groupBy("bucket").agg(
        F.max(F.struct("met", "node"))["node"].alias("first"), F.min("node").alias("least"), F.max("node").alias("greatest"), F.max("n").alias("n")).select(
        F.col("bucket").cast("string").alias("_bucket"), "first",
        # One pivot would leave the other two of three unmet.
        F.when((F.col("n") == 3) & (F.col("first") == F.col("least")), F.col("greatest")).otherwise(F.col("least")).alias("last"))
    pairs = step(members.withColumn("_bucket", F.col("bucket").cast("string")).join(pivots, "_bucket").select(
        "node", F.explode(F.array("first", "last")).alias("pivot")).filter("node <> pivot").select(
        F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct(), "pairs")
    # Every member of a bucket is in a pair.
    candidates = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    prints = step(prints_of(docs, nodes.join(candidates, "node", "left_semi"), id_col, text_col), "prints")
    links = step(verified(pairs, prints, least), "links")
    classes = step(components(links), "linked")
    # Up to three members of a bucket have all met.
    placed = members.filter("n > 3").select("bucket", "node").join(classes, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("class"))
    mixed = placed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count(F.lit(1)).alias("n")).filter(
        "low <> high").select(F.col("bucket").cast("string").alias("_bucket"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    left = step(placed.withColumn("_bucket", F.col("bucket").cast("string")).join(mixed, "_bucket").select("bucket", "chunks", "node", "class"), "left")
    if not left.isEmpty():
        rest = unlike_members(left, prints, least).join(pairs, ["a", "b"], "left_anti")
        more = step(verified(rest, prints, least), "links")
        if not more.isEmpty():
            classes = step(components(classes.select(F.col("node").alias("a"), F.col("class").alias("b")).unionByName(more)), "linked")
    rows = signed.select("doc_id", "node").join(classes, "node", "left").select("doc_id", "node", F.coalesce("class", "node").alias("class"))
    named = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")).select(
        F.hex("class").alias("_class"), "class_id", "class_size")
    out = step(rows.withColumn("_class", F.hex("class")).join(named, "_class").select(
        "doc_id", "node", "class", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")), "classes")
    release(signed, buckets, members, pairs, prints, links, left)
    return out


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class, all columns as they were."""
    kept = near_classes(docs, id_col, text_col, least).filter("kept").groupBy("class", "doc_id").agg(F.min("node").alias("node"))

    def name(node: Column, ident: Column) -> Column:
        return F.concat(F.hex(node), F.coalesce(F.concat(F.lit("v"), ident.cast("string")), F.lit("n")))

    stays = kept.select(name(F.col("node"), F.col("doc_id")).alias("_name"))
    marked = docs.withColumn("_name", name(node_of(F.col(text_col)), F.col(id_col).cast("bigint")))
    return marked.join(stays, "_name", "left_semi").dropDuplicates(["_name"]).select(*docs.columns)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_classes(docs).select("doc_id", "class_id", "class_size", "kept")
