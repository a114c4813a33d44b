"""Approximate nearest neighbours by a hash-prefix forest.

Each tree hashes a vector to a string of ``BITS`` signs of random directions. A tree
is cut into cells of about ``cell_rows`` rows by the first bits, and a cell by a salt into blocks of
about ``BLOCK_VALUES`` numbers (so many equal vectors are spread too), its queries likewise; a block
keeps its strings as one sorted array. A query descends to its longest-prefix match in every
block of its cell and reports how many rows each shorter prefix adds; prefixes shorter
than a cell's are counted from the sizes of the cells. The forest then ascends from the longest
matches, one bit at a time and one tree after the other, past the cell where it has to, until the
query has gathered the wanted number of places.

That number is fitted on a bounded sample of queries: they meet every row, and it is the number of
places after which ``RECALL`` of their nearest rows are reached. Clustered vectors need few places,
vectors without structure most of the table.

Rows are scored where they lie: a block holds rows of one cell of the first tree with their vectors
and one sorted array per tree. A query marks what its prefixes cover in all arrays and is compared with each marked
row once, exactly on the original vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from regionhour.llm.common import step, table

BITS = 62
TREES = 8
CELL_ROWS = 65_536
CELL = ["dim", "tree", "prefix"]
BLOCK_VALUES = 1 << 19  # numbers of a block's rows, and of its queries: bounds a task's memory at any vector length and stays near the processor's caches
# Part of the sampled queries' nearest rows that the fitted number of places has to reach.
RECALL = 0.95
SAMPLE = 256
FEWEST_SAMPLED = 32
MOST_TASKS = 10_000
TOP = 20
SEED = 11


def directions(dim: int, tree: int) -> np.ndarray:
    """The tree's random directions, one more component than the vectors have."""
    return np.random.default_rng([SEED, dim, tree]).standard_normal((dim + 1, BITS))


def hash_strings(vectors: np.ndarray, lift: np.ndarray, tree: int) -> np.ndarray:
    """Sign strings as integers, first sign highest; ``lift`` is each vector's further component."""
    planes = directions(vectors.shape[1], tree)
    signs = vectors @ planes[:-1] + lift[:, None] * planes[-1] >= 0
    return signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part, as ``vec_id, v`` (doubles), ``dim`` and ``norm2``; a repeated row counts once."""
    v = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(sound).select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v"))
    return rows.withColumns({"dim": F.size("v"), "norm2": F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)})


def _hashed(longest: dict[int, float], trees: int, every: int):
    """Adds the hash strings of a row, and those without lift where the row is a query (``every``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                v = np.stack(part.v.to_numpy())
                # The further component makes all rows equally long: the largest product is then the nearest direction.
                lift = np.sqrt(np.maximum(0.0, longest[int(dim)] - part.norm2.to_numpy()))
                asks = part.vec_id.to_numpy() % every == 0
                asked = np.stack([hash_strings(v[asks], np.zeros(int(asks.sum())), t) for t in range(trees)], axis=1)
                strings = pd.Series([None] * len(part), part.index, object)
                strings[part.index[asks]] = pd.Series(list(asked), part.index[asks], object)
                yield part[["vec_id", "dim", "v"]].assign(
                    hs=list(np.stack([hash_strings(v, lift, t) for t in range(trees)], axis=1)), qs=strings)
    return run


def _ranges(rows: np.ndarray, asked: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end in the sorted array of the rows that share the first ``bits`` bits with each query."""
    low = asked >> (BITS - bits) << (BITS - bits)
    return np.searchsorted(rows, low), np.searchsorted(rows, low + (1 << (BITS - bits)))


def _shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of leading bits that two strings share."""
    x = a ^ b
    high, low = x >> 31, x & (1 << 31) - 1
    # The exponent of a number below 2^53 is its bit length.
    return BITS - np.where(high > 0, 31 + np.frexp(high.astype(float))[1], np.frexp(low.astype(float))[1])


def _descend(first: int):
    """Per query of a cell's block, the rows that share exactly 0 .. BITS bits; levels that add no row are left out."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        rows, asked = np.sort(block.h[~block["query"]].to_numpy()), block[block["query"]]
        h = asked.h.to_numpy()
        at_least = np.stack([np.subtract(*_ranges(rows, h, b)[::-1]) for b in range(first, BITS + 1)] + [np.zeros(len(h), int)], axis=1)
        exactly = at_least[:, :-1] - at_least[:, 1:]
        query, level = np.nonzero(exactly)
        return pd.DataFrame({"vec_id": asked.vec_id.to_numpy()[query], "dim": asked.dim.to_numpy()[query],
                             "tree": asked.tree.to_numpy()[query], "level": level + first, "n": exactly[query, level]})
    return run


def _exact(sample: list, top: int):
    """The nearest rows of each sampled query among a task's rows, and the step of the ascent that reaches each."""
    asked = pd.DataFrame(sample, columns=["vec_id", "dim", "v", "qs"])
    groups = {int(d): (g.vec_id.to_numpy(), np.stack(g.v.to_numpy()), np.stack(g.qs.to_numpy())) for d, g in asked.groupby("dim")}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                if int(dim) not in groups:
                    continue
                ids, v, strings = groups[int(dim)]
                own, hs = part.vec_id.to_numpy(), np.stack(part.hs.to_numpy())
                scores = v @ np.stack(part.v.to_numpy()).T
                scores[ids[:, None] == own] = -np.inf
                at = np.argsort(-scores, axis=1)[:, :top]
                trees = hs.shape[1]
                # Longest match first, trees in their order: the least place of a row in that order.
                place = ((BITS - _shared(hs[at], strings[:, None, :])) * trees + np.arange(trees)).min(axis=2)
                found = (np.take_along_axis(scores, at, axis=1), own[at], BITS - place // trees, place % trees)
                if dim in best:
                    found = tuple(np.concatenate(x, axis=1) for x in zip(best[dim], found))
                    keep = np.argsort(-found[0], axis=1)[:, :top]
                    found = tuple(np.take_along_axis(x, keep, axis=1) for x in found)
                best[dim] = found
        for dim, (scores, own, level, tree) in best.items():
            query, i = np.nonzero(scores > -np.inf)
            yield pd.DataFrame({"query_id": groups[int(dim)][0][query], "dim": dim, "vec_id": own[query, i],
                                "score": scores[query, i], "level": level[query, i], "tree": tree[query, i]})
    return run


def _ascend(top: int):
    """Scores each row of the block that shares the wanted prefix of some tree with a query, once; the best ``top`` of them."""
    def run(block: pd.DataFrame) -> pd.DataFrame:
        is_query = block["query"].to_numpy()
        rows, out = block[~is_query], []
        if len(rows) and is_query.any():
            ids, v, strings = rows.vec_id.to_numpy(), np.stack(rows.v.to_numpy()), np.stack(rows.hs.to_numpy())
            orders = [np.argsort(h, kind="stable") for h in strings.T]
            arrays = [h[order] for h, order in zip(strings.T, orders)]
            for q in block[is_query].itertuples():
                hit = np.zeros(len(ids), bool)
                for order, array, h, bits in zip(orders, arrays, q.hs, q.depth):
                    low, high = _ranges(array, np.array([h]), int(bits))
                    hit[order[int(low[0]):int(high[0])]] = True
                hit &= ids != q.vec_id
                hits = np.flatnonzero(hit)
                # A product of matrices may round equal rows differently: it only finds who can be among the best.
                rough = v[hits] @ q.v
                edge = np.partition(rough, len(rough) - top)[len(rough) - top] if len(rough) > top else -np.inf
                able = hits[rough >= edge - 1e-9 * max(1.0, abs(edge))] if np.isfinite(edge) else hits
                own, scores = ids[able], (v[able] * q.v).sum(axis=1)
                best = np.lexsort((own, -scores))[:top]
                # The number of rows scored stands on the first row of the block only, so it can be added up.
                scored = np.zeros(len(best), int)
                scored[:1] = len(hits)
                out.append(pd.DataFrame({"query_id": q.vec_id, "vec_id": own[best], "score": scores[best], "scored": scored}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "scored": []}).astype(
            {"query_id": int, "vec_id": int, "score": float, "scored": int})
    return run


def _dealt(held: DataFrame, asked: DataFrame, cells: DataFrame, key: list[str], block_values: int) -> DataFrame:
    """Rows and queries of the cells that are asked, with ``part`` and ``chunk``.

    A cell's rows are dealt to parts and its queries to chunks by a salt; every part meets every chunk in one block,
    bounded on both sides. A query counts as no fewer numbers than its counts per prefix have.
    """
    chunks = asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) * F.greatest("dim", F.lit(BITS + 1)) / block_values).cast("int").alias("chunks"))
    sizes = cells.select(*key, "parts").join(chunks, key)

    def one(of: str, into: str, other: str, every: str) -> list[Column]:
        return [F.pmod(F.xxhash64("vec_id"), F.col(of)).cast("int").alias(into), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(every)]

    return held.join(sizes, key).select(*held.columns, *one("parts", "part", "chunks", "chunk")).unionByName(
        asked.join(sizes, key).select(*asked.columns, *one("chunks", "chunk", "parts", "part")))


def _places_wanted(hashed: DataFrame, ascent: DataFrame, sizes: list, trees: int, top: int, recall: float, sample: int) -> dict[int, int]:
    """Per vector length, the places after which ``recall`` of the sampled queries' nearest rows are reached.

    At most ``sample`` queries, the least by hash, meet every row. A length with fewer than ``FEWEST_SAMPLED`` of
    them has few rows beside the others and is searched whole.
    """
    asked = hashed.filter("qs IS NOT NULL").select("vec_id", "dim", "v", "qs").orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    near = hashed.select("vec_id", "dim", "v", "hs").mapInPandas(
        _exact(asked, top), "query_id bigint, dim int, vec_id bigint, score double, level int, tree int")
    order = Window.partitionBy("query_id", "dim").orderBy(F.col("score").desc(), "vec_id")
    nearest_rows = near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).drop("vec_id", "score", "rank")
    needed = nearest_rows.join(ascent.withColumnRenamed("vec_id", "query_id"), ["query_id", "dim", "level", "tree"])
    found = {r["dim"]: r for r in needed.groupBy("dim").agg(
        F.ceil(F.percentile("places", F.lit(recall))).alias("places"), F.count_distinct("query_id").alias("queries")).collect()}
    # A row has a place in each tree, so this many places are at least ``top`` rows beside the query's own.
    fewest = trees * (top + 1)
    return {r["dim"]: min(trees * r["n"], max(fewest, int(found[r["dim"]]["places"])))
            if r["dim"] in found and found[r["dim"]]["queries"] >= FEWEST_SAMPLED else trees * r["n"] for r in sizes}


def candidates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = TOP,
               trees: int = TREES, cell_rows: int = CELL_ROWS, block_values: int = BLOCK_VALUES, recall: float = RECALL,
               sample: int = SAMPLE) -> DataFrame:
    """``query_id, vec_id, score, scored``: the best ``top`` rows of every block; ``scored`` adds up to the rows a query was compared with."""
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    # One row for each vector length.
    sizes = rows.groupBy("dim").agg(F.max("norm2").alias("top"), F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, score double, scored bigint")
    first = max(0, math.ceil(math.log2(max(1, max(r["n"] for r in sizes) / cell_rows))))
    hashed = step(rows.mapInPandas(_hashed({r["dim"]: r["top"] for r in sizes}, trees, every),
                                   "vec_id bigint, dim int, v array<double>, hs array<bigint>, qs array<bigint>"), "hashes")
    queries = hashed.filter("qs IS NOT NULL")

    def by_tree(df: DataFrame, strings: str, *more: str) -> DataFrame:
        return df.select("vec_id", "dim", *more, F.posexplode(strings).alias("tree", "h")).withColumn("prefix", F.shiftright("h", BITS - first))

    held, asked = (by_tree(df, strings).withColumn("query", F.lit(query)) for df, strings, query in ((hashed, "hs", False), (queries, "qs", True)))
    # One row for each cell that holds rows.
    cells = step(held.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")).withColumn(
        "parts", F.ceil(F.col("n") / block_values).cast("int")), "cells")  # strings only, one number a row
    gains = _dealt(held, asked, cells, CELL, block_values).groupBy(*CELL, "part", "chunk").applyInPandas(
        _descend(first), "vec_id bigint, dim int, tree int, level int, n bigint")
    if first:
        # Rows that share fewer bits than a cell has: those of all cells below the sibling of a prefix, also for a query whose own cell is empty.
        below = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(first - 1)))).withColumn(
            "up", F.expr(f"shiftright(prefix, {first - 1} - level)")).groupBy("dim", "tree", "level", "up").agg(F.sum("n").alias("n"))
        gains = gains.unionByName(asked.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(first - 1)))).withColumn(
            "up", F.expr(f"shiftright(prefix, {first - 1} - level) ^ 1")).join(below, ["dim", "tree", "level", "up"]).select(
            "vec_id", "dim", "tree", "level", "n"))
    # The forest ascends from the longest matches, one tree after the other at each length: places gathered after each step.
    order = Window.partitionBy("vec_id", "dim").orderBy(F.col("level").desc(), "tree")
    ascent = step(gains.groupBy("vec_id", "dim", "tree", "level").agg(F.sum("n").alias("n")).withColumn(
        "places", F.sum("n").over(order)).drop("n"), "ascent")
    wanted = F.create_map(*[F.lit(x) for pair in _places_wanted(hashed, ascent, sizes, trees, top, recall, sample).items() for x in pair])
    stop = ascent.filter(F.col("places") >= wanted[F.col("dim")]).groupBy("vec_id", "dim").agg(
        F.min(F.struct((-F.col("level")).alias("up"), "tree")).alias("stop"))
    # Trees after the last one that ascended stay one bit deeper.
    depth = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.least(
        F.lit(BITS), -F.col("stop.up") + F.when(t > F.col("stop.tree"), 1).otherwise(0)).cast("int"))
    reach = step(queries.join(stop, ["vec_id", "dim"]).select("vec_id", "dim", "v", F.col("qs").alias("hs"), depth.alias("depth")), "reach")
    # Rows lie in the cells of the first tree; a query goes to those that hold rows below one of its prefixes.
    home = F.shiftright(F.col("hs")[0], BITS - first).alias("home")
    places = hashed.select("vec_id", "dim", "v", "hs", F.lit(None).cast("array<int>").alias("depth"), F.lit(False).alias("query"), home)
    homes = by_tree(hashed.withColumn("home", home), "hs", "home").groupBy(*CELL, "home").agg(F.lit(1).alias("one")).withColumn(
        "level", F.explode(F.sequence(F.lit(0), F.lit(first)))).withColumn("up", F.expr(f"shiftright(prefix, {first} - level)")).select(
        "dim", "tree", "level", "up", "home").distinct()
    visits = by_tree(reach, "hs", "depth").withColumn("level", F.least(F.col("depth")[F.col("tree")], F.lit(first))).withColumn(
        "up", F.expr(f"shiftright(prefix, {first} - level)")).join(homes, ["dim", "tree", "level", "up"]).select("vec_id", "dim", "home").distinct()
    goes = reach.withColumn("query", F.lit(True)).join(visits, ["vec_id", "dim"])
    sized = cells.filter("tree = 0").select("dim", F.col("prefix").alias("home"), F.ceil(
        F.col("n") * (F.col("dim") + trees) / block_values).cast("int").alias("parts"))
    # Few bytes mean much work here, so adaptive execution may not merge these tasks.
    tasks = min(MOST_TASKS, 4 * sum(math.ceil(r["n"] * (r["dim"] + trees) / block_values) for r in sizes))
    block = ["dim", "home", "part", "chunk"]
    return _dealt(places, goes.select(*places.columns), sized, ["dim", "home"], block_values).repartition(tasks, *block).groupBy(
        *block).applyInPandas(_ascend(top), "query_id bigint, vec_id bigint, score double, scored bigint")


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, top: int = TOP,
            trees: int = TREES, cell_rows: int = CELL_ROWS, block_values: int = BLOCK_VALUES, recall: float = RECALL,
            sample: int = SAMPLE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` rows of largest inner product found for each query.

    Queries are the rows whose id divides by ``every``; every other row is a candidate.
    Null, zero and non-finite vectors and null ids take no part; vectors meet those of
    their own length. Rows repeated with one id count once; an empty table gives no rows.
    """
    found = candidates(vectors, id_col, vector_col, every, top, trees, cell_rows, block_values, recall, sample)
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
