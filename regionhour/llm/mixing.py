"""Mixing sources to target weights with fixed-length token blocks.

1. Pack: the words of a source are laid end to end and cut into blocks of
   ``block_words``. Offsets are exact prefix sums, taken inside hashed chunks of a
   source and then over the chunk totals, so no source is sorted in one task.
2. Draw: every output shard has ``shard_slots`` slots; each slot draws its source
   by a hashed uniform number, so the counts of a shard are multinomial. The draws
   of a source are numbered over the shards; numbers past its quota stay empty
   and what it still lacks goes to a closing shard, so totals are exact.
3. Map: number ``n`` of a source is index ``n mod blocks`` of pass ``n div blocks``, sent
   through a keyed permutation of that source's block indexes (an affine walk).
4. Join: drawn blocks meet the packed blocks by (source, block index).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from regionhour.llm.common import BLANKS, WORD, step, table

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # of all words, as a fraction
REPEATS = 2  # a target is at most so many times its source
BLOCK_WORDS = 128
SHARD_SLOTS = 4096
SEED = 7
GAP = r"[\x20\x09-\x0D]"


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null counts 0."""
    ended = F.rtrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.length(F.regexp_replace(ended, rf"{GAP}*{WORD}", "x")).cast("long")


def source_key(source: Column) -> Column:
    """A source as a string that is never null."""
    return F.coalesce(F.concat(F.lit("v"), source), F.lit("n"))


def pack(docs: DataFrame, chunk_rows: int = 20_000, least_chunks: int = 128) -> DataFrame:
    """``doc_id, source, key, mark, chunk, nth, size, start`` per row of ``docs`` (doc_id, text, source).

    ``start`` is the offset of a document's first word in its source; (key, chunk,
    nth) names the row. Rows equal in id, size and text may change places, which
    changes no result.
    """
    n_chunks = docs.agg(F.greatest(F.lit(least_chunks), F.ceil(F.count(F.lit(1)) / chunk_rows)).cast("long")).scalar()
    sized = docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), F.xxhash64("text").alias("mark"),
                        word_count(F.col("text")).alias("size"))
    sized = step(sized.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "mark"), n_chunks)), "mix-sizes")
    upto = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sized.groupBy("key", "chunk").agg(F.sum("size").alias("all")).select(
        "key", "chunk", F.coalesce(F.sum("all").over(upto), F.lit(0)).alias("chunk_start"))
    inside = Window.partitionBy("key", "chunk").orderBy("doc_id", "mark", "size")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumns({"nth": F.row_number().over(inside), "inner": F.coalesce(F.sum("size").over(before), F.lit(0))})
    return placed.join(offsets, ["key", "chunk"]).select(
        "doc_id", "source", "key", "mark", "chunk", "nth", "size", (F.col("chunk_start") + F.col("inner")).alias("start"))


def targets(sizes: DataFrame) -> DataFrame:
    """``key, source_size`` -> also ``weight, target``: the level of a filling over the sources.

    Sources by code point, null last, weigh 5, 2, 1, repeating. Each gets
    min(cap, weight x level) with cap = 2 x its size; the level spends 150 % of all
    words. Sums are of integers, so reruns agree to the last bit. The table has one
    row per source; only here one task sees all of them.
    """
    rank = F.row_number().over(Window.orderBy(F.col("key") == "n", "key")) - 1
    weights = F.array(*[F.lit(w).cast("long") for w in WEIGHTS])
    weighed = sizes.withColumn("weight", F.get(weights, rank % len(WEIGHTS)))
    # Sources reach their caps in the order of cap / weight.
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sums = weighed.withColumns({
        "left": F.sum("source_size").over(whole) * SHARE[0] - F.coalesce(F.sum("source_size").over(before), F.lit(0)) * (REPEATS * SHARE[1]),
        "room": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "place": F.row_number().over(order),
    })
    # A source is at its cap if the level reached by all those below it would fill it.
    full = F.col("left") * F.col("weight") >= F.col("source_size") * (REPEATS * SHARE[1]) * F.col("room")
    first = F.min(F.when(~full, F.struct("place", "left", "room"))).over(whole)
    cap = (F.col("source_size") * REPEATS).cast("double")
    return sums.withColumn("first", first).select(
        "key", "source_size", "weight",
        F.when(F.col("place") >= F.col("first.place"), F.col("first.left") * F.col("weight") / (F.col("first.room") * SHARE[1]))
        .otherwise(cap).alias("target"))


def _keyed_walk(blocks: Column, *key: Column) -> Column:
    """(stride, shift) of a bijection i -> (i * stride + shift) mod blocks.

    The stride is the first of 24 numbers from a keyed start on that shares no
    divisor with ``blocks``; failing all, 1.
    """
    start = F.pmod(F.xxhash64(F.lit(SEED), *key), F.lit(1 << 20)) + 1

    def divisor(a: Column) -> Column:
        pair = F.struct(a.alias("a"), blocks.alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(64)), pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(
            F.struct(p["b"].alias("a"), F.pmod(p["a"], F.greatest(p["b"], F.lit(1))).alias("b"))))["a"]

    fitting = F.filter(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda d: start + d), lambda s: divisor(s) == 1)
    return F.struct(F.coalesce(F.get(fitting, F.lit(0)), F.lit(1)).alias("stride"),
                    F.pmod(F.xxhash64(F.lit(SEED + 1), *key), blocks).alias("shift"))


def quotas(goals: DataFrame, block_words: int) -> DataFrame:
    """Targets as whole blocks: ``blocks`` of a source, ``quota`` to draw, ``upto`` in the ladder of draws, ``walks`` by pass."""
    blocks = F.ceil(F.col("source_size") / block_words).cast("long")
    # A mean block has source_size / blocks words, as the last one is shorter.
    quota = F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long"), F.col("blocks") * REPEATS)
    ladder = Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    return goals.filter("source_size > 0").withColumn("blocks", blocks).withColumn("quota", quota).withColumns({
        "upto": F.sum("quota").over(ladder),
        "walks": F.array(*[_keyed_walk(F.col("blocks"), F.col("key"), F.lit(p)) for p in range(REPEATS)]),
    }).drop("weight")


def draw_plan(quota: DataFrame, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix: ``shard, key, pass, block``, one row per drawn block (shard -1 closes)."""
    # The ladder has one entry per source; a slot climbs it to find its source.
    ladder = quota.agg(F.max("upto").alias("slots"), F.sort_array(F.collect_list(F.struct("upto", "key"))).alias("ladder")).filter("slots > 0")
    shards = ladder.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / shard_slots))).alias("shard"))
    # Rows that are few now and many once expanded: the number of tasks must not follow their size.
    tasks = int(quota.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = shards.repartition(tasks, "shard")
    first_slot = F.col("shard") * shard_slots
    slots = shards.select("*", F.explode(F.sequence(first_slot, F.least(F.col("slots"), first_slot + shard_slots) - 1)).alias("slot"))
    # A 53-bit hashed number, scaled to the ladder's length.
    pick = F.floor(F.shiftrightunsigned(F.xxhash64(F.lit(SEED + 2), F.col("slot")), 11) / F.lit(float(1 << 53)) * F.col("slots"))
    drawn = slots.withColumn("pick", pick).select("shard", F.get(F.filter("ladder", lambda r: r["upto"] > F.col("pick")), F.lit(0))["key"].alias("key"))
    counts = drawn.groupBy("shard", "key").agg(F.count(F.lit(1)).alias("drawn"))
    before = Window.partitionBy("key").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = counts.withColumn("first", F.coalesce(F.sum("drawn").over(before), F.lit(0)))
    # What the shards lack: from the end of a source's numbers up to its quota.
    ends = numbered.groupBy("key").agg(F.max(F.col("first") + F.col("drawn")).alias("first"))
    closing = quota.join(ends, "key", "left").select(
        F.lit(-1).cast("long").alias("shard"), "key", F.coalesce("first", F.lit(0)).alias("first"), "quota").select(
        "shard", "key", (F.col("quota") - F.col("first")).alias("drawn"), "first").filter("drawn > 0")
    spans = numbered.unionByName(closing).join(quota.select("key", "blocks", "quota", "walks"), "key").filter("first < quota")
    last = F.least(F.col("first") + F.col("drawn"), F.col("quota"))
    # Spans are cut to a shard's length and dealt out before they are expanded.
    cut = spans.select("shard", "key", "blocks", "walks", last.alias("last"), F.explode(F.sequence("first", last - 1, F.lit(shard_slots))).alias("at"))
    cut = cut.repartition(tasks, "key", "at")
    numbers = cut.select("shard", "key", "blocks", "walks", F.explode(F.sequence("at", F.least(F.col("at") + shard_slots, F.col("last")) - 1)).alias("n"))
    turn = F.floor(F.col("n") / F.col("blocks"))
    walk = F.get("walks", turn.cast("int"))
    return numbers.select("shard", "key", turn.alias("pass"), F.pmod(
        (F.col("n") % F.col("blocks")) * walk["stride"] + walk["shift"], F.col("blocks")).alias("block"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(one row per source with ``source_size, target``; segments).

    Segments: every packed row, exploded to the blocks it lies in, with the drawn
    ``shard, pass`` of each and ``from_word, n_words`` inside the document; a row or
    block that is not drawn, and a row without words, has nulls there. A block is
    drawn at most twice, so no document is taken more than twice.
    """
    packed = step(pack(docs), "mix-packed")
    goals = targets(packed.groupBy("key").agg(F.sum("size").alias("source_size")))
    quota = step(quotas(goals, block_words), "mix-quotas")
    plan = draw_plan(quota, shard_slots)
    begin, end = F.col("start"), F.col("start") + F.col("size")
    pieces = packed.select("*", F.explode_outer(F.when(F.col("size") > 0, F.sequence(
        F.floor(begin / block_words), F.floor((end - 1) / block_words)))).alias("block"))
    low = F.greatest(begin, F.col("block") * block_words)
    high = F.least(end, (F.col("block") + 1) * block_words)
    # Spark's estimate of the plan doesn't count the rows that exploding makes, so a broadcast would grow with the words: both sides are sorted.
    segments = pieces.join(plan.hint("merge"), ["key", "block"], "left").select(
        "doc_id", "source", "key", "mark", "chunk", "nth", "size", "shard", "pass", "block",
        F.when(F.col("shard").isNotNull(), low - begin).alias("from_word"), F.when(F.col("shard").isNotNull(), high - low).alias("n_words"))
    return goals, segments


def taken_words(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken``."""
    goals, segments = mix(docs, block_words, shard_slots)
    taken = segments.groupBy("key", "chunk", "nth").agg(
        F.first("doc_id").alias("doc_id"), F.first("size").alias("size"), F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("taken"))
    return taken.join(goals, "key").select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """The mix as documents, in the columns of ``docs``: one row per document and pass with the words taken.

    A document taken whole keeps its text as it is; of others the taken
    words stay, with the white space behind them. ``n_chars``, if there, follows the text.
    """
    _, segments = mix(docs.select("doc_id", "text", "source"), block_words, shard_slots)
    parts = segments.filter("n_words > 0").groupBy("key", "chunk", "nth", "pass").agg(
        F.first("doc_id").alias("_id"), F.first("mark").alias("_mark"), F.first("size").alias("_size"),
        F.sort_array(F.collect_list(F.struct("from_word", "n_words"))).alias("_parts"), F.sum("n_words").alias("_taken"))
    named = F.concat(source_key(F.col("doc_id").cast("string")), F.lit(":"), F.xxhash64("text").cast("string"))
    texts = docs.withColumn("_name", F.concat(named, F.lit(":"), source_key(F.col("source"))))
    # Rows repeated in full stand for each other: one of them brings the text to all their parts.
    parts = parts.select(F.concat(source_key(F.col("_id").cast("string")), F.lit(":"), F.col("_mark").cast("string"), F.lit(":"), F.col("key")).alias("_name"),
                         "_size", "_parts", "_taken")
    words = F.split(F.ltrim("text", F.lit(BLANKS)), rf"(?<={GAP})(?={WORD[:-1]})")
    cut = F.array_join(F.transform("_parts", lambda p: F.array_join(F.slice(words, p["from_word"].cast("int") + 1, p["n_words"].cast("int")), "")), "")
    text = F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(cut)
    joined = texts.dropDuplicates(["_name"]).join(parts, "_name").withColumn("text", text)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.length("text").cast("long"))
    return joined.select(*docs.columns)


def op6_mix_sources(spark, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
