"""Exact deduplication: a binomial tree-merge of sorted runs of digests.

The entries of the input partitions with one number modulo ``runs`` are a run. A run is sorted by digest and holds one entry per
text: its proof, its best identifier and its number of copies. In round r the runs whose number has bit r set are exchanged to those without it,
and two sorted runs are merged into one: Spark's sort aggregate walks the merged order and folds neighbours of equal proof, keeping the
best identifier, which carries whether it is known. Equal digests are one text only if length and a second hash agree, at every level. A run
is spread over the cluster by digest, also the last one, so no task ever holds a run. A group of copies is one
entry per run after the first fold and halves with every round, so its size never matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionhour.llm.common import digest, table

# An entry is identified by its SHA-256, checked by byte length and a second hash:
# texts that differ in one of the three are never merged, at any level.
PROOF = ["sha", "octets", "check"]
RUNS = 64  # six rounds


def _entries(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), F.unhex(digest(F.col(text_col))).alias("sha"),
        F.octet_length(text).alias("octets"), F.xxhash64(text).alias("check"),
    )


def _folded(level: DataFrame, run: Column, best) -> DataFrame:
    """Entries of a run in order of their proof, neighbours of equal proof folded into one.

    A struct can't be kept in a hash aggregate's buffer, so Spark sorts the run where it lies, folds it, exchanges it, and merges and folds what arrives.
    """
    return level.groupBy(run.alias("run"), *PROOF).agg(best("best").alias("best"), F.sum("copies").alias("copies"))


def merged_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS) -> DataFrame:
    """One row per distinct text: proof columns, ``best`` identifier, ``copies``. ``runs`` is a power of two.

    Null identifiers lose against any other; a group of null identifiers has a null best.
    """
    best, known = {"smallest": (F.min, F.col("id").isNull()), "largest": (F.max, F.col("id").isNotNull())}[keep]
    entries = _entries(docs, id_col, text_col).select(
        (F.spark_partition_id() % runs).alias("run"), *PROOF, F.struct(known.alias("known"), "id").alias("best"), F.lit(1).cast("long").alias("copies"))
    level = _folded(entries, F.col("run"), best)
    for bit in range(runs.bit_length() - 1):
        # The other partner of a pair, i + 2^bit, brings its run to i.
        level = _folded(level, F.col("run").bitwiseAND(F.lit(runs - 1 - (1 << bit))), best)
    return level.select(*PROOF, F.col("best.id").alias("best"), "copies")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS) -> DataFrame:
    """One row per document: id, ``keep_id``, ``group_size`` (rows), ``kept``, ``text_sha256``.

    Null text counts as empty. Rows repeated with the id that stays are one
    document: all are marked kept. In a group whose ids are all null the rows
    are kept. Further columns are not read.
    """
    final = merged_runs(docs, id_col, text_col, keep, runs).select(
        F.lower(F.hex("sha")).alias("text_sha256"), F.col("octets").alias("_octets"), F.col("check").alias("_check"),
        F.col("best").alias("keep_id"), F.col("copies").alias("group_size"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(id_col), digest(F.col(text_col)).alias("text_sha256"),
                       F.octet_length(text).alias("_octets"), F.xxhash64(text).alias("_check"))
    # Both sides meet by the hexadecimal digest, in an exchange of their own that adaptive execution can split.
    return rows.join(final, ["text_sha256", "_octets", "_check"]).select(
        id_col, "keep_id", "group_size", F.col(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """``docs`` with one row per distinct text, all columns as they were; repeated rows are reduced to one."""
    def proof(sha, octets, check, ident):
        named = F.coalesce(F.concat(F.lit("v"), ident.cast("string")), F.lit("n"))
        return F.concat_ws(":", sha, octets.cast("string"), check.cast("string"), named)

    final = merged_runs(docs, id_col, text_col, keep)
    stays = final.select(proof(F.lower(F.hex("sha")), F.col("octets"), F.col("check"), F.col("best")).alias("_proof"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    marked = docs.withColumn("_proof", proof(digest(F.col(text_col)), F.octet_length(text), F.xxhash64(text), F.col(id_col)))
    return marked.join(stays, "_proof", "left_semi").dropDuplicates(["_proof"]).select(*docs.columns)


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents", "doc_id", "text"), keep="largest")


OP8_SQL = """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
