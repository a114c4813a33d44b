"""URL filter: rules by host and path, and boosted trees on lexical features for the rest.

Addresses that a rule decides are the labelled ones; the trees learn the verdict
from length, depth, digit ratio, entropy, parameter counts and statistics of the
host's suffix, and judge every address that no rule fits.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionhour.llm.common import table

# (host, path, verdict), as the query's contract names them.
RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block"),
]
TRAINING_ROWS = 20_000  # labelled addresses that the trees are fitted on, chosen by hash
FOLDS = 5  # hosts are dealt to folds by hash
SUFFIX_BUCKETS = 1024  # suffixes are hashed, so their table has a fixed size
FEATURES = ["length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "hyphens",
            "suffix_rate", "suffix_seen"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/ ? #``, A-Z lower-cased; empty if there is none or the address is null."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the host's end to the next ``? #``; empty likewise."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rule(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none; rules as long go by name."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r_host, r_path, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == r_host) | host.endswith("." + r_host)) & path.startswith(r_path)
        found = F.when(fits, F.struct(F.lit(r_host + r_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _count(text: Column, what: str) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda acc, p: acc - p * F.log2(p))


def features(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, suffix bucket and the lexical features."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    ask = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    return pages.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col))}).withColumns({
        "length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": _count(F.col("path"), "/"), "labels": _count(F.col("host"), "."), "hyphens": _count(url, "-"),
        "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / F.greatest(F.length(url), F.lit(1)),
        "entropy": entropy(url),
        "parameters": F.when(ask == "", F.lit(0.0)).otherwise(_count(ask, "&") + 1),
        "suffix": F.pmod(F.xxhash64(F.substring_index("host", ".", -1)), F.lit(SUFFIX_BUCKETS)),
    })


def _rates(known: DataFrame, *by: str) -> DataFrame:
    """Blocked and all labelled addresses per suffix (and fold); at most SUFFIX_BUCKETS x FOLDS rows."""
    return known.groupBy("suffix", *by).agg(F.sum("label").alias("blocked"), F.count(F.lit(1)).alias("n"))


def _assembled(rows: DataFrame, blocked: Column, n: Column) -> DataFrame:
    """Adds the feature vector; a suffix's rate is pulled towards one half."""
    both = rows.withColumns({"suffix_rate": (blocked + 1) / (n + 2), "suffix_seen": F.log1p(n)})
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(both)


def labelled(seen: DataFrame) -> DataFrame:
    """The addresses that a rule decides, with ``label`` (1: block) and the ``fold`` of their host."""
    return seen.filter(F.col("found").isNotNull()).withColumns({
        "label": (F.col("found.verdict") == "block").cast("double"), "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS))})


class Judge:
    """Trees fitted on labelled addresses. While they are fitted, a row's suffix statistics come from the hosts of other folds, so they never hold its own label."""

    def __init__(self, known: DataFrame, training_rows: int = TRAINING_ROWS):
        self.rates = _rates(known)
        own = _rates(known, "fold").select("suffix", "fold", F.col("blocked").alias("own_blocked"), F.col("n").alias("own_n"))
        chosen = known.orderBy(F.xxhash64("url"), "page_id").limit(training_rows)
        joined = chosen.join(F.broadcast(self.rates), "suffix").join(F.broadcast(own), ["suffix", "fold"])
        sample = _assembled(joined, F.col("blocked") - F.col("own_blocked"), F.col("n") - F.col("own_n")).select("features", "label").persist()
        labels = {r["label"] for r in sample.select("label").distinct().collect()}
        self.constant = None if labels == {0.0, 1.0} else max(labels, default=0.0)
        if self.constant is None:
            self.model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7, maxBins=32, subsamplingRate=1.0).fit(sample)
        sample.unpersist()

    def score(self, seen: DataFrame) -> DataFrame:
        """``seen`` with ``block_score``: the trees' probability, or the only label there is."""
        if self.constant is not None:
            return seen.withColumn("block_score", F.lit(self.constant))
        rated = seen.join(F.broadcast(self.rates), "suffix", "left").fillna({"blocked": 0.0, "n": 0})
        return self.model.transform(_assembled(rated, F.col("blocked"), F.col("n"))).withColumn("block_score", vector_to_array("probability")[1])


def held_out_agreement(pages: DataFrame, rules=RULES, training_rows: int = TRAINING_ROWS) -> tuple[int, int]:
    """(addresses judged as their rule says, all) of the hosts of one fold, by trees that saw neither these hosts nor their labels."""
    known = labelled(_seen(pages, rules))
    scored = Judge(known.filter("fold <> 0"), training_rows).score(known.filter("fold = 0"))
    row = scored.agg(F.count_if((F.col("block_score") >= 0.5) == (F.col("label") == 1)).alias("same"), F.count(F.lit(1)).alias("n")).first()
    return row["same"], row["n"]


def _seen(pages: DataFrame, rules) -> DataFrame:
    return features(pages.select("page_id", "url")).withColumn("found", match_rule(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, rules=RULES, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` per row of ``pages`` (page_id, url; further columns are not read).

    Null addresses have empty host and path and are judged by the trees. If the
    labelled addresses are all of one verdict, the rest get it too; if there are
    none, the rest are allowed. Repeated rows are judged alike.
    """
    seen = _seen(pages, rules)
    scored = Judge(labelled(seen), training_rows).score(seen)
    own = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                         F.coalesce("found.verdict", own).alias("verdict"), "block_score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
