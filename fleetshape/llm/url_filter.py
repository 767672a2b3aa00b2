"""URL filter: longest matching rule, else gradient-boosted trees on lexical features.

Features of a URL: length, host length, path depth, digit ratio, character entropy, parameter
count, hyphens, dots, and the share of blocked URLs among labelled ones with the same suffix
(smoothed). Trees are trained on a bounded hash sample of the labelled URLs; there a URL's share comes from the other
folds of the sample, so that its own label is not among what it is judged by.

Rules are a fixed table; each is tested against every URL with plain string functions.

Only DataFrame functions and Spark's own trees. Defined results: null and URLs without `://` have
an empty host and path and no rule, and are judged by the trees like others (null: as empty);
without labels of both kinds the verdict is the one that all labels have, else allow; repeated
rows are judged row by row; an empty table gives an empty one; further columns do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetshape.llm.frames import stored

#: Host and path of each rule, and its verdict.
RULES: tuple[tuple[str, str, str], ...] = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)
#: Labelled URLs that trees are trained on, at most about: the bound of the sample.
SAMPLE = 4_000
TREES, DEPTH, SEED = 12, 4, 7
#: Parts of the sample, each of which has its suffix shares from the others, and rows that the overall share counts for.
FOLDS, PRIOR = 5, 20
FEATURES = ["n_chars", "n_host", "depth", "digits", "entropy", "n_params", "hyphens", "dots", "suffix_rate"]


def host_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    after = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The rule that fits, as a struct (rule, verdict); of several the longest; null if none."""
    def fits(h: str, p: str) -> Column:
        return ((host == h) | host.endswith("." + h)) & path.startswith(p)

    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    return reduce(lambda c, r: c.when(fits(r[0], r[1]), F.struct(F.lit(r[0] + r[1]).alias("rule"), F.lit(r[2]).alias("verdict"))), longest, F)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def _entropy(url: Column) -> Column:
    """Shannon entropy of the characters; all that is not printable ASCII counts as one, so few are distinct."""
    plain = F.regexp_replace(url, r"[^\x21-\x7E]", "~")
    n = F.greatest(F.length(plain), F.lit(1))
    shares = F.transform(F.array_distinct(F.split(plain, "")), lambda c: F.when(
        c != "", (F.length(plain) - F.length(F.replace(plain, c, F.lit("")))) / n).otherwise(0.0))
    return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """`df` with host, path, suffix and the features that need no labels."""
    u = F.coalesce(df[url], F.lit(""))
    parts = df.withColumns({"host": host_of(df[url]), "path": path_of(df[url])})
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    count = lambda text, letters: F.regexp_count(text, F.lit(letters)).cast("double")
    return parts.withColumns({
        "suffix": suffix_of(F.col("host")), "n_chars": F.length(u).cast("double"), "n_host": F.length("host").cast("double"),
        "depth": count(F.col("path"), "/[^/]"), "digits": count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)),
        "entropy": _entropy(u), "n_params": count(query, "[^&]+"), "hyphens": count(F.col("host"), "-"), "dots": count(F.col("host"), r"\.")})


class Judge:
    """Trained trees with the suffix table they were trained with."""

    def __init__(self, suffixes: DataFrame | None, base: float, trees=None):
        self.suffixes, self.base, self.trees = suffixes, base, trees

    def with_suffix(self, df: DataFrame) -> DataFrame:
        # At most SAMPLE rows, whatever the input: one per suffix of the sample.
        return df.join(F.broadcast(self.suffixes), "suffix", "left").withColumn("suffix_rate", F.coalesce("suffix_rate", F.lit(self.base)))

    def blocked(self, df: DataFrame) -> DataFrame:
        """`df` (from `lexical`) with `p_block`."""
        if self.trees is None:
            return df.withColumn("p_block", F.lit(self.base))
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(self.with_suffix(df))
        scored = self.trees.transform(vectors)
        return scored.withColumn("p_block", vector_to_array("__probability")[1])


def _rates(counts: DataFrame, base: float) -> DataFrame:
    """Counts (bad, n) as a smoothed `suffix_rate`."""
    return counts.withColumn("suffix_rate", (F.col("bad") + PRIOR * base) / (F.col("n") + PRIOR)).drop("bad", "n")


def out_of_fold(rows: DataFrame, base: float) -> DataFrame:
    """`rows` (url, suffix, label) with the suffix rate that the rows of the other folds give. Of the sample's size, like all here."""
    folded = rows.withColumn("__fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    own = folded.groupBy("suffix", "__fold").agg(F.sum("label").alias("own_bad"), F.count(F.lit(1)).alias("own_n"))
    whole = own.groupBy("suffix").agg(F.sum("own_bad").alias("all_bad"), F.sum("own_n").alias("all_n"))
    rest = own.join(whole, "suffix").select("suffix", "__fold", (F.col("all_bad") - F.col("own_bad")).alias("bad"), (F.col("all_n") - F.col("own_n")).alias("n"))
    return folded.join(_rates(rest, base), ["suffix", "__fold"]).drop("__fold")


def train(labelled: DataFrame, sample: int = SAMPLE) -> Judge:
    """Judge of `labelled` (url, blocked: boolean): each distinct URL once, blocked if most of its labels say so.

    The sample is every k-th hash of the URLs, k so that about `sample` remain; one key's copies never multiply.
    """
    known = labelled.where("blocked is not null and url is not null").groupBy("url").agg(F.avg(F.col("blocked").cast("double")).alias("share"))
    known = stored(known.select("url", (F.col("share") > 0.5).cast("double").alias("label")), "urls")
    n, positive = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, n):
        return Judge(None, 1.0 if positive else 0.0)
    drawn = known.where(F.pmod(F.xxhash64("url"), F.lit(1_000_003)) < F.lit(min(1.0, sample / n) * 1_000_003))
    rows = stored(lexical(drawn), "features")
    base = positive / n
    suffixes = stored(_rates(rows.groupBy("suffix").agg(F.sum("label").alias("bad"), F.count(F.lit(1)).alias("n")), base), "suffixes")
    judge = Judge(suffixes, base)
    if rows.select("label").distinct().count() < 2:
        return judge
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(out_of_fold(rows, base))
    # One partition count for a sample of bounded size: training is many short passes over it.
    vectors = vectors.select("__features", "label").repartition(4, F.xxhash64("__features"))
    trees = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(vectors)
    trees.setProbabilityCol("__probability").setRawPredictionCol("__raw").setPredictionCol("__prediction")
    return Judge(suffixes, base, trees)


def judge_urls(df: DataFrame, judge: Judge) -> DataFrame:
    """page_id, host, path, rule, verdict, p_block: one row per input row."""
    scored = judge.blocked(lexical(df.select("page_id", "url")))
    ruled = scored.withColumn("r", rule_of(F.col("host"), F.col("path")))
    verdict = F.coalesce("r.verdict", F.when(F.col("p_block") > 0.5, "block").otherwise("allow"))
    return ruled.select("page_id", "host", "path", "r.rule", verdict.alias("verdict"), "p_block")
