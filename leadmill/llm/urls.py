"""URL filter: host and path rules first, boosted trees on lexical features for the rest.

The trees are trained from labelled URLs. A URL whose host holds a word of a seed
list is labelled as blocked, and every other one as allowed, as the unwanted are
few among the rest. What a rule blocks for its path alone has no label: such a
policy says nothing about how unwanted URLs look. Both kinds weigh alike in
training, so the threshold of a half takes the likelier kind. Training uses at
most max_labelled rows (those of the smallest URL hash, half of them of either
kind); the suffix statistics cover all rows, and a labelled row's own label is
taken out of its suffix's rate. Everything is DataFrame and MLlib work; no Python
runs on executors.

Defined results: a null URL or one without "://" has an empty host and path, no
rule and the method's verdict; without labelled URLs of both kinds the verdict
is that of the labels present, allow where there are none; repeated rows are
judged each for itself; columns named like a result column are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import materialise, small

#: The rules of the contract as (rule, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Host words whose URLs are labelled as blocked where no rule fits.
SEEDS = ("spam", "casino", "bets", "pills", "viagra", "adult", "porn", "warez", "phish", "malware", "track")
RESULT = ("host", "path", "rule", "verdict", "block_probability")
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "entropy", "parameters", "suffix_share", "suffix_block_rate")


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("__url")))
    lowered = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("__url")))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null where none fits."""
    chosen, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        chosen, verdict = F.when(fits, F.lit(rule)).otherwise(chosen), F.when(fits, F.lit(says)).otherwise(verdict)
    return chosen, verdict


def _count(c: Column, of: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(of), F.lit("")))).cast("double") / len(of)


def lexical(urls: DataFrame) -> DataFrame:
    """urls (with __url, __host, __path) with the lexical features of each URL."""
    url, size = F.col("__url"), F.greatest(F.length("__url"), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(url, ""))
    share = lambda x: (F.length(url) - F.length(F.replace(url, x, F.lit("")))) / size
    # summed in thousandths, so that the order of letters doesn't matter
    entropy = F.aggregate(F.transform(letters, lambda x: F.when(share(x) > 0, F.round(-share(x) * F.log2(share(x)) * 1000)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x) / 1000
    return urls.withColumns({
        "__suffix": F.substring_index("__host", ".", -1),
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("__host").cast("double"),
        "path_length": F.length("__path").cast("double"),
        "depth": _count(F.col("__path"), "/"),
        "labels": _count(F.col("__host"), "."),
        "hyphens": _count(F.col("__host"), "-"),
        "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / size,
        "entropy": entropy,
        "parameters": F.when(F.instr(url, "?") > 0, _count(url, "&") + 1).otherwise(F.lit(0.0)),
    })


def prepare(pages: DataFrame, url: str = "url", rules=RULES, seeds=SEEDS) -> DataFrame:
    """pages with __url, __host, __path, __rule, __says (the rule's verdict), __label (1 blocked, 0 allowed) and the features."""
    named = pages.select(*[c for c in pages.columns if c.lower() not in RESULT], F.coalesce(F.col(url), F.lit("")).alias("__url"))
    split = named.withColumns({"__host": host_of(F.col("__url")), "__path": path_of(F.col("__url"))})
    rule, verdict = rule_of(F.col("__host"), F.col("__path"), rules)
    seeded = reduce(lambda a, b: a | b, [F.col("__host").contains(w) for w in seeds], F.lit(False))
    split = split.withColumns({"__rule": rule, "__says": verdict})
    split = split.withColumn("__label", F.when(seeded, 1.0).when((F.col("__host") != "") & (F.coalesce("__says", F.lit("allow")) == "allow"), 0.0))
    # all rows: how common a host suffix is, and how often it is blocked where labelled
    suffix = F.substring_index("__host", ".", -1).alias("__suffix")
    suffixes = small(split.groupBy(suffix).agg(F.count("*").alias("__n"), F.sum("__label").alias("__bad"), F.count("__label").alias("__labelled")), "suffixes")
    total = suffixes.agg(F.sum("__n").alias("__total"))
    met = lexical(split).join(suffixes, "__suffix", "left").join(F.broadcast(total))
    own, others = F.coalesce("__label", F.lit(0.0)), F.col("__labelled") - F.col("__label").isNotNull().cast("int")
    return met.withColumns({"suffix_share": F.log2(F.col("__n") / F.col("__total")), "suffix_block_rate": (F.coalesce("__bad", F.lit(0.0)) - own + 1) / (others + 2)}).drop("__suffix", "__n", "__bad", "__labelled", "__total")


def train(featured: DataFrame, max_labelled: int = 20_000, trees: int = 10, depth: int = 4):
    """A model of the labelled rows of prepare(), both kinds weighed alike; null without rows of both."""
    labelled = featured.where("__label is not null").select("__url", "__label", *FEATURES)
    order = [F.xxhash64("__url"), F.col("__url")]
    either = [labelled.where(F.col("__label") == k).orderBy(*order).limit(max_labelled // 2) for k in (0.0, 1.0)]
    sample = materialise(either[0].unionByName(either[1]), "labelled")
    n = {r["__label"]: r["count"] for r in sample.groupBy("__label").count().collect()}
    if len(n) < 2:
        return None
    weighed = sample.withColumn("__weight", F.when(F.col("__label") == 1, 0.5 / n[1.0]).otherwise(0.5 / n[0.0]) * sum(n.values()))
    ordered = assembled(weighed).coalesce(1).sortWithinPartitions(*order)
    return GBTClassifier(labelCol="__label", featuresCol="__features", weightCol="__weight", maxIter=trees, maxDepth=depth, minInstancesPerNode=10, seed=7).fit(ordered)


def assembled(featured: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="__features").transform(featured)


def judge(pages: DataFrame, url: str = "url", rules=RULES, seeds=SEEDS, max_labelled: int = 20_000, trees: int = 10, depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """pages with host, path, rule, verdict and block_probability."""
    featured = prepare(pages, url, rules, seeds)
    model = train(featured, max_labelled, trees, depth)
    if model:
        scored = model.transform(assembled(featured)).withColumn("__p", vector_to_array("probability")[1])
    else:
        scored = featured.withColumn("__p", F.lit(1.0).cast("double") if featured.where("__label = 1").limit(1).count() and not featured.where("__label = 0").limit(1).count() else F.lit(0.0))
    return scored.select(
        *[c for c in pages.columns if c.lower() not in RESULT],
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__rule").alias("rule"),
        F.coalesce("__says", F.when(F.col("__p") > threshold, "block").otherwise("allow")).alias("verdict"),
        F.col("__p").alias("block_probability"),
    )
