"""Which of many patterns stand in which of many texts, as a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3
#: The most patterns, and the most bytes of them, that go into the plan itself instead of a join.
FEW, FEW_BYTES = 256, 1 << 18


def few_patterns(patterns: DataFrame, pattern: str) -> list[str] | None:
    """The distinct patterns that are neither null nor empty, or None where they are more than FEW or FEW_BYTES."""
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    n, held = wanted.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("pattern").cast("long")), F.lit(0))).first()
    return sorted(r[0] for r in wanted.collect()) if n <= FEW and held <= FEW_BYTES else None


def with_contained(rows: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """rows, once for each distinct pattern that stands in their text, with it as column `pattern`.

    A measured few patterns are looked for in one pass over the rows, without a shuffle;
    more of them through contained(). Null and empty texts and patterns give no row."""
    few = few_patterns(patterns, pattern)
    if few is None:
        pairs = contained(rows, text, patterns, pattern).withColumnRenamed("text", "text_met")
        return rows.join(pairs, F.col(text) == F.col("text_met")).drop("text_met")
    listed = F.array(*map(F.lit, few)) if few else F.array().cast("array<string>")
    return rows.withColumn("pattern", F.explode(F.filter(listed, lambda p: F.contains(F.col(text), p))))


def grams(c: Column, size: int) -> Column:
    """The distinct runs of `size` characters of a text."""
    places = F.when(F.length(c) >= size, F.sequence(F.lit(1), F.length(c) - size + 1))
    return F.array_distinct(F.transform(F.coalesce(places, F.array().cast("array<int>")), lambda i: F.substring(c, i, F.lit(size))))


def contained(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """The distinct pairs (text, pattern) where the pattern stands in the text.

    A pattern is looked for by its run of three characters that the fewest texts have, so
    no pair is tried but those that share it; patterns of one or two characters are
    looked for by themselves. Null and empty patterns stand in nothing."""
    wanted = patterns.select(F.col(pattern).alias("pattern")).where("pattern <> ''").distinct()
    sizes = [r[0] for r in wanted.select(F.least(F.length("pattern"), F.lit(GRAM)).alias("n")).distinct().collect()]  # three rows at most
    whole = texts.select(F.col(text).alias("text")).where("text <> ''").distinct()
    none = F.array().cast("array<string>")
    runs = whole.select("text", F.explode_outer(F.concat(none, *[grams(F.col("text"), n) for n in sorted(sizes)])).alias("gram")).where("gram is not null")
    common = runs.groupBy("gram").agg(F.count("*").alias("n"))
    keys = wanted.select("pattern", F.explode(grams_of_pattern(F.col("pattern"))).alias("gram")).join(common, "gram")
    keys = keys.groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count("*").alias("met"), F.first(F.size(grams_of_pattern(F.col("pattern")))).alias("all"))
    # a pattern with a run that no text has stands in none
    return runs.join(keys.where("met = all").select("pattern", "gram"), "gram").where(F.contains("text", F.col("pattern"))).select("text", "pattern")


def grams_of_pattern(c: Column) -> Column:
    return F.when(F.length(c) < GRAM, F.array(c)).otherwise(grams(c, GRAM))
