"""Line dedup by a log-template tree.

A line is masked (words with a digit become <*>) and parsed down a tree of fixed
depth: its number of tokens, then its leading tokens, which are the first third of
the line (half of one of less than nine tokens). As the variable field may be what
leads, the same line also goes down by its middle and its last third. In the leaf
that it reaches, a token stays where at least min_classes documents have it at its
position and is a variable field elsewhere, at any position. A template keeps at
least four fifths of its tokens. It is recurring if it stands in at least
min_classes classes of documents, and its lines are dropped. A line that recurs as
it is needs no tree and is dropped the same way.

Equal masked texts are one class, and so are near copies that share their longest
line: documents whose repeated lines hold at least 8/9 of their five-word shingles,
which is what a similarity of 0.8 leaves. Every other document is a class of its
own, whichever of its lines is the longest. Copies only count for less: a recurring
line is dropped in every document, however much of it recurs.

Lines move as hashes. Only lines of which a third is found in min_classes lines or
more are parsed by token. What recurs has one row for each template and is joined
by broadcast where its measured bytes allow; else Spark can split the rows of a
frequent line. The text is shuffled once.

Defined results: null text counts as empty and stays null; lines without a word
are never dropped; repeated rows are of one class; rows of one key are told apart
by their text, null keys included; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialise, small

WILD = "<*>"
LINE = ["k", "h", "klass", "whole", "pos", "n"]


def parse(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line with a word: k, h, klass (hash of the text's longest line), whole (of all its masked lines), pos, n (tokens), line, and its hashes template and check."""
    whole = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    single = lambda x: F.when(x.rlike(r"[\x09-\x0D]|\x20\x20"), F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).otherwise(x)
    # each step is a column of its own, so that no line is masked twice
    plain = whole.select("k", F.xxhash64("t").alias("h"), F.transform(F.split("t", "\n"), lambda x: F.trim(single(x))).alias("plain"))
    # words with a digit are masked where a letter stands elsewhere in the line
    typed = F.transform("plain", lambda x: F.when(x.rlike("[0-9]"), F.regexp_replace(x, r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", WILD)))
    plain = plain.select("k", "h", "plain", typed.alias("typed"))
    parts = plain.select("k", "h", F.zip_with("plain", "typed", lambda p, t: F.when(t.rlike(r"\p{L}"), t).otherwise(p)).alias("parts"))
    longest = F.array_max(F.transform("parts", lambda x: F.named_struct(F.lit("len"), F.length(x), F.lit("x"), F.xxhash64(x))))
    # before the explode, once per document
    parts = parts.select("k", "h", "parts", longest["x"].alias("klass"), F.xxhash64("parts").alias("whole"))
    # outer, as Spark would else filter by the size of parts below these steps and take them twice
    rows = parts.select("k", "h", "klass", "whole", F.posexplode_outer("parts").alias("pos", "line")).where("line <> ''")
    count = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    return rows.select("k", "h", "klass", "whole", "pos", count.alias("n"), "line", F.xxhash64("line").alias("template"), F.hash("line").alias("check"))


def branches(lines: DataFrame) -> DataFrame:
    """lines of five tokens or more with branch (which third), first and after (its tokens) and leaf, one row for each third."""
    n = F.col("n")
    size = F.when(n < 9, F.floor(n / 2)).otherwise(F.floor(n / 3)).cast("int")
    last = F.when(n < 9, n - size).otherwise(size)
    some = lambda c, k: F.call_function("substring_index", c, F.lit(" "), k)
    middle = some(some(F.col("line"), n - last), -(n - size - last))
    branch = lambda j, first, after, of: F.struct(F.lit(j).alias("branch"), first.alias("first"), after.alias("after"), F.xxhash64(F.lit(j), n, of).alias("leaf"))
    thirds = [branch(0, F.lit(0), size, some(F.col("line"), size)), branch(2, n - last, n, some(F.col("line"), -last))]
    thirds.append(F.when(n >= 9, branch(1, size, n - last, middle)))
    return lines.where("n >= 5").select("*", F.inline(F.array_compact(F.array(*thirds))))


def generalise(lines: DataFrame, min_classes: int) -> DataFrame:
    """The lines of templates with variable fields that are found in min_classes documents or more: LINE, template, check."""
    spread = branches(lines)
    # counts of rows are at least those of classes, which decide in the end
    leaves = small(spread.groupBy("leaf").count().where(F.col("count") >= min_classes).select("leaf"), "leaves")
    held = materialise(spread.join(leaves, "leaf", "left_semi").select(*LINE, "leaf", "first", "after", "line"), "leaf_lines")
    tokens = held.select(*LINE, "leaf", "first", "after", F.posexplode_outer(F.split("line", " ")).alias("at", "token")).where("at < first or at >= after")
    tokens = tokens.withColumn("token", F.xxhash64("token"))
    constant = tokens.select("leaf", "at", "token", "whole").distinct().groupBy("leaf", "at", "token").count()
    constant = small(constant.where(F.col("count") >= min_classes).select("leaf", "at", "token"), "constant_tokens")
    stay = tokens.join(constant, ["leaf", "at", "token"], "left_semi")
    line = [*LINE, "leaf", "first", "after"]
    # a line has few tokens, and only its own are gathered; equal rows share them
    kept = stay.groupBy(*line).agg(F.array_sort(F.collect_set(F.struct("at", "token"))).alias("stay"))
    kept = kept.where(5 * (F.size("stay") + F.col("after") - F.col("first")) >= 4 * F.col("n"))
    found = materialise(kept.select(*LINE, F.xxhash64("leaf", "n", "stay").alias("template"), F.hash("leaf", "stay").alias("check")), "templates")
    repeated = small(recurring(found, F.col("whole"), min_classes), "repeated_templates")
    out = materialise(found.join(repeated, ["template", "check"], "left_semi"), "generalised_lines")
    discard(lines.sparkSession, leaves, held, constant, found, repeated)
    return out


def recurring(lines: DataFrame, klass: Column, min_classes: int) -> DataFrame:
    """template and check of the templates that stand in at least min_classes classes."""
    classes = lines.select("template", "check", klass.alias("__class")).distinct()
    return classes.groupBy("template", "check").count().where(F.col("count") >= min_classes).select("template", "check")


def drop_recurring(docs: DataFrame, key: str = "doc_id", text: str = "text", min_classes: int = 8) -> DataFrame:
    """docs with text without its recurring lines, and n_lines and n_dropped."""
    spark = docs.sparkSession
    lines = materialise(parse(docs, key, text), "lines")
    repeated = small(recurring(lines, F.col("whole"), min_classes), "repeated_lines")
    exact = lines.join(repeated, ["template", "check"], "left_semi").select(*LINE, "template", "check")
    shaped = generalise(lines.join(repeated, ["template", "check"], "left_anti"), min_classes)
    met = materialise(exact.unionByName(shaped), "met_lines")

    document = ["k", "h"]
    places = met.select(*document, "pos", "n").distinct().groupBy(*document).agg(F.count("*").alias("places"), F.sum("n").alias("words"))
    all_of = lines.groupBy(*document).agg(F.countDistinct("pos").alias("all_places"), F.sum("n").alias("all_words"), F.count("*").alias("rows"))
    mine, whole = places.alias("a"), all_of.alias("b")
    shares = mine.join(whole, F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.h") == F.col("b.h")))
    # equal rows repeat their words; an own line breaks up to eight shingles of its neighbours
    words = F.expr("all_words * all_places / rows")
    copies = shares.where(9 * (F.col("words") - 4 * (F.col("all_places") - F.col("places") + 1)) >= 8 * (words - 4)).select(F.col("a.k").alias("__k"), F.col("a.h").alias("__h"), F.lit(True).alias("copy"))
    copies = small(copies, "copies")
    counted = met.join(copies, F.col("k").eqNullSafe(F.col("__k")) & (F.col("h") == F.col("__h")), "left")
    counted = counted.withColumn("class", F.when(F.col("copy"), F.col("klass")).otherwise(F.col("whole")))
    lasting = small(recurring(counted, F.col("class"), min_classes), "recurring_lines")
    hits = met.join(lasting, ["template", "check"], "left_semi").groupBy(F.col("k").alias("__k"), F.col("h").alias("__h")).agg(F.collect_set("pos").alias("__pos"))
    # broadcast where it is small, so that the texts stay in place
    hits = small(hits, "dropped_lines")
    discard(spark, lines, repeated, shaped, met, copies, lasting)

    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    met = docs.select(*kept).join(hits, docs[key].eqNullSafe(hits["__k"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == hits["__h"]), "left")
    lines_of, gone = F.split(F.col(text), "\n"), F.col("__pos").isNotNull()
    places = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__pos"))
    cut = met.withColumn("__lines", lines_of).withColumn("__left", F.when(gone, F.array_join(F.transform(places, lambda i: F.get("__lines", i)), "\n")).otherwise(F.col(text)))
    return cut.select(
        *[F.col("__left").alias(c) if c == text else F.col(c) for c in kept],
        F.greatest(F.lit(0), F.coalesce(F.size("__lines"), F.lit(0))).cast("long").alias("n_lines"), F.when(gone, F.size("__pos")).otherwise(0).cast("long").alias("n_dropped"),
    )
