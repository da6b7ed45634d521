"""Token counts without token ids: pieces per distinct pre-token, times its frequency.

Texts are cut into pre-tokens by a native expression. Every distinct pre-token
is counted once by the tokenizer library. Those counts are joined to the
pre-tokens of each document and summed. The commonest pre-tokens, of most_bytes
at most, are joined by broadcast, so that no frequent word becomes a hot key; all
others are joined by shuffle. Nothing is left out.

Defined results: null text counts as empty (0 bytes, 0 tokens); each row is
counted for itself, also where a doc_id or a whole row repeats; special token
strings inside a text are one token each, as the library's default has it.
"""

from __future__ import annotations

import pandas as pd
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import materialise, row_bytes

#: Fixed value: the pre-token pattern of byte-level BPE, with Unicode white space.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Special token strings of the tokenizer file.
SPECIALS = ("<|endoftext|>",)


def pretokens(text: Column, specials=SPECIALS) -> Column:
    """All pre-tokens of a text, in order; special strings cut it and are left out."""
    cut = "|".join("\\Q" + s + "\\E" for s in specials)
    return F.flatten(F.transform(F.split(text, cut), lambda part: F.regexp_extract_all(part, F.lit(PRETOKEN), F.lit(0))))


def count_specials(text: Column, specials=SPECIALS) -> Column:
    return F.size(F.split(text, "|".join("\\Q" + s + "\\E" for s in specials))) - 1


def count_pieces(distinct: DataFrame, path: str) -> DataFrame:
    """distinct (pretoken, frequency) with n_pieces, by the library's own encoder."""

    def count(batches):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for batch in batches:
            words = batch["pretoken"].tolist()
            n = [len(e) for k in range(0, len(words), 2000) for e in tokenizer.encode_batch_fast(words[k : k + 2000], add_special_tokens=False)]
            yield pd.DataFrame({"pretoken": words, "frequency": batch["frequency"], "n_pieces": n})

    return distinct.mapInPandas(count, "pretoken string, frequency long, n_pieces long")


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, most_bytes: int = 16 << 20) -> DataFrame:
    """One row for each row of docs: key, n_bytes, n_tokens, over_limit."""
    path = public_tokenizers.path(tokenizer)
    whole = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    # outer here and below, as Spark would else filter by the size of the array and cut each text twice
    distinct = whole.select(F.explode_outer(pretokens(F.col("t"))).alias("pretoken")).where("pretoken is not null").groupBy("pretoken").agg(F.count("*").alias("frequency"))
    pieces = materialise(count_pieces(distinct, path), "pieces")
    # the lowest frequency class (eighths of a power of two) from which the common pre-tokens have at most most_bytes
    step = F.floor(8 * F.log2("frequency"))
    classes = pieces.groupBy(step.alias("step")).agg(F.sum(row_bytes(pieces)).alias("bytes")).orderBy(F.desc("step")).collect()  # a few hundred rows
    least, size = 1 << 30, 0
    for r in classes:
        size += r["bytes"]
        if size > most_bytes:
            break
        least = r["step"]
    common = pieces.where(step >= least).select("pretoken", "n_pieces")
    rare = pieces.where(step < least).select(F.col("pretoken").alias("rare"), F.col("n_pieces").alias("more"))

    # one marker row per document carries its special tokens and counts repeated rows
    # all that needs the text is computed before the explode, once per document
    cut = whole.select("k", F.octet_length("t").cast("long").alias("n_bytes"), F.xxhash64("t").alias("h"), count_specials(F.col("t")).cast("long").alias("s"), F.concat(F.array(F.lit(None).cast("string")), pretokens(F.col("t"))).alias("all"))
    rows = cut.select("k", "n_bytes", "h", "s", F.explode_outer("all").alias("pretoken"))
    met = rows.join(F.broadcast(common), "pretoken", "left").select(
        "k", "n_bytes", "h",
        # what needs no join gets a key of its document's, which no pre-token is, so that it doesn't meet in one task
        F.when(F.col("n_pieces").isNull() & F.col("pretoken").isNotNull(), F.col("pretoken")).otherwise(F.concat(F.lit("\0"), F.col("h").cast("string"))).alias("rare"),
        F.when(F.col("pretoken").isNull(), F.col("s")).otherwise(F.coalesce("n_pieces", F.lit(0))).alias("n"),
        F.when(F.col("pretoken").isNull(), 1).otherwise(0).alias("marker"),
    )
    known = met.groupBy("k", "n_bytes", "h", "rare").agg(F.sum("n").alias("n"), F.sum("marker").alias("rows"), F.count("*").alias("freq"))
    summed = known.join(rare, "rare", "left").groupBy("k", "n_bytes", "h").agg(
        F.sum(F.col("n") + F.col("freq") * F.coalesce("more", F.lit(0))).alias("n"), F.sum("rows").alias("rows")
    )
    each = summed.withColumn("n_tokens", F.expr("n div rows")).withColumn("row", F.explode(F.expr("sequence(1, rows)")))
    return each.select(F.col("k").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
