"""Quality rules as weak supervision.

Each rule votes good (+1), bad (-1) or abstains (0) on a document. Expectation
maximisation over the counts of vote patterns estimates how each rule votes on
good and on bad documents, and a document is kept where the posterior
probability of being good is at least a half. No document has to pass every rule.

Each text is counted once and the counts are written beside the document's
columns; vote patterns (at most 3 ** number of rules rows, whatever the corpus) and
scores are taken from there. No shuffle moves text.

Defined results: null text counts as empty; a text without words has zero
counts, fails the base test and is not kept; repeated rows are judged each for
itself; columns of the input that bear the name of a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import SPACE, materialise

SYMBOLS = "#*$%&|<>"
#: Words that a task remembers between texts, which bounds its memory.
MOST_WORDS = 150_000
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_short_words", "n_ended_lines", "n_plain_words", "n_marked_words")
FEATURES = ", ".join(f"{c} long" for c in COUNTS)
RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "posterior", "kept")


class Words(dict):
    """Word to number, with the word's properties in the lowest four bits. Forgets between texts beyond MOST_WORDS."""

    def __missing__(self, word: bytes) -> int:
        plain = word.rstrip(b".,;:!?)\"'").replace(b"-", b"").isalpha() or word[0] > 127 or word[-1] > 127
        marked = len(word) > 2 and word[-2] == word[-1] and word[-1] in b"!?.*#$%&|<>=~^_"
        self[word] = number = len(self) << 4 | (len(word) > 1 and word.isupper()) | (len(word) < 4) << 1 | plain << 2 | marked << 3
        return number

    def numbers(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MOST_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def repeated_words(numbers: np.ndarray) -> int:
    """Words inside 3-word windows that are found twice or more."""
    if len(numbers) < 4:
        return 0
    distinct = int(numbers.max()) + 1
    if distinct < 1 << 21:
        keys = (numbers[:-2] << 42) + (numbers[1:-1] << 21) + numbers[2:]
    else:
        pairs = np.unique(numbers[:-1] * distinct + numbers[1:], return_inverse=True)[1]
        keys = pairs[:-1] * distinct + numbers[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(keys), bool)
    starts[order[1:][same]] = starts[order[:-1][same]] = True
    covered = np.zeros(len(numbers), bool)
    for k in range(3):
        covered[k : k + len(starts)] |= starts
    return int(covered.sum())


def count_text(text: str | None, known: Words) -> tuple:
    """The counts of COUNTS for one text."""
    text = text or ""
    words = text.encode("utf-8", "replace").split()
    numbers = known.numbers(words)
    share = [int((numbers >> k & 1).sum()) for k in range(4)]
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    return (
        len(words),
        len(text) - sum(map(text.count, SPACE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(numbers >> 4),
        len(lines),
        *share[:2],
        sum(1 for x in lines if x.rstrip(SPACE)[-1] in ".!?\"'»”:"),
        *share[2:],
    )


def text_counts(text: Column) -> Column:
    """A struct of COUNTS for every whole text."""

    @F.pandas_udf(FEATURES)
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words()
        for texts in batches:
            yield pd.DataFrame([count_text(x, known) for x in texts], columns=list(COUNTS), dtype="int64")

    return counts(text)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def votes(f: str) -> dict[str, Column]:
    """The rules, over the struct column f of counts. A text without words gets no good vote."""
    c = {k: F.col(f"{f}.{k}").cast("double") for k in COUNTS}
    words, lines = F.greatest(c["n_words"], F.lit(1.0)), F.greatest(c["n_lines"], F.lit(1.0))
    some = c["n_words"] > 0
    mean = c["word_chars"] / words
    return {
        "symbols": _vote(some & (c["n_symbols"] / words < 0.02), c["n_symbols"] / words > 0.1),
        "dup_lines": _vote((lines > 3) & (c["n_dup_lines"] == 0), (c["n_dup_lines"] > 2) & (c["n_dup_lines"] / lines > 0.3)),
        "repeats": _vote(some & (c["n_repeat_words"] / words < 0.1), c["n_repeat_words"] / words > 0.3),
        "word_length": _vote((mean >= 3) & (mean <= 9), (mean < 2) | (mean > 12)),
        "upper": _vote(some & (c["n_upper"] / words < 0.1), c["n_upper"] / words > 0.4),
        "short_words": _vote(c["n_short_words"] / words >= 0.15, c["n_short_words"] / words < 0.05),
        "ended_lines": _vote((c["n_words"] > 20) & (c["n_ended_lines"] / lines >= 0.7), c["n_ended_lines"] / lines < 0.1),
        "plain_words": _vote(c["n_plain_words"] / words >= 0.85, c["n_plain_words"] / words < 0.6),
        "marked_words": _vote(some & (c["n_marked_words"] / words < 0.02), c["n_marked_words"] / words > 0.15),
        "length": _vote(c["n_words"] >= 100, c["n_words"] < 50),
    }


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation over vote patterns (rows of -1, 0, 1) and their counts.

    Returns the posterior of each pattern, P(vote | class) as (rules, 2, 3) and the
    prior of good. It starts from the share of good votes among the votes cast.
    """
    cast = np.maximum((patterns != 0).sum(1), 1)
    good = np.clip(0.5 + 0.5 * patterns.sum(1) / cast, 0.02, 0.98)
    hot = patterns[:, :, None] == np.array([-1, 0, 1])
    chance, prior = np.zeros((patterns.shape[1], 2, 3)), 0.5
    for _ in range(rounds):
        weights = np.stack([(1 - good) * counts, good * counts])
        # add-one smoothing that leans to a rule being right rather than wrong
        chance = np.einsum("cp,prv->rcv", weights, hot) + np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])
        chance /= chance.sum(2, keepdims=True)
        prior = float(np.clip((weights[1].sum() + 1) / (weights.sum() + 2), 0.01, 0.99))
        logs = np.einsum("prv,rcv->pc", hot, np.log(chance)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if np.abs(new - good).max(initial=0) < 1e-9:
            return new, chance, prior
        good = new
    return good, chance, prior


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5, keep_text: bool = True) -> DataFrame:
    """docs, without the text if keep_text is false, with the columns of RESULT: base counts, base_failed, posterior and kept."""
    spark = docs.sparkSession
    rules = votes("__f")
    pattern = F.concat_ws(",", *[v.cast("string") for v in rules.values()])
    kept = [c for c in docs.columns if c.lower() not in RESULT and (keep_text or c != text)]
    counted = materialise(docs.select(*kept, text_counts(F.col(text)).alias("__f")), "text_counts").withColumn("__p", pattern)
    seen = counted.groupBy("__p").count().collect()
    if seen:  # at most 3 ** len(rules) rows
        table = np.array([[int(x) for x in r["__p"].split(",")] for r in seen])
        posterior, _, _ = fit(table, np.array([r["count"] for r in seen], float))
    rows = [(r["__p"], float(x)) for r, x in zip(seen, posterior)] if seen else []
    fitted = F.broadcast(spark.createDataFrame(rows, "__p string, __posterior double"))
    failed = (F.col("__f.n_words") < 50) | (100 * F.col("__f.n_repeat_words") > 50 * F.col("__f.n_words"))
    return counted.join(fitted, "__p", "left").select(
        *kept,
        *[F.col(f"__f.{c}").alias(c) for c in COUNTS[:5]],
        failed.alias("base_failed"),
        F.col("__posterior").alias("posterior"),
        (~failed & (F.col("__posterior") >= threshold)).alias("kept"),
    )
