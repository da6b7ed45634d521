"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A document's score is the noisy-or of its sentences' scores, 1 - (1 - leak) * prod(1 - p_s),
and a sentence's score is logistic in the cues it holds: words, and their
beginnings and ends of MIN_PART to MAX_PART letters. Weights come from document labels
alone, by descent on the noisy-or's likelihood; sentences then point at the offence.
A sentence without a cue scores zero, so length alone never makes a document toxic.

Cues are found by counting, over a bounded sample of the distinct labelled texts (about
`max_labelled` of them by their hash; all where there are fewer), in how many texts of each
label a word or part occurs; those that lean to toxic beyond chance stay, `max_cues` at most,
the strongest first. Counting runs in Spark; what reaches the driver is the cues, and for
each sampled text the cue numbers of those sentences that hold any.

Whole texts are scored in tasks of their own; nothing moves. Labels, language, source and id
are no inputs of a score; documents of a held-out fold train nothing.

Defined results: null texts count as empty and get the leak; without labels of both kinds
every score is the share of toxic among the labels (a half without any); several labels of
one id, or of equal texts, are toxic if one is; a null id is in no fold and has no label; repeated rows are
scored each for itself; columns that bear the name of a result column are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadmill.llm.common import discard, materialise, small

RESULT = ("held_out", "score", "predicted", "n_sentences", "n_offending", "worst_sentence")
MAX_LABELLED, MAX_CUES = 20_000, 20_000
MIN_PART, MAX_PART = 3, 6
#: Toxic documents a cue has to be in, and how far it has to lean (in standard normal terms).
LEAST_DOCS, LEAST_Z = 3, 4.0
#: Words that a task remembers between texts, which bounds its memory.
MOST_WORDS = 200_000
WORDS = re.compile(r"[^\W\d_]+")
SENTENCES = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")


def parts_of(word: str) -> set[str]:
    """A word as =word, its beginnings as ^part and its ends as part$."""
    lengths = range(MIN_PART, min(MAX_PART, len(word) - 1) + 1)
    return {f"={word}", *(f"^{word[:n]}" for n in lengths), *(f"{word[-n:]}$" for n in lengths)}


@dataclass
class Model:
    """Cues with their weights; `bias` for every sentence with a cue, `leak` for the document."""

    cues: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    leak: float = 0.5

    def plain(self) -> tuple:
        """Built-in types only, which tasks can read without this package."""
        return self.cues, self.weights.tolist(), self.bias, self.leak


class Cues(dict):
    """Token to the numbers of the cues in it; forgets between texts beyond MOST_WORDS."""

    def __init__(self, cues: dict[str, int]):
        super().__init__()
        self.cues = cues

    def __missing__(self, token: str) -> frozenset[int]:
        self[token] = found = frozenset(n for w in WORDS.findall(token.lower()) for p in parts_of(w) if (n := self.cues.get(p)) is not None)
        return found

    def sentences(self, text: str) -> Iterator[tuple[int, int, int, frozenset[int]]]:
        """Number, start, end and cues of each sentence that holds a word."""
        if len(self) > MOST_WORDS:
            self.clear()
        n = 0
        for m in SENTENCES.finditer(text):
            tokens = m[0].split()
            if tokens:
                held = [c for c in map(self.__getitem__, tokens) if c]
                yield n, m.start(), m.end(), frozenset().union(*held) if held else NO_CUE
                n += 1


NO_CUE: frozenset[int] = frozenset()


def softplus(z: np.ndarray) -> np.ndarray:
    """-log(1 - logistic(z))."""
    return np.logaddexp(0.0, z)


def fit(bags: list[tuple[int, list[list[int]]]], n_cues: int, rounds: int = 400, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak from (label, cues of each sentence that has any), by descent with
    running moments on the mean negative log-likelihood of the noisy-or."""
    label = np.array([y for y, _ in bags], float)
    doc = np.array([d for d, (_, s) in enumerate(bags) for _ in s], int)
    held = [c for _, s in bags for c in s]
    sentence = np.repeat(np.arange(len(held)), [len(c) for c in held]) if held else np.zeros(0, int)
    cue = np.array([x for c in held for x in c], int)
    # weights, then the bias, then the logarithm of the leak's hazard
    w = np.zeros(n_cues + 2)
    w[n_cues], w[n_cues + 1] = -2.0, math.log(0.05)
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        z = np.bincount(sentence, w[cue], len(held)) + w[n_cues]
        hazard = np.exp(w[n_cues + 1])
        total = np.bincount(doc, softplus(z), len(bags)) + hazard
        # d loss / d total: 1 for a clean document, -1 / (e^total - 1) for a toxic one
        pull = np.where(label > 0, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / len(bags)
        slope = pull[doc] / (1 + np.exp(-np.clip(z, -500, 500)))
        g = np.append(np.bincount(cue, slope[sentence], n_cues) + decay * w[:n_cues] / max(len(bags), 1), [slope.sum(), pull.sum() * hazard])
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        w -= rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-12)
    return w[:n_cues], float(w[n_cues]), float(-np.expm1(-np.exp(w[n_cues + 1])))


def strength(toxic: Column, clean: Column, share: float) -> Column:
    """Root of the likelihood ratio statistic of a cue's documents being toxic as often as all are; below zero where they are so less often."""
    n = toxic + clean
    part = lambda seen, p: F.when(seen > 0, seen * F.log(seen / (n * p))).otherwise(0.0)
    root = F.sqrt(F.greatest(2 * (part(toxic, share) + part(clean, 1 - share)), F.lit(0.0)))
    return F.when(toxic > n * share, root).otherwise(-root)


def find_cues(sample: DataFrame, share: float, max_cues: int) -> list[str]:
    """Words and parts of sample (text, toxic) that lean to toxic, the strongest first."""

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:  # a batch's counts leave with it
            told: tuple[Counter, Counter] = (Counter(), Counter())
            known: dict[str, set[str]] = {}
            for text, toxic in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                parts: set[str] = set()
                for w in set(WORDS.findall(text.lower())):
                    if w not in known:
                        known[w] = parts_of(w)
                    parts |= known[w]
                told[toxic].update(parts)
            every = list(told[0].keys() | told[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([told[y][p] for p in every], pa.int64()) for y in (0, 1)]], ["cue", "clean", "toxic"])

    counted = sample.select("text", "toxic").mapInArrow(count, "cue string, clean long, toxic long").groupBy("cue").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    leaning = counted.where(F.col("toxic") >= LEAST_DOCS).withColumn("z", strength(F.col("toxic"), F.col("clean"), share)).where(F.col("z") >= LEAST_Z)
    return [r["cue"] for r in leaning.orderBy(F.desc("z"), "cue").limit(max_cues).select("cue").collect()]


def fold(key: Column) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", max_labelled: int = MAX_LABELLED, max_cues: int = MAX_CUES) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    told = labels.where(F.col(key).isNotNull() & F.col("toxic").isNotNull() & ~fold(F.col(key))).groupBy(F.col(key).alias("id")).agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    # hashes of texts meet the labels; texts themselves move only for the sample
    mine = docs.where(~fold(F.col(key))).select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    marked = materialise(mine.join(told, "id").groupBy("h").agg(F.max("toxic").alias("toxic")), "marked")
    distinct = marked.count()
    chosen = small(marked.where(F.pmod("h", F.lit(1 << 20)) < int((1 << 20) * min(1.0, max_labelled / max(distinct, 1)))), "chosen")
    sample = materialise(mine.select("text", "h").join(chosen, "h").groupBy("h").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"), "labelled")
    discard(spark, marked, chosen)
    seen = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = seen.get(1, 0), seen.get(0, 0)
    if not toxic or not clean:
        discard(spark, sample)
        return Model(leak=toxic / (toxic + clean) if toxic + clean else 0.5)
    spread = sample.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    cues = {c: n for n, c in enumerate(find_cues(spread, toxic / (toxic + clean), max_cues))}

    def bags(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Cues(cues)
        for batch in found:
            rows = [(y, [sorted(c) for *_, c in known.sentences(t) if c]) for t, y in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.list_(pa.int32())))], ["toxic", "sentences"])

    rows = [(r["toxic"], r["sentences"]) for r in spread.mapInArrow(bags, "toxic int, sentences array<array<int>>").collect()]  # max_labelled rows
    weights, bias, leak = fit(sorted(rows), len(cues))
    discard(spark, sample)
    return Model(cues, weights, bias, leak)


class Scorer:
    """Noisy-or over the sentences of texts."""

    def __init__(self, cues: dict[str, int], weights: list[float], bias: float, leak: float):
        self.known, self.weights, self.bias = Cues(cues), weights, bias
        self.spared = math.log1p(-min(leak, 1 - 1e-12))

    def sentence(self, cues: frozenset[int]) -> float:
        """log(1 - p) of a sentence, zero without a cue."""
        if not cues:
            return 0.0
        z = self.bias + math.fsum(self.weights[c] for c in cues)
        return -(z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z)))

    def text(self, text: str | None) -> tuple[float, int, int, int | None]:
        """Score, sentences, those that score a half or more, and the number of the worst of these."""
        spared, n, offending, least, worst = [self.spared], 0, 0, math.log(0.5), None
        for k, _, _, cues in self.known.sentences(text or ""):
            n = k + 1
            if cues:
                log = self.sentence(cues)
                spared.append(log)
                offending += log <= HALF
                if log <= HALF and (worst is None or log < least):
                    least, worst = log, k
        return -math.expm1(math.fsum(spared)), n, offending, worst

    def offences(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(number, start, end, score) of each sentence that scores a half or more; places are code points."""
        found = ((k, a, b, self.sentence(c)) for k, a, b, c in self.known.sentences(text or "") if c)
        return [(k, a, b, -math.expm1(log)) for k, a, b, log in found if log <= HALF]


HALF = math.log(0.5)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the columns of RESULT."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.pandas_udf("score double, n_sentences long, n_offending long, worst_sentence long")
    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*sent.value)
        for texts in batches:
            rows = [scorer.text(t if isinstance(t, str) else None) for t in texts]
            worst = pd.Series([r[3] for r in rows], dtype="Int64")
            yield pd.DataFrame({"score": np.array([r[0] for r in rows], float), "n_sentences": np.array([r[1] for r in rows], np.int64), "n_offending": np.array([r[2] for r in rows], np.int64), "worst_sentence": worst})

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULT and (keep_text or c != text)]
    told = docs.select(F.struct(*kept).alias("row"), fold(F.col(key)).alias("held_out"), judged(F.col(text)).alias("told"))
    own = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in RESULT and (keep_text or c != text)]
    return told.select(*own, "held_out", "told.score", F.when(F.col("told.score") >= 0.5, 1).otherwise(0).alias("predicted"), "told.n_sentences", "told.n_offending", "told.worst_sentence")


def offending_sentences(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each sentence that scores a half or more: id, its number and place, the sentence and its score."""
    sent = docs.sparkSession.sparkContext.broadcast(model.plain())

    @F.pandas_udf("array<struct<sentence_no: long, start: long, end: long, sentence_score: double>>")
    def located(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(*sent.value)
        for texts in batches:
            yield pd.Series([[dict(zip(("sentence_no", "start", "end", "sentence_score"), x, strict=True)) for x in scorer.offences(t if isinstance(t, str) else None)] for t in texts], dtype=object)

    at = docs.select(F.col(key).alias(key), F.col(text).alias("whole"), F.explode(located(F.col(text))).alias("s"))
    return at.select(key, "s.sentence_no", "s.start", "s.end", F.expr("substring(whole, s.start + 1, s.end - s.start)").alias("sentence"), "s.sentence_score")
