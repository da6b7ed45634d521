"""The pipeline against a plain reckoning of its stages, and on rows that are hard to handle."""

import collections
import math
import re

import corpus_pipeline
from leadmill.llm import registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, text2 string"


def share(a, b):
    return a / max(b, 1)


def plain_votes(t):
    """The rules of the quality stage over one text, in plain Python; and whether it fails the base test."""
    w, lines = re.findall(r"[^\x20\x09-\x0D]+", t), [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    n, m = len(w), len(lines)
    grams, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(n - 2):
        covered |= {i, i + 1, i + 2} if grams[tuple(w[i : i + 3])] > 1 else set()
    b = [x.encode() for x in w]
    upper, short = sum(len(x) > 1 and x.isupper() for x in b), sum(len(x) < 4 for x in b)
    plain = sum(x.rstrip(b".,;:!?)\"'").replace(b"-", b"").isalpha() or x[0] > 127 or x[-1] > 127 for x in b)
    marked = sum(len(x) > 2 and x[-1] == x[-2] and chr(x[-1]) in "!?.*#$%&|<>=~^_" for x in b)
    ended = sum(x.rstrip(" \t\n\x0b\x0c\r")[-1] in ".!?\"'»”:" for x in lines)
    symbols, dups, mean = sum(c in "#*$%&|<>" for c in t), m - len(set(lines)), share(sum(map(len, w)), n)
    vote = lambda good, bad: -1 if bad else int(good)
    votes = (
        vote(n and share(symbols, n) < 0.02, share(symbols, n) > 0.1), vote(m > 3 and not dups, dups > 2 and dups / m > 0.3), vote(n and share(len(covered), n) < 0.1, share(len(covered), n) > 0.3),
        vote(3 <= mean <= 9, mean < 2 or mean > 12), vote(n and share(upper, n) < 0.1, share(upper, n) > 0.4), vote(share(short, n) >= 0.15, share(short, n) < 0.05),
        vote(n > 20 and share(ended, m) >= 0.7, share(ended, m) < 0.1), vote(share(plain, n) >= 0.85, share(plain, n) < 0.6), vote(n and share(marked, n) < 0.02, share(marked, n) > 0.15), vote(n >= 100, n < 50),
    )
    return votes, n < 50 or 100 * len(covered) > 50 * n


def plain_posteriors(all_votes):
    """Expectation maximisation, one document and one rule at a time."""
    good = [min(0.98, max(0.02, 0.5 + 0.5 * sum(v) / max(1, sum(x != 0 for x in v)))) for v in all_votes]
    for _ in range(100):
        chance = {}
        for r in range(10):
            for c in (0, 1):
                seen = {-1: 1 + (c == 0), 0: 1, 1: 1 + (c == 1)}
                for v, g in zip(all_votes, good):
                    seen[v[r]] += g if c else 1 - g
                chance[r, c] = {x: n / sum(seen.values()) for x, n in seen.items()}
        prior = min(0.99, max(0.01, (sum(good) + 1) / (len(good) + 2)))
        new = []
        for v in all_votes:
            a = math.log(1 - prior) + sum(math.log(chance[r, 0][x]) for r, x in enumerate(v))
            b = math.log(prior) + sum(math.log(chance[r, 1][x]) for r, x in enumerate(v))
            new.append(1 / (1 + math.exp(a - b)))
        if max(abs(x - y) for x, y in zip(good, new)) < 1e-9:
            return new
        good = new
    return good


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on what the one before it kept, held against a plain reckoning of its whole input."""
    import public_tokenizers
    import sentencepiece

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF)
        assert out.columns == columns and out.dtypes == docs.dtypes
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        before, kept = sorted(kept.collect(), key=lambda r: r["doc_id"]), spark.read.parquet(path)
        rows = kept.collect()
        left = {r["doc_id"] for r in rows}
        assert left <= {r["doc_id"] for r in before} and len(rows) == len(left)
        if name == "quality_rules":
            voted = [plain_votes(r["text"] or "") for r in before]
            good = plain_posteriors([v for v, _ in voted])
            assert left == {r["doc_id"] for r, (_, failed), g in zip(before, voted, good) if not failed and g >= 0.5}
        if name == "line_dedup":
            assert len(rows) == len(before) and all(r["n_chars"] == len(r["text"]) for r in rows)
            text, recurring = {r["doc_id"]: r["text"] for r in rows}, collections.Counter()
            for r in before:
                recurring.update({x for x in r["text"].split("\n") if x.strip()})
            for r in before:
                lines = iter(r["text"].split("\n"))
                assert all(x in lines for x in text[r["doc_id"]].split("\n"))  # in order, none changed
                assert {x for x in text[r["doc_id"]].split("\n") if x.strip() and recurring[x] > 60} == set()
        if name == "simhash_neardup":
            label, _ = five_word_groups([r["text"] for r in before])
            assert left == {before[k]["doc_id"] for k in label}
        if name == "benchmark_decontamination":
            listed = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert {r["doc_id"] for r in before} - left == {r["doc_id"] for r in before if any(b in " ".join(r["text"].split()) for b in listed)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r["doc_id"]: list(r["piece_ids"]) for r in last} == {r["doc_id"]: library.encode(r["text"]) for r in kept.collect()}
    assert all(r["round_trip"] for r in last)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last))


def test_rows_that_share_an_id(spark):
    """Different texts under one id, null ids too, are told apart by every stage."""
    big, story = (1 << 60) + 1, lambda k: " ".join(f"word{k}x{j % 97}y{j}" for j in range(80)) + "."
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [(big, story(1)), (big, story(2)), (None, story(3)), (None, story(4)), (None, story(1)), (big + 1, story(2)), (None, benchmark), (None, story(5)), (big, benchmark), (big, story(1))]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t), "a", "b") for k, t in rows], SCHEMA)
    near = [(r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_neardup(spark, docs, SF).collect()]
    assert sorted(near, key=str) == sorted([(big, story(1)), (big, story(2)), (None, story(3)), (None, story(4)), (None, story(5)), (big, benchmark)], key=str)
    clean = [(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_decontamination(spark, docs, SF).collect()]
    assert sorted(clean, key=str) == sorted([r for r in rows if r[1] != benchmark], key=str)


def test_hard_rows(spark):
    text = "These are plain sentences that tell of a quiet day. " * 4
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "", "", 0, "a", "b"), (None, text + "One more of them ends it here, at last and for good.", "en", "s", 3, "a", "b"), (4, text, "en", "s", 4, None, None), (4, text, "en", "s", 4, None, None), (5, "x" * 200_000, "en", "s", 5, "a", "b")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, some, SF)
            assert out.columns == docs.columns
            out.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, some, SF).count() == some.count()
    near = corpus_pipeline.simhash_neardup(spark, docs, SF)
    assert near.where("doc_id = 4").count() == 1 and near.where("doc_id is null").count() == 1
    assert near.where(F.col("doc_id").isin(1, 2)).count() == 1 and near.count() == 4


def test_registry():
    assert sorted(n.split("_")[0] for n in registry.QUERIES) == sorted(f"op{k}" for k in range(1, 11))


def test_sql_of_the_corpus_queries(spark):
    import duckdb

    duck = duckdb.connect()
    for name in ("documents", "pages"):
        duck.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    for name, sql in registry.ORACLE_SQL.items():
        df = registry.QUERIES[name](spark, SF)
        found = duck.execute(sql)
        names = [d[0] for d in found.description]
        assert sorted(df.columns) == sorted(names)
        assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)


def five_word_groups(texts):
    """Least index of each text's group: chains of pairs of at least 0.8 by brute force over five-word shingles."""
    split = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in split]
    label, pairs = list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and (both := len(a & b)) >= 0.8 * (len(a) + len(b) - both):
                pairs.append((j, i))
                x, y = sorted((label[i], label[j]))
                label = [x if v == y else v for v in label]
    return label, pairs


def test_near_copies_of_the_stage(spark):
    """Near copies far beyond two bits go, and groups are those of brute force."""
    import random

    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(1, 30):
        w = base[:]
        for p in r.sample(range(300), k % 12):
            w[p] = f"changed{k}x{p}"
        texts.append(" ".join(w))
    passage = base[:60]
    texts += [" ".join(passage + [f"own{k}x{r.randrange(9000)}" for _ in range(60)]) for k in range(20)] + [None, "", "a b", "A  b"]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "a", "b") for i, t in enumerate(texts)], SCHEMA)
    label, pairs = five_word_groups(texts)
    assert len(pairs) > 100 and label[1] == 0
    assert {x["doc_id"] for x in corpus_pipeline.simhash_neardup(spark, docs, SF).collect()} == set(label)


def test_near_copies_of_a_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    from leadmill.llm import similar

    label, pairs = five_word_groups([x["text"] for x in rows])
    found = {x["doc_id"]: x["component_id"] for x in similar.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert pairs and [found[x["doc_id"]] for x in rows] == [rows[k]["doc_id"] for k in label]
