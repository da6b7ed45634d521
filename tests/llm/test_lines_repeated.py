"""Recurring lines with a field that varies go from repeated rows too."""

import random

from leadmill.llm import lines


def test_repeated_rows_lose_recurring_lines(spark):
    words = random.Random(3)
    r = [" ".join("".join(words.choice("abcdefgh") for _ in range(6)) for _ in range(14)) for _ in range(12)]
    texts = [f"{own}\nThis fine page was kindly written for you by author {'mnopqrstuvwx'[k] * 5} of our team" for k, own in enumerate(r)]
    rows = [*enumerate(texts), (0, texts[0]), (0, texts[0])]
    found = lines.drop_recurring(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(found) == 14 and {x["n_dropped"] for x in found} == {1}
    assert sorted(x["text"] for x in found) == sorted([*r, r[0], r[0]])
