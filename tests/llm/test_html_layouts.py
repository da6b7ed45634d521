"""Articles in layouts of many kinds: text is kept whole, one line a block, and tasks need no installed package."""

import itertools
import os
import subprocess
import sys
from pathlib import Path

import pytest

from leadmill.llm.html import Page

BODY = "<p>First paragraph of the article with a fair number of words in it.</p><p>Second paragraph of the article, no shorter than the first one was.</p>"
LINES = ["First paragraph of the article with a fair number of words in it.", "Second paragraph of the article, no shorter than the first one was."]
NAV = "<nav><a href=/>Home</a> <a href=/a>About</a></nav>"
FOOT = "<footer>All rights reserved</footer>"


def lines(html):
    return Page(html).text([])[0].split("\n")


@pytest.mark.parametrize("page", [
    f"<html><body>{NAV}<h1>Title</h1><article>{BODY}</article>{FOOT}</body></html>",
    f"<html><body>{NAV}<div class=top><h1>Title</h1></div><main>{BODY}</main>{FOOT}</body></html>",
    f"<html><body>{NAV}<div class=wrap><div><h1>Title</h1></div><div class=content>{BODY}</div></div>{FOOT}</body></html>",
    f"<html><body>{NAV}<div id=page><h1>Title</h1>{BODY}</div>{FOOT}</body></html>",
    f"<html><body>{NAV}<table><tr><td><h1>Title</h1>{BODY}</td></tr></table>{FOOT}</body></html>",
])
def test_titles_outside_the_article(page):
    assert lines(page) == ["Title", *LINES]


def test_lead_beside_the_title():
    assert lines(f"<body>{NAV}<div><h1>Title</h1><p>Lead.</p></div><main>{BODY}</main>{FOOT}</body>") == ["Title", "Lead.", *LINES]


def test_a_site_name_in_a_header_is_no_title():
    assert lines(f"<body><header><h1>Site</h1></header><article><h2>Title</h2>{BODY}</article></body>") == ["Title", *LINES]


@pytest.mark.parametrize("name", ["class=commentary", "class=promotion-of-health", "id=social-history", "class='banner-year'", "class=widget-theory"])
def test_sections_named_by_more_than_furniture(name):
    assert lines(f"<article>{BODY}<section {name}><p>Kept section.</p></section></article>") == [*LINES, "Kept section."]


@pytest.mark.parametrize("name", ["class=comments", "class='comment-list'", "id=newsletter-signup", "class=ad-slot", "class=share-buttons", "class=related", "class=advertisement", "class='promo-box'", "id=cookie-banner"])
def test_furniture_inside_an_article(name):
    assert lines(f"<article>{BODY}<section {name}><p>Left out.</p></section></article>") == LINES


def test_inline_elements_do_not_split_a_block():
    page = "<article><p>Before <math><mi>x</mi></math> after <button>go</button> end <svg><text>no</text></svg> tail</p><p>a<span class=share>Share</span>b <label>kept</label> <object>too</object></p>" + BODY + "</article>"
    assert lines(page)[:2] == ["Before x after end tail", "ab kept too"]


def test_blocks_of_generated_layouts():
    """Every wrapping of the article by up to three elements, with furniture on both sides, against the blocks put in."""
    for wraps in itertools.product(["div", "div class=content", "section", "main", "article", "td"], repeat=2):
        inner = f"<h1>Title</h1>{BODY}<ul><li>One point of the list of points</li><li>Another point of the list of points</li></ul>"
        for w in wraps:
            tag = w.split()[0]
            inner = f"<table><tr><{w}>{inner}</{tag}></tr></table>" if tag == "td" else f"<{w}>{inner}</{tag}>"
        page = f"<html><head><title>T</title></head><body><div class=menu><a href=/>Home</a></div>{inner}<div class=sidebar>Side</div><form><label>Mail</label></form><script>x</script>{FOOT}</body></html>"
        assert lines(page) == ["Title", *LINES, "One point of the list of points", "Another point of the list of points"], wraps


def test_queries_where_tasks_cannot_import_the_package(tmp_path):
    """All corpus queries from a folder from which workers can't import the package."""
    root = str(Path(__file__).parents[2])
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://{tmp_path}/shared").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
def seen(batches):
    import importlib.util
    for b in batches:
        yield b.assign(id=int(importlib.util.find_spec("leadmill") is not None))
assert spark.range(1).mapInPandas(seen, "id long").first()[0] == 0
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
        print("RAN", name)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert said.returncode == 0, said.stderr[-3000:]
    assert said.stdout.count("RAN") >= 14
