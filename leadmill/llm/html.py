"""Main text of HTML pages by consensus host paths.

1. Every page scores its containers and votes for the deepest one that holds at
   least 70 % of its text (without menus, forms and the like, and without links),
   by a generalised path of tags and classes.
2. Spark counts the votes per host and path, and keeps for each host the paths
   with at least a fifth of its votes, five at most.
3. Every page is extracted again by its host's paths, the first in order of votes
   that holds a fifth of the page's text, else the first that it has; a page that
   has none of them falls back to its own container.
4. The container found is where most of the article stands, not all of it: the
   text is that of the main or article element around it, or without one of the
   elements around it that hold text of their own or the page's h1.

Furniture is told by tags and by words of class, id and role. A word counts
where it is a whole token ("sidebar") or a part of one ("sidebar-left"), but not
beside a qualifier ("with-sidebar", "no-comments"). It is no veto: an element that
holds most of the page's unlinked text stays if without it nothing of the page is
left, or only a fifth and no token names it outright, or the page's only article
stands in it. Lists of links outside an article are menus.

A page is read in one pass, in time that grows with its length however deep
elements nest; a path is a 64-bit hash. The table of paths is broadcast where its
measured bytes allow and joined by shuffle beyond, where Spark splits a hot
host's rows. Pages are parsed one at a time.

Defined results: null or empty html has empty text; a null URL belongs to the
host "" ; a page without tags is one block of text; pages cut off inside a tag
or an element keep what came before; repeated rows are extracted each for itself.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadmill.llm import urls
from leadmill.llm.common import small

#: A comment, a tag with its attributes (a quote opens a value only after "="), another declaration, or a tag that the page's end cuts off.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=)*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z""", re.S)
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
#: Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style noscript template textarea title iframe".split())
LEFT_OUT = frozenset("nav footer aside form menu dialog head".split())
MUTED = ("button", "select", "svg")  # inline: their text goes, the line around them goes on
NEVER_OUT = frozenset("html body main".split())
CONTAINERS = frozenset("html body main article section div td center blockquote".split())
LISTS = frozenset("ul ol dl table".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("table td th div article section main body html ul ol dl aside nav header footer form blockquote figure".split())
#: Words that name furniture (a whole word, or what a word begins with), reader comments among them, and words beside which they name nothing.
EXACT = frozenset("ad ads header masthead menu menus nav navbar navigation notice notices pager related replies respond responses share shares sharing skip".split())
STARTS = ("advert", "banner", "breadcrumb", "comment", "consent", "cookie", "disqus", "footer", "login", "modal", "newsletter", "paginat", "popup", "promo", "sidebar", "signup", "social", "sponsor", "subscri", "toolbar", "widget")
READERS = ("comment", "disqus", "replies", "respond", "responses")
QUALIFIERS = frozenset("no not none non without with has have hide hidden show enabled disabled open closed is".split())
WEAK, STRONG, READER = 1, 2, 3


#: Whole words of furniture beyond those above, and words beside which these still name furniture.
WHOLE = EXACT | frozenset(STARTS) | frozenset("adverts advertisement advertisements advertising banners breadcrumbs comments cookies footers modals newsletters pagination paginator popups promos sidebars sponsors sponsored subscribe subscription toolbars widgets".split())
BESIDE = frozenset("area article articles bar block bottom box button buttons container content entry form inner item items js left link links list main outer panel post posts right section site slot thread top unit wrap wrapper".split())
_known: dict[str, tuple[int, bool, bool]] = {}  # travels with the functions that use it, unlike a cache object


def furniture(token: str) -> tuple[int, bool, bool]:
    """Whether a token of class, id or role names furniture, whether it is but a header, and whether no word of it says anything else."""
    found = _known.get(token)
    if found is None:
        if len(_known) >= 4096:
            _known.clear()
        found = _known[token] = _furniture(token)
    return found


def _furniture(token: str) -> tuple[int, bool, bool]:
    parts = [x for x in re.split(r"[^a-z]+", token) if x]
    if QUALIFIERS.intersection(parts):
        return 0, False, False
    met = [x for x in parts if x in EXACT or x.startswith(STARTS)]
    if not met:
        return 0, False, False
    own = [x in WHOLE or any(x.startswith(w) and x[len(w) :].removeprefix("s") in BESIDE for w in STARTS) for x in parts]
    whole = any(own) and all(o or x in BESIDE for o, x in zip(own, parts))
    if any(x.startswith(READERS) for x in met):
        return READER, False, whole
    return (STRONG if len(parts) == 1 else WEAK), all(x in ("header", "masthead") for x in met), whole


def attributes(found: str) -> tuple[list[str], list[str]]:
    """Tokens of the class, and of class, id and role. Single letters run together in camel case are parted."""
    classes, tokens = [], []
    for name, value in NAMES.findall(found):
        value = value.strip("\"'")
        tokens += re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split()
        if name.lower() == "class":
            classes = value.lower().split()
    return classes, tokens


class Page:
    """Blocks of one page in order, each with its text, linked characters and node; nodes (elements that matter) with their paths."""

    def __init__(self, html: str | None):
        self.names, self.tags, self.paths, self.parents, self.depths, self.bad, self.within = [""], [""], [0], [-1], [0], [0], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self.lines: list[tuple[int, bool]] = []  # of each block: its line, as an inline element may cut one, and whether a space comes before
        self.line, self.spaced = 0, False
        self.titles: list[int] = []  # nodes of the h1 blocks
        self.title_blocks: list[int] = []
        self.links_in: dict[int, int] = defaultdict(int)  # of lists: links
        self.stack: list[tuple[str, int]] = [("", 0)]  # tag, node
        self.open: dict[str, list[int]] = defaultdict(list)  # depths of the open elements of each tag
        self.bounds: dict[frozenset, list[int]] = {SCOPE: [], BLOCKS: [], **{SCOPE - {t}: [] for t in ENDS}, SCOPE - {"td", "th"}: []}
        self.parts: list[str] = []
        self.linked = 0
        self._read(html or "")
        self._judge()

    def _text(self, raw: str) -> None:
        if raw and not any(map(self.open.get, MUTED)):
            text = unescape(raw) if "&" in raw else raw
            self.parts.append(text)
            if self.open["a"]:
                self.linked += len(text.strip())

    def _flush(self, line_ends: bool = True) -> None:
        if self.parts:
            raw = "".join(self.parts)
            text = " ".join(raw.split())
            if text:
                self.blocks.append((self.stack[-1][1], text, self.linked))
                self.lines.append((self.line, raw[0].isspace() or self.spaced))
                if self.stack[-1][0] == "h1":
                    self.titles.append(self.stack[-1][1])
                    self.title_blocks.append(len(self.blocks) - 1)
            self.spaced = raw[-1].isspace() or not text and self.spaced
            self.parts = []
        self.linked = 0
        if line_ends:
            self.line, self.spaced = self.line + 1, False

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            tag, _ = self.stack.pop()
            self.open[tag].pop()
            for among, at in self.bounds.items():
                if tag in among:
                    at.pop()

    def _end(self, tag: str, among: frozenset | None = None) -> None:
        """Close the nearest open element of this tag, not beyond an element of `among`."""
        at = self.open[tag]
        if at and not (among and self.bounds[among] and self.bounds[among][-1] > at[-1]):
            # text of a node of its own is judged by itself
            if tag in BLOCKS or self.stack[-1][1] != self.stack[at[-1] - 1][1]:
                self._flush(line_ends=tag in BLOCKS)
            self._close_to(at[-1])

    def _start(self, tag: str, found: str) -> None:
        if tag in BLOCKS:
            self._flush()
            self._end("p", SCOPE)
            for other in ENDS.get(tag, ()):
                self._end(other, SCOPE - {"td", "th"} if tag == "tr" else SCOPE - {other})
        elif tag == "a":
            self._end("a", BLOCKS)
        if tag == "br":
            self._text(" ")
        if tag in VOID:
            return
        node = self.stack[-1][1]
        classes, tokens = attributes(found) if "=" in found else ([], [])
        within, bad = self.within[node], 0
        if tag not in NEVER_OUT:
            for token in tokens:
                found_bad, header, whole = furniture(token)
                # a header inside an article holds its title, and its sections may be called by more than furniture
                if found_bad and not (within and (header or not whole)) and not (tag == "article" and found_bad != READER):
                    bad = max(bad, found_bad)
            if tag == "form":
                bad = max(bad, WEAK)
            elif tag in LEFT_OUT or tag == "header" and not within or re.search(r"(?:^|\s)hidden(?:\s|=|$)", found):
                bad = max(bad, STRONG)
        if tag in CONTAINERS or tag in LISTS or bad:
            if bad and tag not in BLOCKS:
                self._flush(line_ends=False)
            name = ".".join([tag, *sorted({re.sub(r"\d+", "#", c) for c in classes})])
            self.names.append(name)
            self.tags.append(tag)
            self.paths.append(xxhash.xxh64_intdigest(name.encode("utf-8", "replace"), self.paths[node]))
            self.parents.append(node)
            self.depths.append(self.depths[node] + 1)
            self.bad.append(bad)
            self.within.append(within or tag in ("article", "main") and not bad)
            node = len(self.names) - 1
        if tag == "a":
            self.links_in[node] += 1
        self.stack.append((tag, node))
        self.open[tag].append(len(self.stack) - 1)
        for among, at in self.bounds.items():
            if tag in among:
                at.append(len(self.stack) - 1)

    def _read(self, html: str) -> None:
        at, unended = 0, set()
        while m := TAG.search(html, at):
            self._text(html[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                # an inline end tag doesn't reach beyond the block it stands in
                self._end(tag, None if tag in BLOCKS else BLOCKS)
            elif tag in RAW:
                end = None if tag in unended else re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                if end:
                    at = end.end()
                elif tag in ("script", "style", "textarea", "title"):
                    at = len(html)
                else:
                    unended.add(tag)
            else:
                self._start(tag, m[3] or "")
        self._text(html[at:])
        self._flush()

    def _sums(self, each: list[int]) -> list[int]:
        """For each node the sum over it and all nodes inside it; nodes are numbered in page order."""
        out = each[:]
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out

    def _judge(self) -> None:
        """Which nodes are furniture."""
        n = len(self.names)
        plain, length, linked = [0] * n, [0] * n, [0] * n
        for k, text, links in self.blocks:
            plain[k] += max(0, len(text) - 2 * links)
            length[k] += len(text)
            linked[k] += min(links, len(text))
        whole = self._sums(plain)
        if any(t in LISTS for t in self.tags):
            lengths, links, counts = self._sums(length), self._sums(linked), self._sums([self.links_in.get(k, 0) for k in range(n)])
            for k in range(n):
                if self.tags[k] in LISTS and not self.within[k] and counts[k] >= 3 and 10 * links[k] >= 8 * lengths[k]:
                    self.bad[k] = self.bad[k] or STRONG
        bad, total = self.bad, whole[0]
        named = [int(self.tags[k] in ("article", "main") and not bad[k]) for k in range(n)]
        named_in = self._sums(named)
        for k in self.titles:
            named[k] += 1
        main_in = self._sums(named)

        def marked(spared: set[int]) -> list[bool]:
            out = [False] * n
            for k in range(1, n):
                out[k] = out[self.parents[k]] or bad[k] > 0 and k not in spared
            return out

        self.out = marked(set())
        kept = sum(plain[k] for k in range(n) if not self.out[k])
        large = [k for k in range(1, n) if bad[k] and 2 * whole[k] >= total > 0]
        if large:
            main_outside = any(named[k] and not self.out[k] and self.tags[k] in ("article", "main") for k in range(n))
            spared = {k for k in large if kept == 0 or bad[k] == WEAK and 5 * kept < total or bad[k] != READER and (main_in[k] if kept == 0 else named_in[k]) and not main_outside}
            if spared:
                self.out = marked(spared)

    def own(self) -> list[int]:
        """Unlinked characters of each node's own blocks that are no furniture."""
        weight = [0] * len(self.names)
        for k, text, linked in self.blocks:
            if not self.out[k]:
                weight[k] += max(0, len(text) - 2 * linked)
        return weight

    def best(self) -> tuple[int, float]:
        """The deepest container with at least 70 % of the page's unlinked text, and its share."""
        weight = self._sums(self.own())
        total = weight[0]
        if not total:
            return 0, 0.0
        # below one that qualifies at most one other can
        k = max((k for k in range(len(weight)) if 10 * weight[k] >= 7 * total and (not k or self.tags[k] in CONTAINERS)), key=self.depths.__getitem__)
        return k, weight[k] / total

    def path(self, k: int) -> str:
        names = []
        while k > 0:
            names.append(self.names[k])
            k = self.parents[k]
        return ">".join(["", *reversed(names)])

    def around(self, own: list[int]) -> list[int]:
        """For each node the one that holds the whole article of which it is a part: the outermost main, else article, else the outermost with text or an h1 of its own."""
        n, titled = len(self.names), set()
        for k in self.titles:
            while k > 0 and k not in titled and not self.out[k]:
                titled.add(k)
                k = self.parents[k]
        mains, articles, tops, found = [-1] * n, [-1] * n, [-1] * n, [0] * n
        for k in range(1, n):
            up, tag = self.parents[k], self.tags[k]
            mains[k] = mains[up] if mains[up] >= 0 or tag != "main" else k
            articles[k] = articles[up] if articles[up] >= 0 or tag != "article" else k
            tops[k] = tops[up] if tops[up] >= 0 or not (own[k] or k in titled and tag not in ("body", "html")) else k
            found[k] = next((x for x in (mains[k], articles[k]) if x >= 0), 0 if own[0] else tops[k] if tops[k] >= 0 else k)
        return found

    def text(self, paths: list[int]) -> tuple[str, str]:
        """The text of the article around the first of the paths that the page has, else around its own best container; and that path."""
        known = {p: set() for p in paths}
        for k, p in enumerate(self.paths):
            if p in known and not self.out[k]:
                known[p].add(k)
        met = [p for p in paths if known[p]]
        own = self.own()
        if met:
            weight = self._sums(own) if len(met) > 1 else None
            chosen = known[next((p for p in met if weight and 5 * sum(weight[k] for k in known[p]) >= weight[0]), met[0])]
        else:
            chosen = {self.best()[0]}
        around = self.around(own)
        whole = {around[k] for k in chosen}
        inside = [False] * len(self.names)
        for k in range(len(self.names)):
            inside[k] = not self.out[k] and (k in whole or (self.parents[k] >= 0 and inside[self.parents[k]]))
        kept = {k for k, (c, _, _) in enumerate(self.blocks) if inside[c]}
        if not kept and met:
            return self.text([])
        kept |= self._title(whole, kept)
        out, last = [], -1
        for k in sorted(kept):
            line, spaced = self.lines[k]
            out.append(("" if last < 0 else "\n" if line != last else " " if spaced else "") + self.blocks[k][1])
            last = line
        return "".join(out), self.path(min(chosen))

    def _title(self, whole: set[int], kept: set[int]) -> set[int]:
        """Blocks of the page's one h1 where it stands outside the article: with all of the element beside the article that
        holds it, or alone where that element holds the article too."""
        titles = [k for k in self.title_blocks if not self.out[self.blocks[k][0]]]
        if len(titles) != 1 or kept.intersection(titles) or not kept:
            return set()
        above = set()
        for k in whole:
            while k >= 0 and k not in above:
                above.add(k)
                k = self.parents[k]
        at, top = self.blocks[titles[0]][0], -1
        while at not in above:
            at, top = self.parents[at], at
        if top < 0:
            return set(titles)
        held = [False] * len(self.names)
        for k in range(top, len(self.names)):
            held[k] = not self.out[k] and (k == top or held[self.parents[k]])
        return {k for k, (c, _, _) in enumerate(self.blocks) if held[c]}


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def votes(pages: DataFrame) -> DataFrame:
    """host, path (a hash), score of each page's best container; pages: host, html."""

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for host, html in zip(b["host"], b["html"]):
                page = Page(html)
                k, share = page.best()
                if share:
                    rows.append((host, signed(page.paths[k]), share))
            yield pd.DataFrame(rows, columns=["host", "path", "score"])

    return pages.mapInPandas(vote, "host string, path long, score double")


def consensus(voted: DataFrame, least: float = 0.2) -> DataFrame:
    """host and its paths: those with at least a fifth of the votes, most votes first."""
    counted = voted.groupBy("host", "path").agg(F.count("*").alias("n"))
    hosts = counted.groupBy("host").agg(F.sum("n").alias("all"))
    won = counted.join(hosts, "host").where(F.col("n") >= least * F.col("all"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "path")))  # at most 1 / least paths
    return won.groupBy("host").agg(F.transform(ranked, lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages without html, with text, n_chars and main_path."""
    kept = [c for c in pages.columns if c != html and c.lower() not in ("text", "n_chars", "main_path")]
    named = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce(F.col(url), F.lit("")).alias("__url"), F.col(html).alias("html"))
    named = named.select("row", urls.host_of(F.col("__url")).alias("host"), "html")
    won = small(consensus(votes(named.select("host", "html"))), "host_paths")

    @F.pandas_udf("text string, path string")
    def again(htmls: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([Page(h).text([] if p is None else [int(x) & (1 << 64) - 1 for x in p]) for h, p in zip(htmls, paths)], columns=["text", "path"])

    met = named.join(won, "host", "left").select("row", again("html", "paths").alias("main"))
    return met.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], F.col("main.text").alias("text"), F.length("main.text").cast("long").alias("n_chars"), F.col("main.path").alias("main_path"))
