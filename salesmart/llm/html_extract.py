"""Main text of web pages: block extraction, and differencing against the pages with the nearest URLs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import materialise, partitions

# Elements by role, and the words of a class or id that mark furniture.
BLOCK = frozenset("address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style template noscript svg iframe object select button textarea nav footer aside head title dialog".split())
MAIN = frozenset(("article", "main"))
HEAD = frozenset("base bgsound link meta noscript script style template title".split())
#: Elements of text itself: one of several names doesn't make them furniture.
TEXT = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre li dd dt td th tr b i em strong".split())
WORDS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion disqus
footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications pager pagination
popup promo promotion related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar topbar widget""".split())
PLAIN = frozenset("area bar block bottom box buttons container content inner item items left list main page post right section site top wrap wrapper".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Share of a page's characters from which on a neighbour that shares them is a copy, and not differenced.
COPY = 0.9
#: An opening tag of these ends an open paragraph.
_CLOSES_P = BLOCK - {"body", "html"}
_SPACE = re.compile(r"\s+")


def _furniture(tag: str, names: str) -> bool:
    """Whether classes and ids say furniture: one of the names (all of a text element's) has words for furniture and plain ones alone."""
    parts = [set(re.split(r"[_-]+", name)) - {""} for name in names.lower().split()]
    found = [bool(p & WORDS) and p <= WORDS | PLAIN for p in parts]
    return bool(found) and (all(found) if tag in TEXT else any(found))


class _Blocks(HTMLParser):
    """Collects (protected, in a form, text) blocks in page order; protected ones stand in the page's article."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, hides, is the article
        self.count: Counter = Counter()  # open elements by tag
        self.hidden = self.article = 0
        self.parts: list[str] = []
        self.blocks: list[tuple[bool, bool, str]] = []

    def flush(self) -> None:
        if self.parts:
            text = _SPACE.sub(" ", "".join(self.parts)).strip()
            if text:
                self.blocks.append((self.article > 0, self.count["form"] > 0, text))
            self.parts = []

    def pop(self) -> None:
        tag, hides, main = self.open.pop()
        self.count[tag] -= 1
        self.hidden -= hides
        self.article -= main

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag == "br":
            self.parts.append(" ")
        if tag not in HEAD and self.count["head"]:  # its end tag may be left out
            while self.open[-1][0] != "head":
                self.pop()
            self.pop()
        if tag in VOID:
            return
        if tag in _CLOSES_P and self.count["p"]:
            while self.open[-1][0] != "p":
                if self.open[-1][0] in BLOCK:
                    break
                self.pop()
            if self.open[-1][0] == "p":
                self.pop()
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        hides = tag in SKIP or (tag == "header" and not self.article)  # an article's own header holds its title
        hides = hides or bool(names and tag not in MAIN and tag not in ("html", "body") and not (tag == "header" and self.article) and _furniture(tag, names))
        hides = hides or any(k == "hidden" or (k == "style" and v and UNSEEN.search(v)) for k, v in attrs)
        main = tag in MAIN or any(k == "role" and v == "main" for k, v in attrs)
        self.open.append((tag, hides, main))
        self.count[tag] += 1
        self.hidden += hides
        self.article += main

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK or tag == "br":
            self.handle_starttag("br" if tag not in BLOCK else "hr", attrs)

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        if self.count[tag]:
            while self.open[-1][0] != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def _parsed(html: str | None) -> list[tuple[bool, str]]:
    """(in an article, text) of the blocks. Forms give none, but for one that is wrapped around most of the page's text."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    inside = sum(len(t) for _, form, t in p.blocks if form)
    wrapped = 2 * inside > sum(len(t) for _, _, t in p.blocks)
    return [(own, t) for own, form, t in p.blocks if wrapped or not form]


def blocks(html: str | None) -> tuple[list[str], list[str]]:
    """Blocks of the article, and blocks outside any article; hidden and furniture elements give none."""
    found = _parsed(html)
    return [t for own, t in found if own], [t for own, t in found if not own]


def guarded(html: str | None) -> tuple[list[str], list[bool]]:
    """Blocks in page order, and whether each is protected: it stands in an article and articles hold most of the page's text."""
    found = _parsed(html)
    most = 2 * sum(len(t) for own, t in found if own) > sum(len(t) for _, t in found)
    return [t for _, t in found], [own and most for own, _ in found]


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    """Lower-cased host without www., and the path without query, fragment or trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.substring_index(bare, "/", 1)), r"^www\.", "")
    return host, F.regexp_replace(F.regexp_replace(bare, r"^[^/]*", ""), r"/+$", "")


def _lengths(a: list, b: list) -> np.ndarray:
    """Length of a longest common subsequence of ``a`` and each beginning of ``b``, by bits of whole numbers."""
    places: dict = {}
    for j, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for t in a:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def common_lines(a: list, b: list) -> set[int]:
    """Indices of ``a`` in a longest common subsequence of lines of both.

    The first half of ``a`` is aligned with the beginning of ``b`` and the second with the rest, where both
    lengths add up to most, and so on: memory grows with the lines of both and not with their product.
    """
    both = set(a) & set(b)
    shared: set[int] = set()
    todo = [([i for i, t in enumerate(a) if t in both], [t for t in b if t in both])]
    while todo:
        own, other = todo.pop()
        while own and other and a[own[0]] == other[0]:
            shared.add(own[0])
            own, other = own[1:], other[1:]
        if not own or not other:
            continue
        if len(own) == 1:
            shared.update(own if a[own[0]] in other else [])
            continue
        half = len(own) // 2
        lines = [a[i] for i in own]
        split = int((_lengths(lines[:half], other) + _lengths(lines[half:][::-1], other[::-1])[::-1]).argmax())
        todo += [(own[:half], other[:split]), (own[half:], other[split:])]
    return shared


def _runs(lines: DataFrame, order: list[str]) -> DataFrame:
    """``lines`` with ``start``, whether a row begins a run of equal pages, and ``head``, the key of its run's first row.

    Ranges of (host, path) split a large host over tasks; what goes across an edge comes from one row a range.
    """
    key, same = F.struct(*order), F.struct("host", "x")
    over = Window.orderBy("range")  # one row a range
    own = Window.partitionBy("range").orderBy(*order)
    edge = lines.groupBy("range").agg(F.max_by(same, key).alias("last"))
    edge = edge.select("range", F.lag("last").over(over).alias("e_before"))
    found = lines.join(F.broadcast(edge), "range", "left").withColumn("before", F.coalesce(F.lag(same).over(own), "e_before"))
    found = materialise(found.withColumn("start", F.col("before").isNull() | (F.col("before") != same)).drop("before", "e_before"))
    heads = found.groupBy("range").agg(F.max(F.when(F.col("start"), key)).alias("head"))
    heads = heads.select("range", F.last("head", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("e_head"))
    mine = F.last(F.when(F.col("start"), key), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return found.join(F.broadcast(heads), "range", "left").withColumn("head", F.coalesce(mine, "e_head")).drop("e_head")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    A page is its blocks in page order, less the lines it shares with the nearest different page before
    and after it by URL path on its host (longest common subsequence, on hashes of the lines). Equal pages
    beside each other are one run with one pair of neighbours, and a neighbour that shares ``COPY`` of the
    page's characters is a near copy and takes nothing. Lines inside an article or main element stay whatever
    other pages say, where such elements hold most of the page's text; otherwise the mark counts for nothing.
    Pages alone on a host, and pages that would lose every line, keep all. Null html is empty, a null url is
    the empty host; repeated rows are pages of their own, other columns are ignored, an empty table gives no
    row. Very long pages are parsed whole, in time and memory that grow with their length.
    """
    host, path = host_and_path(F.col("url"))

    @F.pandas_udf("lines array<string>, guard array<boolean>")
    def parsed(htmls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in htmls:
            yield pd.DataFrame([guarded(h) for h in batch], columns=["lines", "guard"])

    spark = pages.sparkSession
    order = ["host", "path", "x"]
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"), parsed("html").alias("b")).select("page_id", "url", "host", "path", "b.*")
    base = base.withColumn("x", F.xxhash64("lines")).withColumn("open", F.exists("guard", lambda g: ~g))
    base = materialise(base)  # parsed once; only hashes of lines, and pages with lines to lose, are dealt out below
    hosts = base.where("open").select("host").distinct()  # on other hosts no page has lines to lose
    lines = base.where(F.size("lines") > 0).select(*order, "open", F.transform("lines", lambda t: F.xxhash64(t)).alias("hashes"), F.transform("lines", lambda t: F.length(t)).alias("sizes"))
    lines = lines.join(hosts, "host")  # not a semi-join, which the optimizer moves below the hashing, where it would deal out the texts
    lines = lines.groupBy(*order).agg(F.first("hashes").alias("hashes"), F.first("sizes").alias("sizes"), F.max("open").alias("open"))  # alike pages stand once
    lines = materialise(lines.repartitionByRange(partitions(spark), *order).withColumn("range", F.spark_partition_id()))
    runs = materialise(_runs(lines, order))
    heads = runs.where("start").select(*order, "hashes", "sizes", "head").repartitionByRange(partitions(spark), *order)
    heads = materialise(heads.withColumn("range", F.spark_partition_id()))
    me, key = F.struct("host", "hashes"), F.struct(*order)
    edge = heads.groupBy("range").agg(F.min_by(me, key).alias("first"), F.max_by(me, key).alias("last"))
    over = Window.orderBy("range")  # one row a range
    edge = edge.select("range", F.lag("last").over(over).alias("e_before"), F.lead("first").over(over).alias("e_after"))
    own = Window.partitionBy("range").orderBy(*order)
    near = heads.withColumn("before", F.lag(me).over(own)).withColumn("after", F.lead(me).over(own)).join(edge, "range", "left")
    near = near.join(runs.where("open").select("head").distinct(), "head", "left_semi")
    near = near.select("head", "hashes", "sizes", "host", F.array(F.coalesce("before", "e_before"), F.coalesce("after", "e_after")).alias("near"))
    near = near.withColumn("near", F.filter("near", lambda n: n.isNotNull() & (n["host"] == F.col("host"))))

    @F.pandas_udf("array<int>")
    def shared(hashes: pd.Series, sizes: pd.Series, near_: pd.Series) -> pd.Series:
        out = []
        for own_lines, size, others in zip(hashes, sizes, near_):
            gone: set[int] = set()
            for other in others:
                same = common_lines(own_lines.tolist(), other.tolist())
                if sum(size[k] for k in same) < COPY * size.sum():
                    gone |= same
            out.append(sorted(gone))
        return pd.Series(out, dtype="object")

    gone = near.select("head", shared("hashes", "sizes", F.transform("near", lambda n: n["hashes"])).alias("gone"))
    gone = runs.where("open").select(*order, "head").join(gone, "head").select(*order, "gone")
    left = F.filter("lines", lambda t, i: F.element_at("guard", i + 1) | ~F.array_contains("gone", i))
    bare = base.where("open").join(gone, order, "left").withColumn("left", left)
    bare = bare.select("page_id", "url", F.array_join(F.when(F.size("left") > 0, F.col("left")).otherwise(F.col("lines")), "\n").alias("text"))
    out = base.where("not open").select("page_id", "url", F.array_join("lines", "\n").alias("text")).unionByName(bare)
    return out.withColumn("n_chars", F.length("text").cast("long"))
