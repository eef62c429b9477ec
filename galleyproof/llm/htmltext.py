"""Main text of web pages: a page's structure, and a host's suffix array for what structure does not tell.

Each page's visible text becomes a stream of blocks. Where the page marks its content (``article``, ``main`` and their roles) that
content, without what the tables below exclude, is the main text. Inside it a header is the article's own (its title), headings stay
whatever their id or class, and a class or id excludes only where it is a label and nothing else (``ad``, ``comment-list``; not
``notice-text``). The text outside it, and all text of pages that mark none, goes
into the host's token stream: suffix arrays over the streams find passages that distinct pages of a host repeat. Such a passage only
names candidates: removed are whole blocks inside them that stand on many of the host's unmarked pages whose longest blocks differ, in
runs of ``MIN_RUN`` bytes or more. So copies of one article count as one page however many there are, and a page's longest block is
never removed. What this keeps: the boilerplate of hosts with few unmarked pages, and of pages whose longest block is boilerplate
itself (by repetition alone that is a copied article with other text around it), and short runs. What it still removes of articles:
whole blocks quoted by a quarter of a host's pages, at least eight. Inside marked content the suffix array removes nothing: copied
articles and quoted passages repeat there, and the contract drops no part of an article (removing by repetition alone loses them, and
keeps adverts that a host shows once).

Passages are compared within a host and across distinct page ids. A host of any size is spread over the shards by its passages
(see ``repeats``); only the text outside marked content is shuffled, and blocks of unmarked pages are joined to their host's boilerplate.

Defined results: null or empty html gives the empty text; a null url is a host of its own; rows of one page id are one page; repeated
rows each give their own row; ids may be of any type; extra columns are passed over. A tag that nothing closes is text; a quote that
nothing closes is a character.
"""

from __future__ import annotations

import html
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from galleyproof.llm import common as C
from galleyproof.llm import repeats

#: Length in bytes from which a passage that distinct pages of a host repeat names candidates.
MIN_REPEAT, GRAM = 32, 16
#: A block is boilerplate from so many pages of distinct longest blocks, and from that share of the host's; removed in runs of so many bytes.
MIN_PAGES, MIN_SHARE, MIN_RUN = 8, 0.25, 100

NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
SPECIAL = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "xmp", "noembed", "noframes", "object")}
EXCLUDED = frozenset("nav header footer aside form button select dialog menu head label fieldset".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
LABELS = frozenset(
    "ad ads adv advert adverts advertisement advertisements adsense banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie "
    "cookies notice notices consent gdpr popup modal overlay newsletter subscribe subscription share sharing social related recommended comment comments disqus reply replies respond widget toolbar "
    "pagination pager login signup search".split()
)
#: Labels that rule out an ``article`` itself; page containers are never ruled out by a label.
ARTICLE_LABELS = frozenset("ad ads advert advertisement sponsored promo related recommended comment comments reply replies".split())
#: Words that may stand beside a label in a class or id and leave it a label; beside any other word it is part of a name of content.
BESIDE = frozenset(
    "site page main top bottom left right post article entry blog global primary secondary box banner container block wrapper wrap inner outer section area list bar form thread links "
    "buttons button icons posts articles stories content item items slot unit".split()
)
CONTAINERS = frozenset("html body main".split())
#: Elements that hold an article's own words: an id on them is an anchor, and a class of theirs no label.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NAME_PART = re.compile(r"[a-z0-9]+")


def _labelled(value: str, labels: frozenset[str]) -> bool:
    """Whether a word of a class or id is a label, alone or beside words that say only where or in what it stands."""
    for word in value.split():
        parts = NAME_PART.findall(word)
        if not labels.isdisjoint(parts) and all(p in LABELS or p in BESIDE or p.isdigit() for p in parts):
            return True
    return False


def _verdict(name: str, attributes: str, within: bool) -> tuple[bool, bool]:
    """(excluded, content root) of an element; ``within`` marked content a header, and a heading whatever its labels, belongs to it."""
    if name in EXCLUDED and not (within and name == "header"):
        return True, False
    root = name in ("article", "main")
    if not attributes:
        return False, root
    for m in ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        value = (m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False
        if key == "role":
            if value in ROLES:
                return True, False
            root |= value in ("main", "article")
        elif key == "itemprop":
            root |= value == "articlebody"
        elif key in ("class", "id") and name not in CONTAINERS and name not in HEADINGS:
            labels = ARTICLE_LABELS if name == "article" else LABELS - {"header", "masthead"} if within else LABELS
            if _labelled(value, labels):
                return True, False
    return False, root


class Tags:
    """Where a page's tags end, in time linear in the page whatever it leaves open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.seen, self.found = 0, -2
        self.failed: set[int] = set()
        self.open_ended: set[str] = set()

    def _special(self, at: int) -> int:
        if not (self.seen <= at <= self.found):
            m = SPECIAL.search(self.page, at)
            self.seen, self.found = at, m.start() if m else len(self.page)
        return self.found

    def end(self, at: int) -> int:
        """The place behind the tag whose name ends at ``at``: its first > outside quotes, else its first >; 0 if there is none."""
        if at > self.last:
            return 0
        start, page, visited = at, self.page, []
        while True:
            k = self._special(at)
            if k >= len(page) or k in self.failed:
                self.failed.update(visited)
                return page.find(">", start) + 1
            if page[k] == ">":
                return k + 1
            visited.append(k)
            close = -1 if page[k] in self.open_ended else page.find(page[k], k + 1)
            if close < 0:
                # a quote that nothing closes is a character
                self.open_ended.add(page[k])
                close = k
            at = close + 1


def blocks(page: str) -> tuple[list[str], list[str], bool]:
    """(blocks of marked content, blocks outside it, whether content is marked).

    Where content is marked, the outer blocks hold excluded elements too; else they are the page's text without those.
    """
    inner: list[str] = []
    outer: list[str] = []
    shut: list[str] = []
    held: list[str] = []
    marked = False
    roots: list[list] = []  # [name, open elements of that name]
    skip: list = []
    at, end = 0, len(page)

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                (shut if skip else inner if roots else outer).append(text)

    tags = Tags(page)
    while at < end:
        if page[at] != "<":
            stop = page.find("<", at)
            stop = stop if stop >= 0 else end
            held.append(html.unescape(page[at:stop]))
            at = stop
            continue
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            at = stop + 3 if stop >= 0 else end
            continue
        if at > tags.last:
            # no tag closes any more
            stop = page.find("<!--", at)
            held.append(html.unescape(page[at : stop if stop >= 0 else end]))
            break
        m = NAME.match(page, at + 1)
        if m is None and page[at + 1 : at + 2] not in ("!", "?", "/"):
            held.append("<")
            at += 1
            continue
        stop = tags.end(m.end()) if m else page.find(">", at) + 1
        if not stop:
            held.append("<")
            at += 1
            continue
        if m is None:
            at = stop
            continue
        name, attributes, at = m[2], page[m.end() : stop - 1], stop
        name = name.lower()
        if m[1]:
            if name in INLINE:
                if skip and skip[0] == name:
                    skip[1] -= 1
                    if not skip[1]:
                        flush()
                        skip = []
                continue
            flush()
            if skip:
                if name == skip[0]:
                    skip[1] -= 1
                    if not skip[1]:
                        skip = []
                elif name in ("body", "html"):
                    skip = []
            elif roots and name == roots[-1][0]:
                roots[-1][1] -= 1
                if not roots[-1][1]:
                    roots.pop()
            continue
        if name in RAW:
            stop = RAW[name].search(page, at)
            at = stop.end() if stop else end
            continue
        if name == "br":
            held.append("\n")
            continue
        if skip:
            if name not in INLINE:
                flush()
            if name == skip[0]:
                if name == "p":
                    skip = []
                elif not attributes.endswith("/"):
                    skip[1] += 1
            if skip:
                continue
        excluded, root = _verdict(name, attributes, bool(roots))
        if excluded or name not in INLINE:
            flush()
        if name in VOID or attributes.endswith("/"):
            continue
        if excluded:
            skip = [name, 1]
        elif root:
            marked = True
            roots.append([name, 1])
        elif roots and name == roots[-1][0]:
            roots[-1][1] += 1
    flush()
    return inner, outer + shut if marked else outer, marked


def host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", url or "")
    return (m[1] if m else "").lower()


OUT = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("n_repeated", T.LongType()), T.StructField("marked", T.BooleanType())]


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_repeat: int = MIN_REPEAT) -> DataFrame:
    """id, url, text, n_chars, n_repeated (bytes outside marked content that the host repeats; null where that was not asked), marked."""
    rows = C.own_columns(pages, id_col, url_col, html_col).toDF("id", "url", "text")
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(url_col, T.StringType()), *OUT])

    def main_text(table: pa.Table) -> pa.Table:
        found = [blocks(h or "") for h in table["text"].to_pylist()]
        use = pa.array([m for _, _, m in found], pa.bool_())
        texts = pa.array(["\n".join(inner) for inner, _, _ in found], pa.string())
        out = pa.table([table["id"], table["url"], texts, pc.utf8_length(texts).cast(pa.int64()), pa.nulls(len(found), pa.int64()), use], names=schema.names)
        return out.filter(use)

    outside = T.StructType([*(T.StructField(n, T.LongType()) for n in ("id", "scope")), T.StructField("text", T.StringType()), T.StructField("own", rows.schema["id"].dataType), T.StructField("url", T.StringType()), T.StructField("marked", T.BooleanType())])

    def outer_text(table: pa.Table) -> pa.Table:
        import xxhash

        found = [blocks(h or "") for h in table["text"].to_pylist()]
        scope = [xxhash.xxh3_64_intdigest(host(u)) - (1 << 63) for u in table["url"].to_pylist()]
        # pages are told apart by a hash of their id, whatever its type; a null id is larger than all
        codes = [None if i is None else (xxhash.xxh3_64_intdigest(repr(i)) >> 2) for i in table["id"].to_pylist()]
        return pa.table([pa.array(codes, pa.int64()), pa.array(scope, pa.int64()), pa.array(["\n".join(o) for _, o, _ in found], pa.string()), table["id"], table["url"], pa.array([m for *_, m in found])], names=outside.names)

    long = lambda name: T.StructField(name, T.LongType())
    page = T.StructType([T.StructField("own", rows.schema["id"].dataType), T.StructField("url", T.StringType()), long("scope"), T.StructField("lines", T.ArrayType(T.StringType())), T.StructField("keys", T.ArrayType(T.LongType())), long("lead"), long("n_repeated")])

    def candidates(table, text, offsets, covered):
        """Blocks of unmarked pages, with the hash of each that lies wholly in repeated passages (else null), and the longest one's hash."""
        import xxhash

        use = np.flatnonzero(~np.asarray(table["marked"]))
        lines, keys, leads, repeated = [], [], [], []
        for k in use.tolist():
            a, b = int(offsets[k]), int(offsets[k + 1])
            gone, found = covered[a:b], list(re.finditer(rb"[^\n]+", text[a:b].tobytes()))
            code = [xxhash.xxh3_64_intdigest(x[0]) - (1 << 63) for x in found]
            lead = max(zip((len(x[0]) for x in found), code, strict=True), default=(0, 0))[1]
            lines.append([x[0].decode() for x in found])
            keys.append([c if c != lead and gone[x.start() : x.end()].all() else None for x, c in zip(found, code, strict=True)])
            leads.append(lead)
            repeated.append(int(gone.sum()))
        part = table.take(use)
        longs = pa.int64()
        return pa.table([part["own"], part["url"], part["scope"], pa.array(lines, pa.list_(pa.string())), pa.array(keys, pa.list_(longs)), pa.array(leads, longs), pa.array(repeated, longs)], names=page.names)

    def unique_blocks(batches):
        for batch in batches:
            texts = []
            for lines, keys, common in zip(*(batch.column(c).to_pylist() for c in ("lines", "keys", "common")), strict=True):
                known, kept = set(common or ()), []
                for drop, run in itertools.groupby(zip(lines, keys, strict=True), lambda x: x[1] is not None and x[1] in known):
                    run = [line for line, _ in run]
                    if not drop or len("\n".join(run).encode()) < MIN_RUN:
                        kept += run
                texts.append("\n".join(kept))
            out = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("own"), batch.column("url"), out, pc.utf8_length(out).cast(pa.int64()), batch.column("n_repeated"), pa.array([False] * len(texts))], names=schema.names)

    # each branch reads the pages in its own narrow pass; only the text outside marked content is shuffled
    marked = C.map_chunks(rows, lambda: main_text, schema)
    streams = C.map_chunks(rows, lambda: outer_text, outside)
    rest = C.settle(repeats.cover(streams, candidates, page, min_len=min_repeat, gram=GRAM, smaller=False, batch_bytes=1 << 20))
    pages_of = lambda: F.least(F.count_distinct("lead"), F.count_distinct("own"))
    hosts = rest.groupBy("scope").agg(pages_of().alias("of"))
    counted = rest.select("scope", "own", "lead", F.explode("keys").alias("key")).filter("key is not null").groupBy("scope", "key").agg(pages_of().alias("n")).filter(F.col("n") >= MIN_PAGES)
    # of one host at most a few times the mean number of blocks of a page
    common = counted.join(hosts, "scope").filter(F.col("n") >= MIN_SHARE * F.col("of")).groupBy("scope").agg(F.collect_list("key").alias("common"))
    return marked.unionAll(rest.join(common, "scope", "left").mapInArrow(unique_blocks, schema))


def op1_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
