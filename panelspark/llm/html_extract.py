"""HTML main text by consensus host paths.

Each page scores its containers by the text they hold outside links and pruned
regions, and votes for the generalised tag-class path of the best one. Spark
counts the votes per host; of the paths that a page has, the one with most votes
on its host then says which of its containers are the article. A page without any
voted path falls back to the path of its own best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelspark.llm.common import stash

#: Hosts up to which the votes are broadcast, with PATHS_A_HOST paths each on average (a few hundred bytes); beyond, a shuffle join.
BROADCAST_HOSTS = 50_000
PATHS_A_HOST = 5
#: Parts into which the pages that ask for one path of one host are dealt in that join.
SALTS = 16

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements of running text: inside them only a clear advert or comment mark counts.
TEXT_TAGS = INLINE | frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dt dd figcaption".split())
CONTAINERS = frozenset("html body div section article main td center".split())
PRUNED_TAGS = frozenset("head nav header footer aside form script style noscript template iframe object svg canvas select button textarea dialog menu fieldset audio video map".split())
PRUNED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id name that mark something other than the article. The name
#: counts if all its words are of these or of STRUCTURE_WORDS: `search-box` is a search,
#: `search-results-study` is not.
PRUNED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar side rail widget widgets menu menus submenu nav navbar navigation topnav subnav "
    "breadcrumb breadcrumbs masthead footer foot colophon disqus respond replies reply comment comments commentlist commentform cookie cookies consent gdpr notice notices notification notifications "
    "alert alerts popup modal overlay lightbox newsletter subscribe subscription signup signin login register share sharing sharebar social related recommended recommendations pagination pager paging "
    "toolbar topbar legal disclaimer copyright hidden skip search searchbox header".split()
)
STRUCTURE_WORDS = frozenset(
    "area article articles bar block body bottom box button buttons cell col column container content form global group icon icons inner item items label left link links list main module more new news "
    "outer page panel post posts primary right row secondary section site slot stories story text thread title top unit user wrap wrapper".split()
)
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising adsense adbox sponsor sponsored promo".split())
COMMENT_WORDS = frozenset("comment comments commentlist commentform disqus replies".split())
HEADER_OK = frozenset("article post entry story".split())
CONTENT_WORDS = frozenset("article content post entry story main body text page blog".split())
#: A new one of these ends an open one of the same family.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table div section article main body html nav aside header footer form td blockquote".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe|svg)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|</?[a-zA-Z][^>]*+>|<[!?][^>]*+>""",
    re.S | re.I,
)
_attribute = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_words = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_digits = re.compile(r"\d+")


class Node:
    __slots__ = ("tag", "name", "parent", "pruned", "score", "container")

    def __init__(self, tag: str, name: str, parent: Node | None, pruned: bool):
        self.tag, self.name, self.parent, self.pruned = tag, name, parent, pruned
        self.score = 0.0
        self.container = tag in CONTAINERS

    @property
    def path(self) -> str:
        names, node = [], self
        while node is not None and node.tag != "html":
            names.append(node.name)
            node = node.parent
        return ">".join(reversed(names))


def _attributes(raw: str) -> dict[str, str]:
    if not raw or raw.isspace():
        return {}
    return {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _attribute.finditer(raw)}


def _is_pruned(tag: str, own: dict[str, str], parent: Node | None) -> bool:
    if tag in ("html", "body"):
        return False
    inside = parent
    while inside is not None and inside.tag not in ("article", "main"):
        inside = inside.parent
    if tag in PRUNED_TAGS and not (tag == "header" and inside is not None and inside.tag == "article"):
        return True
    if not own:
        return False
    if own.get("role", "").lower() in PRUNED_ROLES or "hidden" in own or own.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", own.get("style", "")):
        return True
    words: set[str] = set()
    hits: set[str] = set()
    for name in (own.get("class", "") + " " + own.get("id", "")).split():
        parts = {w.lower() for w in _words.findall(name)}
        words |= parts
        if parts <= PRUNED_WORDS | STRUCTURE_WORDS:
            hits |= parts & PRUNED_WORDS
    if tag in INLINE:
        return bool(hits & ADVERT_WORDS)
    if tag in TEXT_TAGS:
        return bool(hits & (ADVERT_WORDS | COMMENT_WORDS))
    if tag in ("main", "article"):
        return bool(hits & (COMMENT_WORDS | {"ad", "ads", "related", "reply"}))
    return bool(hits) and not (hits == {"header"} and (words & HEADER_OK or (inside is not None and inside.tag == "article")))


def _name(tag: str, own: dict[str, str]) -> str:
    classes = sorted({_digits.sub("0", c.lower()) for c in own.get("class", "").split()})[:3]
    return ".".join([tag, *classes]) + (f"#{_digits.sub('0', own['id'].lower())}" if own.get("id") else "")


def parse(source: str | None) -> list[tuple[str, Node, bool]]:
    """The text pieces outside pruned regions in page order: text, the element they stand in, in a link or not. None of them is a gap between blocks."""
    root = Node("html", "html", None, False)
    here, stack, links, out, at = root, [root], 0, [], 0
    source = source or ""

    def close(index: int) -> None:
        nonlocal here, links
        links -= sum(n.tag == "a" for n in stack[index:])
        del stack[index:]
        here = stack[-1]

    for m in _token.finditer(source):
        if m.start() > at and not here.pruned:
            out.append((source[at : m.start()], here, links > 0))
        at = m.end()
        if m[3] is None:
            continue
        tag, end = m[3].lower(), bool(m[2])
        block = tag not in INLINE
        if block and not here.pruned:
            out.append((" ", here, False))
        if tag in VOID or tag == "html":
            continue
        if end:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if not block and stack[i].tag not in INLINE:
                    break
            continue
        if tag in ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in STOPS:
                    break
        for i in range(len(stack) - 1, 0, -1) if tag in ENDS else ():
            if stack[i].tag in ENDS[tag]:
                close(i)
                break
            if stack[i].tag in STOPS:
                break
        if tag == "body" and any(n.tag == "head" for n in stack):
            close(1)
        raw = m[4]
        if not block and tag != "a" and (not raw or raw.isspace()):
            continue
        own = _attributes(raw)
        here = Node(tag, _name(tag, own), here, here.pruned or _is_pruned(tag, own, here))
        stack.append(here)
        links += tag == "a"
    if at < len(source) and not here.pruned:
        out.append((source[at:], here, links > 0))
    return out


def _container(node: Node | None) -> Node | None:
    while node is not None and not node.container:
        node = node.parent
    return node


def best_container(found: list[tuple[str, Node, bool]]) -> Node | None:
    """The container with the best score; an article (else a main element) around it is taken instead."""
    scored: dict[int, Node] = {}
    for text, node, linked in found:
        size = 0 if linked else len(text.strip())
        if not size:
            continue
        share, target = 1.0, _container(node)
        for _ in range(3):
            if target is None:
                break
            target.score += size * share
            scored[id(target)] = target
            share, target = share / 2, _container(target.parent)

    def worth(n: Node) -> float:
        words = {w.lower() for w in _words.findall(n.name)}
        return n.score * (1.5 if n.tag in ("article", "main") else 1.25 if words & CONTENT_WORDS and n.tag not in ("html", "body") else 1.0)

    best = max(scored.values(), key=worth, default=None)
    for tag in ("article", "main"):
        up = best
        while up is not None:
            if up.tag == tag:
                return up
            up = up.parent
    return best


def text_of(found: list[tuple[str, Node, bool]], paths: list[str]) -> str:
    """The text in the containers at the first of `paths` that the page has; else in its best one."""
    inside: dict[int, bool] = {}
    names: dict[int, str] = {}

    def path(n: Node) -> str:
        if id(n) not in names:
            names[id(n)] = n.path
        return names[id(n)]

    def within(node: Node | None, want) -> bool:
        seen = []
        while node is not None and id(node) not in inside:
            seen.append(node)
            if node.container and want(node):
                inside[id(node)] = True
                break
            node = node.parent
        value = node is not None and inside.get(id(node), False)
        for n in seen:
            inside[id(n)] = value
        return value

    def taken(want) -> str:
        inside.clear()
        return " ".join(html.unescape("".join(text for text, node, _ in found if within(node, want))).split())

    for p in paths or ():
        if text := taken(lambda n, p=p: path(n) == p):
            return text
    best = best_container(found)
    if best is None:
        return taken(lambda n: n.tag == "body") or " ".join(html.unescape("".join(t for t, _, _ in found)).split())
    return taken(lambda n: path(n) == path(best))


def candidates(found: list[tuple[str, Node, bool]]) -> set[str]:
    """The paths of all containers with text."""
    seen: set[int] = set()
    out = set()
    for text, node, _ in found:
        if not text or text.isspace():
            continue
        while node is not None and id(node) not in seen:
            seen.add(id(node))
            if node.container:
                out.add(node.path)
            node = node.parent
    return out


def host_of(url):
    return F.regexp_extract(F.lower(F.coalesce(url.cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def vote(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`host`, `path` and `n`, the votes of each path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [best_container(parse(x)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b.path if b else None for b in best], pa.string())], ["host", "path"])

    votes = pages.select(host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html")).mapInArrow(run, "host string, path string")
    return votes.filter(F.col("path").isNotNull()).groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"))


def _ranked_paths(rows: DataFrame, votes: DataFrame) -> DataFrame:
    """`host`, `key` and `paths`: the voted paths that each page (host, key, __html) has, by votes (ties: the shorter, then the first by name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(candidates(parse(x))) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.string()))], ["host", "key", "own"])

    own = rows.select("host", "key", "__html").mapInArrow(run, "host string, key string, own array<string>")
    own = own.select("host", "key", F.explode("own").alias("path")).distinct().withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
    dealt = votes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    met = own.join(dealt, ["host", "path", "salt"]).select("host", "key", F.struct(-F.col("n"), F.length("path").alias("length"), "path").alias("p"))
    return met.groupBy("host", "key").agg(F.transform(F.sort_array(F.collect_list("p")), lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """`id_col`, `url_col`, `text` and `n_chars` for each row of `pages`.

    White space of a text is single spaces, character references are decoded. A
    null or empty html, or one without text, gives an empty text. A null or odd
    url belongs to the host "". Rows stay as they are repeated; extra columns are
    ignored; an empty table gives no rows.
    """
    votes = stash(vote(pages, url_col, html_col), "votes")
    rows = pages.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{url_col}`").alias("__url"), F.col(f"`{html_col}`").cast("string").alias("__html"), host_of(F.col(f"`{url_col}`")).alias("host"))
    few = votes.count() <= broadcast_hosts * PATHS_A_HOST
    ranks: dict[str, dict[str, tuple]] = {}
    for r in votes.collect() if few else ():
        ranks.setdefault(r.host, {})[r.path] = (-r.n, len(r.path), r.path)
    shared = pages.sparkSession.sparkContext.broadcast(ranks)
    if few:
        rows = rows.select("__id", "__url", "__html", "host")
    else:
        rows = rows.withColumn("key", F.md5(F.coalesce("__html", F.lit("")).cast("binary")))
        rows = rows.join(_ranked_paths(rows, votes), ["host", "key"], "left").select("__id", "__url", "__html", "paths")

    def text(source: str | None, by) -> str:
        found = parse(source)
        if few:
            known = shared.value.get(by, {})
            by = sorted((p for p in candidates(found) if p in known), key=known.__getitem__)
        return text_of(found, by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text(x, by) for x, by in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    schema = T.StructType([*[T.StructField(c, pages.schema[c].dataType) for c in (id_col, url_col)], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(run, schema)


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
