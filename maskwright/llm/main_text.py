"""Main text of web pages: markup where it names the article, and a host suffix array where it does not.

``read_page`` cuts a page into blocks and finds the regions that markup names: the article (``article``, ``articleBody``,
``post-content`` and the like) and what is never part of one (menus, headers, footers, sidebars, adverts, notices, forms,
comments). What is left, such as every block of a page that is made of plain ``div``s, is open.

The token streams of a host's pages, without the named articles, are concatenated and sorted into a suffix array to a
depth of DEPTH tokens (prefix doubling); suffixes that share that many tokens are the places of one long repeated
substring, and the number of distinct pages there tells how far it is spread. An open block stays if it is spread no
further than its page's body, which is unique unless the page is a copy; what is spread further is boilerplate. Each page
takes its blocks' counts from the array; in named regions markup has the last word, since articles do share passages and
a host with few pages repeats nothing.

A host's pages are dealt to groups of about GROUP_TOKENS tokens, each with a suffix array of its own, so a host that holds
a third of all pages is spread out. The counts of a host's groups are added up by the hash of the shared prefix (a row for
each group and prefix), which makes them those of one array over the whole host.

Cases: null and empty html give empty text; equal rows give equal results; pages without url count as one host; pages that
end in the middle of a tag, comment or script lose only that; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DEPTH = 8
GROUP_TOKENS = 1 << 16
#: So many hosts of several groups may be broadcast.
FEW_HOSTS = 100_000
#: Of a page's open words, the share that its body holds at least.
BODY_SHARE = 0.25
#: A block of which more is links is a list of links.
LINK_SHARE = 0.5

_ATTRIBUTES = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_TOKEN = re.compile(
    rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(script|style|textarea|title|noscript|iframe|noembed|noframes|xmp|template|svg|math|object|canvas)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][^\s/>]*)({_ATTRIBUTES})>|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(?<![^\s/"'])(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?(?=[\s/>"']|\Z)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split())
#: Within a block, text of such an element with a name of ``_WORDS`` is left out and the block goes on.
_INLINE = frozenset("a abbr b cite del em font i ins label mark s small span strong sub sup time u".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an element's start closes, up to the nearest of the bounds.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_NEVER = frozenset("nav footer aside form menu button select fieldset dialog head search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead topbar banner footer copyright sidebar aside widget related recommended teaser ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments disqus respond replies discussion pagination pager search".split()
)
_ARTICLE = ("articlebody", "article body", "article content", "article text", "post content", "post body", "post text", "entry content", "story body", "story content", "body text", "article", "post", "entry", "story", "main content", "page content", "content")


@dataclass(slots=True)
class Node:
    tag: str
    name: str  # the tag, or main and article where a role says so
    up: int
    label: str
    parts: list[list[str]]
    never: bool
    heads: bool
    words: int = 0


@dataclass(slots=True)
class Block:
    node: int
    text: str
    words: int
    linked: int
    heading: bool


@dataclass(slots=True)
class Page:
    nodes: list[Node] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    #: For each block: main, never or open.
    roles: list[str] = field(default_factory=list)


def _node(name: str, up: int, attributes: str) -> Node:
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = f"{found.get('class', '')} {found.get('id', '')} {found.get('itemprop', '')}".split()
    parts = [[p.lower() for p in _PARTS.findall(n)] for n in names]
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I) is not None
    named = any(p in _WORDS and not (k and n[k - 1] in ("with", "has", "no", "without", "non")) for n in parts for k, p in enumerate(n))
    heads = name == "header" or any("header" in n for n in parts)
    role = found.get("role", "").lower()
    never = hidden or name in _NEVER or role in _ROLES or (named and name not in ("html", "body", "main"))
    return Node(name, role if role in ("main", "article") else name, up, f"{name} {found.get('class', '')}", parts, never, heads)


def read_page(html: str | None) -> Page:
    """The blocks of a page with their roles."""
    page = Page([Node("", "", -1, "", [], False, False)])
    nodes, blocks = page.nodes, page.blocks
    stack, text, linked, links, heading, muted = [0], [], 0, 0, 0, 0

    def close() -> None:
        nonlocal linked
        if text:
            said = " ".join(unescape("".join(text)).split())
            if said:
                n = said.count(" ") + 1
                blocks.append(Block(_owner(nodes, stack), said, n, min(linked, n), heading > 0))
            text.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal links, heading, muted
        while len(stack) > to:
            node = nodes[stack.pop()]
            links -= node.tag == "a"
            heading -= node.tag in _HEADINGS
            muted -= node.never and node.tag in _INLINE

    for m in _TOKEN.finditer(html or ""):
        name = m[3] or m[6]
        if name is None:
            if (m[0][0] != "<" or m[0] == "<") and not muted:
                text.append(m[0])
                linked += links and len(m[0].split())
            continue
        if m[6] and m[0][-1] != ">":
            break  # the page ends within a tag
        name, ends = name.lower(), m[2] or m[5]
        block = name in _BLOCK
        if block:
            close()
        elif name in ("br", "td", "th", "img"):
            text.append(" ")
        if ends:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]].tag == name:
                    pop(k)
                    break
                if not block and nodes[stack[k]].tag in _BLOCK:
                    break  # the end of an inline element does not leave its block
        elif name not in _VOID:
            closes, bounds = _CLOSES.get(name, (frozenset(), _BLOCK - {"p"}))
            for k in range(len(stack) - 1, 0, -1):
                inner = nodes[stack[k]].tag
                if inner in closes or (inner == "p" and block):
                    pop(k)
                if inner in closes or inner in bounds:
                    break
            nodes.append(_node(name, stack[-1], m[4] or m[7]))
            stack.append(len(nodes) - 1)
            links += name == "a"
            heading += name in _HEADINGS
            muted += nodes[-1].never and name in _INLINE
    close()
    _assign_roles(page)
    return page


def _owner(nodes: list[Node], stack: list[int]) -> int:
    """The node that a block of text counts to: the innermost block element."""
    return next((k for k in reversed(stack) if nodes[k].tag in _BLOCK), stack[0])


def _assign_roles(page: Page) -> None:
    nodes = page.nodes
    for b in page.blocks:
        nodes[b.node].words += b.words
    for k in range(len(nodes) - 1, 0, -1):
        nodes[nodes[k].up].words += nodes[k].words
    total = nodes[0].words
    never = [False] * len(nodes)  # in such a region, as far as the way down goes
    for k, n in enumerate(nodes[1:], 1):
        whole = n.name == "form" and n.words > 0.8 * total
        never[k] = never[n.up] or (n.never and not whole) or n.heads and n.name == "header"
    mains = _containers(page, never, total)
    holds = set()  # nodes with a container inside: no class of theirs makes them boilerplate
    for k in mains:
        while k >= 0:
            holds.add(k)
            k = nodes[k].up
    region = {}
    for k, n in enumerate(nodes):
        above = region.get(n.up, "open")
        if k in mains:
            region[k] = mains[k]
        elif k in holds:
            region[k] = "open"
        elif above == "never":
            region[k] = "never"
        elif n.heads and above in ("main", "inner"):
            region[k] = "heads"  # of a header within the article its headings stay
        elif (n.never and not (n.name == "form" and n.words > 0.8 * total)) or n.name == "header":
            region[k] = "never"
        else:
            region[k] = above
    only = bool(mains)
    for b in page.blocks:
        r = region[b.node]
        page.roles.append("main" if r == "main" or (r == "heads" and b.heading) else "open" if r == "inner" or (r == "open" and not only) else "never")


def _containers(page: Page, never: list[bool], total: int) -> dict[int, str]:
    """Nodes that hold the article: all outermost ``article`` elements; else the fullest of the first name of ``_ARTICLE``
    that has a quarter of the words, as main; else the fullest ``main`` element, as inner, whose blocks are open."""
    nodes, found = page.nodes, {}
    for k, n in enumerate(nodes):
        if n.name == "article" and not never[k] and n.words:
            up = n.up
            while up >= 0 and up not in found:
                up = nodes[up].up
            if up < 0:
                found[k] = "main"
    if found:
        return found
    free = [k for k, n in enumerate(nodes) if n.words and n.name not in ("html", "body") and not never[k]]
    for name in _ARTICLE:
        named = [k for k in free if any("".join(p) == name or " ".join(p) == name for p in nodes[k].parts) and nodes[k].words >= total / 4]
        if named:
            return {max(named, key=lambda k: (nodes[k].words, k)): "main"}
    mains = [k for k in free if nodes[k].name == "main"]
    return {max(mains, key=lambda k: (nodes[k].words, -k)): "inner"} if mains else {}


# ---- token streams and suffix arrays ----


def stream(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, blocks): for each block outside the article, a token for its element and one for each word; 0 stands where
    the article is and equals nothing."""
    tokens, owner = [], []
    for k, (b, role) in enumerate(zip(page.blocks, page.roles)):
        if role == "main":
            if tokens and tokens[-1]:
                tokens.append(0)
                owner.append(-1)
            continue
        said = [page.nodes[b.node].label, *b.text.split(" ")]
        tokens += [zlib.crc32(w.encode("utf-8", "surrogatepass")) or 1 for w in said]
        owner += [k] * len(said)
    return np.array(tokens, np.uint32), np.array(owner, np.int64)


def suffix_ranks(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The rank of each suffix by its first ``depth`` tokens, a power of two: suffixes of one rank share them. -1 where a 0,
    or the end, stands among them."""
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    good = tokens != 0
    step = 1
    while step < depth:
        ahead = np.append(rank[step:], np.zeros(min(step, n), np.int64))
        rank = np.unique(rank * (n + 1) + ahead, return_inverse=True)[1].astype(np.int64)
        good &= np.append(good[step:], np.zeros(min(step, n), bool))
        step *= 2
    return np.where(good, rank, -1)


def page_counts(ranks: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each rank, the number of distinct pages with a suffix of it."""
    pairs = np.unique(np.stack([ranks, page])[:, ranks >= 0], axis=1)
    return np.bincount(pairs[0], minlength=int(ranks.max(initial=-1)) + 1)


def spread(ranks: np.ndarray, counts: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """For each token, the most pages that share a substring of ``depth`` tokens around it; 1 where none is shared."""
    own = np.where(ranks >= 0, counts[ranks], 1) if len(counts) else np.ones(len(ranks), np.int64)
    out = own.copy()
    for k in range(1, min(depth, len(own))):
        out[k:] = np.maximum(out[k:], own[:-k])
    return out


def _prefix_hashes(tokens: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """A 64-bit hash of the ``depth`` tokens from each place on."""
    h = np.zeros(len(tokens), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(depth):
            ahead = np.zeros(len(tokens), np.uint64)
            ahead[: max(len(tokens) - k, 0)] = tokens[k:]
            h = C.mix(h * np.uint64(0x9E3779B97F4A7C15) + ahead + np.uint64(k + 1))
    return h.view(np.int64)


@dataclass(slots=True)
class _Group:
    """The streams of some pages of a host, each once, end to end."""

    keys: np.ndarray
    tokens: np.ndarray
    page: np.ndarray
    ranks: np.ndarray

    @classmethod
    def of(cls, table: pa.Table) -> _Group:
        keys, first = np.unique(table["key"].to_numpy(), return_index=True)
        streams = [np.frombuffer(table["tokens"][int(k)].as_py(), np.uint32) for k in first]
        gap = np.zeros(1, np.uint32)
        tokens = np.concatenate([x for s in streams for x in (s, gap)]) if streams else gap[:0]
        page = np.repeat(np.arange(len(streams)), [len(s) + 1 for s in streams])
        return cls(keys, tokens, page, suffix_ranks(tokens))


def _shared_prefixes(table: pa.Table) -> pa.Table:
    """(host, part, prefix, pages) of a group: one row for each of its prefixes."""
    g = _Group.of(table)
    ranks, at = np.unique(g.ranks, return_index=True)
    at = at[ranks >= 0]
    counts = page_counts(g.ranks, g.page)[g.ranks[at]]
    n = len(at)
    return pa.table({"host": pa.array([table["host"][0].as_py()] * n, pa.string()), "part": pa.array(np.full(n, table["part"][0].as_py()), pa.int64()), "prefix": _prefix_hashes(g.tokens)[at], "pages": counts})


def _spread_of(table: pa.Table, totals: pa.Table) -> pa.Table:
    """(key, spread) of a group's pages. totals: (prefix, total) of prefixes that other groups of the host share."""
    if not table.num_rows:
        return pa.table({"key": pa.array([], pa.int64()), "spread": pa.array([], pa.list_(pa.int64()))})
    g = _Group.of(table)
    counts = page_counts(g.ranks, g.page)
    if totals.num_rows:
        known = totals["prefix"].to_numpy()
        order = known.argsort()
        known, total = known[order], totals["total"].to_numpy()[order]
        ranks, at = np.unique(g.ranks, return_index=True)
        mine = _prefix_hashes(g.tokens)[at[ranks >= 0]]
        k = np.minimum(np.searchsorted(known, mine), len(known) - 1)
        counts[ranks[ranks >= 0]] = np.where(known[k] == mine, total[k], counts[ranks[ranks >= 0]])
    out = spread(g.ranks, counts)
    ends = np.cumsum(np.bincount(g.page, minlength=len(g.keys)))
    return pa.table({"key": g.keys, "spread": pa.array([x[:-1] for x in np.split(out, ends[:-1])], pa.list_(pa.int64()))})


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def token_streams(pages: DataFrame) -> DataFrame:
    """(host, key, n, tokens) of pages (key, host, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [stream(read_page(h.as_py()))[0] for h in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), pa.array([len(s) for s in streams], pa.int64()), pa.array([s.tobytes() for s in streams], pa.binary())], names=["host", "key", "n", "tokens"])

    return pages.select("key", "host", "html").mapInArrow(run, "host string, key long, n long, tokens binary")


def page_spreads(streams: DataFrame) -> DataFrame:
    """(key, spread): for each page and token of its stream, the number of the host's pages that share it. streams is a
    written table, as it is read more than once."""
    parts = C.written(streams.groupBy("host").agg(F.ceil(F.sum("n") / GROUP_TOKENS).alias("parts")).where("parts > 1"), "large-hosts")
    if parts.count() <= FEW_HOSTS:  # else a join by host, whose tasks each hold a host's streams in passing
        parts = F.broadcast(parts)
    dealt = streams.join(parts, "host", "left").withColumn("part", F.coalesce(F.pmod("key", "parts"), F.lit(0).cast("long"))).select("host", "part", F.col("parts").isNotNull().alias("split"), "key", "tokens")
    prefixes = dealt.where("split").groupBy("host", "part").applyInArrow(_shared_prefixes, "host string, part long, prefix long, pages long")
    totals = prefixes.groupBy("host", "prefix").agg(F.sum("pages").alias("total"), F.count("*").alias("groups")).where("groups > 1").drop("groups")
    back = prefixes.select("host", "part", "prefix").join(totals, ["host", "prefix"])
    return dealt.groupBy("host", "part").cogroup(back.groupBy("host", "part")).applyInArrow(_spread_of, "key long, spread array<long>")


# ---- decisions ----


def kept_blocks(page: Page, spread_of: np.ndarray | None) -> list[bool]:
    """Which blocks are main text. spread_of: for each token of the page's stream, how many pages share it."""
    keep = [r == "main" for r in page.roles]
    _, owner = stream(page)
    count = {}
    if spread_of is not None and len(spread_of) == len(owner):
        for k in range(len(page.blocks)):
            if page.roles[k] == "open":
                mine = np.sort(spread_of[owner == k])
                count[k] = int(mine[len(mine) // 5])  # four in five tokens are spread as far
    candidates = [k for k, b in enumerate(page.blocks) if page.roles[k] == "open" and b.linked <= LINK_SHARE * b.words]
    total, held = sum(page.blocks[k].words for k in candidates), 0
    body = 1
    for c in sorted({count.get(k, 1) for k in candidates}):
        held += sum(page.blocks[k].words for k in candidates if count.get(k, 1) == c)
        body = c
        if held >= BODY_SHARE * total:
            break
    for k in candidates:
        keep[k] = count.get(k, 1) <= body
    return keep


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_blocks, n_dropped, n_repeated): the main text, its code points, the page's blocks, those
    that went, and its words outside the article that other pages of the host repeat."""
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(url, html).alias("key"), host_of(F.col(url)).alias("host"))
    met = rows.select("id", "url", "html", "key").join(page_spreads(C.written(token_streams(rows), "streams")), "key", "left").select("id", "url", "html", "spread")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, s in zip(batch.column("html"), batch.column("spread")):
                page = read_page(h.as_py())
                shared = s.values.to_numpy() if s.is_valid else None
                keep = kept_blocks(page, shared)
                text = "\n\n".join(b.text for b, ok in zip(page.blocks, keep) if ok)
                out.append((text, len(text), len(keep), len(keep) - sum(keep), int((shared > 1).sum()) if shared is not None else 0))
            columns = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(list(columns[0]), pa.string()), *(pa.array(list(c), pa.int64()) for c in columns[1:])], names=[key, url, "text", "n_chars", "n_blocks", "n_dropped", "n_repeated"])

    kind = dict(pages.dtypes)[key]
    return met.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string, n_chars long, n_blocks long, n_dropped long, n_repeated long")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(C.table(spark, sf_dir, "pages"))
