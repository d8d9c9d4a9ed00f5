"""Main text of web pages, with boilerplate found by host suffix arrays and held against the marks of the page.

A page is cut into blocks by its block elements. Blocks lie in the article
(article or main elements, or elements whose class, id or role says so),
in boilerplate (menus, headers, footers, sidebars, notices, adverts, forms,
comments by element, class, id or role), or in neither. Scripts, styles, markup
comments and the head are never text.

Every page meets the suffix arrays of its host: the token streams of all blocks
outside articles of the host's distinct pages are concatenated, their suffixes
are ordered in full, and for each the longest prefix is measured that a page of
another copy group has too. Blocks that lie whole in such repeats of LEAST_RUN
tokens or more are boilerplate, and so are stretches of LEAST_RUN or more
inside a block that neither article nor boilerplate marks; unique runs of any
length stay. (A repeat often reaches from one block some words into the next,
where sentences begin alike; these words stay.)

What repeats leave is then held against the marks. Blocks that the page marks
as boilerplate go, though no other page has them, and in a page with an article
all that lies outside it. Text that is marked as article is kept whole, for
articles may share passages, so it is in no stream. What a class name only
suggests repeats alone decide: blocks of an article under a doubtful name
(DOUBTFUL), and articles inside an element whose class names boilerplate, where
the page has no other article (a form around an article is no mark at all);
these go whole or not at all.

Pages are shuffled once, with their articles, by host. A host of more than
SHARD_TOKENS tokens, taken at BYTES each, is dealt into shards by a hash
of its pages, so that no task holds an unbounded host. What repeats across its
shards is found by digests (128 bits of host and words) of all windows of
LEAST_RUN tokens, for which the pages of such hosts are parsed once more: those
that two copy groups share go to the shards that hold them. A token lies in a
repeat of LEAST_RUN or more if and only if it lies in such a window, so the
result does not depend on the shards.

Markup is read in one pass whose work grows with the page, however broken: a
tag without end is text, an open comment or script takes the rest, and from a
tag on whose quotes never close, quotes no longer hide the end of a tag.

Cases: null html is empty; a page that marks nothing and has no unique tokens has empty text;
null urls share the empty host; equal pages are distinct rows, and copies of a
page are no evidence against each other; very long pages are parsed whole; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import keep_nothing, written

LEAST_RUN = 8
SHARD_TOKENS = 1 << 19
#: Bytes of a page that count as a token outside articles: tokens have two or more, with the space, but most are tags and articles. Only the size of shards depends on it.
BYTES = 4
#: Bytes that a page without any counts as.
ROW = 64
#: Characters of markup whose blocks are handed on at once.
PORTION = 4 << 20

#: A tag up to the end of its name, and a whole one in which quotes hide what they hold.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
QUOTED = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
NAMED = re.compile(r"""(?:class|id|role|itemprop|aria-label)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
SPACE = re.compile(r"\s+")
#: Character references by number: leading zeros, and numbers beyond every character.
ZEROS, HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An opening element that ends an open one of the same group, if no other block is open inside that.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements that closing tags of inline elements do not reach across.
BARRIERS = {"article", "main", "table"}
DROPPED = {"head", "title", "nav", "footer", "aside", "form", "button", "select", "svg", "math", "object", "audio", "video", "canvas", "dialog", "menu", "map", "label", "fieldset"}
BAD = set(
    "ad ads advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification "
    "alert sidebar side-bar rail widget widgets menu nav navbar navigation topnav breadcrumb breadcrumbs pagination pager header masthead topbar footer bottom "
    "comment comments commentlist respond replies disqus disqus_thread reader-comments share sharing social related recommended newsletter subscribe subscription signup "
    "login popup modal overlay skip toolbar tags copyright legal search contentinfo complementary".split()
)
#: Readers' comments are no article, whatever elements they use. Names that inside an article only suggest boilerplate. Starts of names that tell of another element.
COMMENTS = set("comment comments commentlist respond replies disqus disqus_thread reader-comments".split())
DOUBTFUL = set("legal copyright search tags bottom rail skip toolbar".split())
ABOUT = {"has", "no", "not", "with", "without", "is", "js", "hide"}
GOOD = set("article articlebody article-body article-content post-content post-body entry-content main maincontent main-content story story-body".split())
OPEN, ARTICLE, BOILERPLATE, WRAPPED, DOUBT = range(5)
#: What an element makes of all inside it.
NONE, HARD, SOFT, WEAK = range(4)


def _words(attributes: str) -> set[str]:
    """The names of an element and their parts; names that tell of another element (has-sidebar) are left out."""
    found = " ".join(a or b or c for a, b, c in NAMED.findall(attributes)).lower().split()
    parts = [(w, re.split(r"[-_]+", w)) for w in found]
    return {x for w, p in parts if len(p) == 1 or p[0] not in ABOUT for x in (w, *p)}


def _mark(name: str, attributes: str, inside: bool) -> int:
    """HARD: boilerplate, whatever it holds. SOFT: boilerplate but for articles in it. WEAK: in doubt, inside an article."""
    if name in ("form", "fieldset"):
        return HARD if inside else SOFT
    if name in DROPPED or name == "header" and not inside:
        return HARD
    if not attributes or "=" not in attributes or name in ("html", "body", "article", "main", "header"):
        return NONE
    words = _words(attributes) & BAD
    if not words:
        return NONE
    if words & COMMENTS or inside and words - DOUBTFUL:
        return HARD
    return WEAK if inside else SOFT


def _good(name: str, attributes: str) -> bool:
    if name in ("article", "main"):
        return True
    if name not in ("div", "section", "td") or not attributes:
        return False
    return any((a or b or c).lower() in GOOD for a, b, c in NAMED.findall(attributes))


def unescape(text: str) -> str:
    return entities.unescape(HUGE.sub("�", ZEROS.sub("&#", text))) if "&" in text else text


class _Elements:
    """The open elements, with the places of each name, so that none is searched for."""

    def __init__(self) -> None:
        self.open: list[tuple[str, int, bool]] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []
        self.barriers: list[int] = []
        self.marks = [0, 0, 0, 0]
        self.wraps = self.good = 0  # forms are the only soft elements that do not count as wraps

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def push(self, name: str, mark: int, good: bool) -> None:
        at = len(self.open)
        self.open.append((name, mark, good))
        self.places[name].append(at)
        if name in BLOCK:
            self.blocks.append(at)
        if name in BARRIERS:
            self.barriers.append(at)
        self._count(name, mark, good, 1)

    def _count(self, name: str, mark: int, good: bool, by: int) -> None:
        self.marks[mark] += by
        self.wraps += by * (mark == SOFT and name not in ("form", "fieldset"))
        self.good += by * good

    def place(self) -> int:
        if self.marks[HARD]:
            return BOILERPLATE
        if self.marks[SOFT] and not self.good:
            return BOILERPLATE
        if self.wraps:
            return WRAPPED
        if self.marks[WEAK]:
            return DOUBT
        return ARTICLE if self.good else OPEN

    def close(self, at: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.open) > at:
            name, mark, good = self.open.pop()
            self.places[name].pop()
            for places in (self.blocks, self.barriers):
                if places and places[-1] == len(self.open):
                    places.pop()
            self._count(name, mark, good, -1)

    def ended_by(self, name: str) -> int:
        """The place of the open element that this closing tag ends, or -1."""
        at = self.last(name)
        return -1 if name not in BLOCK and self.barriers and self.barriers[-1] > at else at

    def displaced_by(self, name: str) -> int:
        """The place of the open element that this opening tag ends without a closing tag, or -1."""
        if name == "p":
            return self.last("p")
        if name in ENDS:
            nearest = max(self.blocks[-1] if self.blocks else -1, self.last("select") if name == "option" else -1)
            return nearest if nearest >= 0 and self.open[nearest][0] in ENDS[name] else -1
        at = self.last("p") if name in BLOCK else -1
        return at if at >= len(self.open) - 3 else -1


def blocks(page: str) -> list[tuple[int, str]]:
    """The page's blocks in order as (place, text)."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    elements = _Elements()
    place, at, quotes, last = OPEN, 0, True, page.rfind(">")

    def flush() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(map(unescape, parts))).strip()
            if text:
                out.append((place, text))
            parts.clear()

    while at < len(page):
        start = page.find("<", at)
        if start > last and not page.startswith("<!--", start) or start < 0:
            parts.append(page[at:])
            break
        if start > at:
            parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[start + 1] in "!?":
            at = page.find(">", start) + 1
            continue
        if quotes and (tag := QUOTED.match(page, start)):
            closing, name, attributes = tag.groups()
            at = tag.end()
        elif tag := TAG.match(page, start):
            closing, name = tag.groups()
            at, quotes = page.find(">", tag.end()) + 1, False
            attributes = page[tag.end() : at - 1]
        else:
            parts.append("<")
            at = start + 1
            continue
        name = name.lower()
        if name in BLOCK:
            flush()
        elif name == "br":
            parts.append(" ")
        if closing:
            ended = elements.ended_by(name)
            if ended >= 0:
                if any(mark or good for _, mark, good in elements.open[ended:]):
                    flush()
                elements.close(ended)
        elif name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif name not in VOID and not attributes.endswith("/"):
            displaced = elements.displaced_by(name)
            if displaced >= 0:
                elements.close(displaced)
            mark, good = _mark(name, attributes, elements.good > 0), _good(name, attributes)
            if mark or good:
                flush()
            elements.push(name, mark, good)
        place = elements.place()
    flush()
    return out


def suffix_array(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the order of their suffixes, by prefix doubling, and the common prefix of each with the one before, at full length."""
    n = len(stream)
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    ranks, order = [rank.astype(np.int32)], np.argsort(rank, kind="stable")
    while n and rank.max() < n - 1:
        width = 1 << (len(ranks) - 1)
        after = np.full(n, -1, dtype=np.int64)
        after[: max(n - width, 0)] = rank[width:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        ranks.append(rank.astype(np.int32))
    common = np.zeros(n, dtype=np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), dtype=bool)
        same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        step = np.where(same, 1 << k, 0)
        common[1:] += step
        a, b = a + step, b + step
    return order, common


def _shared(common: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each entry of the array the longest prefix that an entry before it, of another owner, has too.

    Common prefixes shrink with the distance in the array, so the nearest
    other owner has the longest: the least of all from there on. A drop larger
    than any prefix starts the running minimum anew where the owner changes.
    """
    run = np.cumsum(np.concatenate([[False], owner[1:] != owner[:-1]]))
    drop = run * (len(common) + 1)
    return np.minimum.accumulate(common - drop) + drop


def covered(pages: list[list[str]], copies: list[int]) -> list[np.ndarray]:
    """For each page's tokens, which of them lie in a run of LEAST_RUN or more that a page of another copy group has too."""
    numbers: dict[str, int] = {}
    streams, owners = [], []
    for k, page in enumerate(pages):
        streams.append(np.array([numbers.setdefault(t, len(numbers)) for t in page] + [0], dtype=np.int64))
        owners.append(np.full(len(page) + 1, copies[k], dtype=np.int64))
    if not streams:
        return []
    ends = np.cumsum([len(s) for s in streams]) - 1
    stream, owner = np.concatenate(streams), np.concatenate(owners)
    stream[ends] = len(numbers) + np.arange(len(ends))  # each page ends with a token of its own
    order, common = suffix_array(stream)
    own = owner[order]
    before = _shared(common, own)
    after = _shared(np.concatenate([[0], common[:0:-1]]), own[::-1])[::-1]
    length = np.maximum(before, after)
    long = length >= LEAST_RUN
    marks = np.bincount(order[long], minlength=len(stream) + 1) - np.bincount(order[long] + length[long], minlength=len(stream) + 1)
    cover = np.cumsum(marks)[: len(stream)] > 0
    return [cover[a:b] for a, b in zip([0, *(ends[:-1] + 1).tolist()], ends.tolist(), strict=True)]


def unique_runs(words: list[str], cover: np.ndarray) -> list[str]:
    """The words of a block without what is covered: the whole block, or stretches of LEAST_RUN words or more."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], cover, [False]]).astype(np.int8))).tolist()
    left, at = [], 0
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a >= min(LEAST_RUN, len(words)):
            left += words[at:a]
            at = b
    return left + words[at:]


#: main is the article, compressed as it is shuffled; places and outside hold the blocks outside articles and those in doubt, before how many blocks of the article precede each.
PARSED = "page_id long, url string, host string, shard long, main binary, places array<int>, outside array<string>, before array<int>, copy binary"
PARSED_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary()]
WINDOWS = "host string, shard long, copy long, digest binary"
DECIDED = "page_id long, url string, text string, n_covered long, n_named long"
DECIDED_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _page(markup: str) -> tuple[list[str], list[int], list[str], list[int], bytes]:
    """The blocks of the article, and what PARSED says of the page: places, outside, before and copy."""
    found = blocks(markup)
    main = [t for p, t in found if p == ARTICLE]
    marked = bool(main) or any(p == DOUBT for p, _ in found)
    places, outside, before, seen = [], [], [], 0
    for p, t in found:
        if p == ARTICLE:
            seen += 1
            continue
        # In a page that has an article what lies outside, in whatever wrapper, is no text.
        places.append(BOILERPLATE if marked and p != DOUBT else p)
        outside.append(t)
        before.append(seen)
    copy = hashlib.blake2b(repr((main, places, outside, before)).encode("utf-8", "surrogatepass"), digest_size=16).digest()
    return main, places, outside, before, copy


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keep_nothing()
    for batch in batches:
        rows: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            page_id, url, host, shard, markup = (column[i].as_py() for column in batch.columns)
            main, *rest = _page(markup)
            rows.append((page_id, url, host, shard, zlib.compress("\n".join(main).encode(), 1), *rest))
            size += len(markup)
            if size >= PORTION or i == batch.num_rows - 1:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), PARSED_TYPES, strict=True)], _names(PARSED))
                rows, size = [], 0


def _tokens(outside: list[str]) -> list[str]:
    return [t for text in outside for t in text.split(" ")]


def _digests(host: str, tokens: list[str]) -> list[bytes]:
    """The digest of each window of LEAST_RUN tokens."""
    windows = (" ".join(tokens[i : i + LEAST_RUN]) for i in range(len(tokens) - LEAST_RUN + 1))
    return [hashlib.blake2b(f"{host}\n{w}".encode(), digest_size=16).digest() for w in windows]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct windows of each page, in bounded batches."""
    keep_nothing()
    for batch in batches:
        for i in range(batch.num_rows):
            host, shard, markup = (column[i].as_py() for column in batch.columns)
            _, _, outside, _, copy = _page(markup)
            found = list(dict.fromkeys(_digests(host, _tokens(outside))))
            owner = int.from_bytes(copy[:8], "little", signed=True)
            for low in range(0, len(found), 1 << 16):
                part = found[low : low + (1 << 16)]
                n = len(part)
                columns = [pa.array([host] * n, type=pa.string()), pa.array([shard] * n, type=pa.int64()), pa.array([owner] * n, type=pa.int64()), pa.array(part, type=pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, _names(WINDOWS))


def _fate(page: dict, cover: np.ndarray) -> tuple[str, int, int]:
    """The text that repeats leave and marks allow, the tokens that repeat, and those that marks alone drop."""
    text = zlib.decompress(page["main"]).decode()
    main = text.split("\n") if text else []  # blocks are not empty and hold no line feed
    kept, at, put, named = [], 0, 0, 0
    for place, block, before in zip(page["places"], page["outside"], page["before"], strict=True):
        words = block.split(" ")
        own = cover[at : at + len(words)]
        at += len(words)
        left = unique_runs(words, own) if place == OPEN else [] if own.all() else words
        if place == BOILERPLATE:
            named += int((~own).sum())
            left = []
        if left:
            kept += [*main[put:before], " ".join(left)]
            put = before
    kept += main[put:]
    return "\n".join(kept), int(cover.sum()), named


def _decide(group: pa.Table, repeats: pa.Table) -> pa.Table:
    """The text of each page of a shard, from the suffix array of the shard's distinct pages and what other shards repeat."""
    rows = group.to_pylist()
    distinct = {r["copy"]: r for r in rows}
    tokens = [_tokens(r["outside"]) for r in distinct.values()]
    repeated = set(repeats["digest"].to_pylist())
    fates = {}
    for (copy, r), page, cover in zip(distinct.items(), tokens, covered(tokens, list(range(len(tokens)))), strict=True):
        for i, digest in enumerate(_digests(r["host"], page) if repeated else []):
            if digest in repeated:
                cover[i : i + LEAST_RUN] = True
        fates[copy] = _fate(r, cover)
    columns = list(zip(*[(r["page_id"], r["url"], *fates[r["copy"]]) for r in rows], strict=True)) or [[]] * len(DECIDED_TYPES)
    return pa.table({c: pa.array(v, type=t) for c, v, t in zip(_names(DECIDED), columns, DECIDED_TYPES, strict=True)})


def _decide_whole(group: pa.Table) -> pa.Table:
    """Of a host that is one shard."""
    return _decide(group, pa.table({"digest": pa.array([], type=pa.binary())}))


def _repeats(dealt: DataFrame) -> DataFrame:
    """The windows that two copy groups of a host share, for each shard that holds them."""
    windows = dealt.select("host", "shard", "html").mapInArrow(_windows, WINDOWS)
    held = windows.groupBy("digest").agg(F.first("host").alias("host"), F.min("copy").alias("low"), F.max("copy").alias("high"), F.collect_set("shard").alias("shards"))
    return held.where("low != high").select("host", F.explode("shards").alias("shard"), "digest")


def _dealt(rows: DataFrame, large: DataFrame, how: str) -> DataFrame:
    """Pages with their shard. Each large host has over SHARD_TOKENS * BYTES bytes, so there are few."""
    shard = F.pmod(F.xxhash64("page_id", "url", "html"), F.coalesce("shards", F.lit(1))).alias("shard")
    return rows.join(F.broadcast(large), "host", how).select("page_id", "url", "host", shard, "html")


def main_text(pages: DataFrame) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars; n_covered counts tokens outside articles that repeats cover (by_repeats: any), n_named those that marks alone drop."""
    host = F.coalesce(F.lower(F.regexp_extract(pages["url"].cast("string"), r"^[^:]*://([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), host.alias("host"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html") + F.coalesce(F.octet_length("url"), F.lit(0)) + F.lit(ROW)
    sizes = rows.groupBy("host").agg(F.ceil(F.sum(size.cast("long")) / (SHARD_TOKENS * BYTES)).cast("long").alias("shards"))
    large = written(sizes.where("shards > 1"), "html-hosts")
    groups = _dealt(rows, large, "left").mapInArrow(_parse, PARSED).groupBy("host", "shard")
    if large.isEmpty():
        found = groups.applyInArrow(_decide_whole, DECIDED)
    else:
        found = groups.cogroup(_repeats(_dealt(rows, large, "inner")).groupBy("host", "shard")).applyInArrow(_decide, DECIDED)
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), (F.col("n_covered") > 0).alias("by_repeats"), "n_covered", "n_named")
