"""Main text of web pages: page structure tells where the article is, a host's suffix array what else is boilerplate.

A page is read into blocks of text. Blocks inside menus, headers, footers, sidebars, notices, adverts, forms and reader
comments go, as do scripts and styles. If the page marks its article, the text is what is left inside of it. The token
streams of all that stands outside of marked articles are concatenated for each host and their suffixes sorted:
substrings of at least RUN tokens found on MIN_PAGES distinct pages are boilerplate. Where a page marks no article,
covered tokens go, and the unique runs stay.

Hosts of many pages are cut into shards of a bounded number, each with its own array; what a shard counts is summed over
all shards of a host, so what a shard saw on too few pages still meets the others of its kind.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

RUN, MIN_PAGES, SHARD_PAGES = 8, 3, 256
#: Pages parsed at once; hosts, and pages that repeat what their host has, that are broadcast at most.
SLICE, BROADCAST_ROWS = 512, 20_000
#: Elements by their role in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe textarea select title".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROP = set("nav aside footer form menu dialog head".split())
MAIN_ROLES, DROP_ROLES = {"main", "article"}, set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar note form".split())
DROP_NAMES = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?:ad|ads|adv|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|newsletter\w*|subscri\w*|signup|popup\w*|modal\w*|"
    r"comment\w*|disqus\w*|replies|reply|sidebar\w*|breadcrumb\w*|pagination|pager|menu\w*|nav|navbar\w*|navigation|topbar|"
    r"footer\w*|masthead|site-?header|page-?header)(?:$|[\s_-])",
    re.I,
)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)|<[!?/][^>]*(?:>|$)", re.S)
_IN_TAG = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _role(tag: str, attributes: str, in_main: bool) -> str:
    """'drop', 'main' or '' for an element."""
    if tag in DROP or (tag == "header" and not in_main):
        return "drop"
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    if found:
        role = found.get("role", "").lower()
        if role in DROP_ROLES:
            return "drop"
        names = f"{found.get('class', '')} {found.get('id', '')}"
        if tag not in ("body", "html", "main") and DROP_NAMES.search(names):
            return "drop"
        if role in MAIN_ROLES or found.get("itemprop") == "articleBody":
            return "main"
    return "main" if tag in ("article", "main") else ""


class _Tags:
    """Where a page's tags end, in time that grows with the page, whatever quotes it leaves open.

    A sign in a tag is looked up once for all tags that begin in the gap before it, and a quote at which no tag can go
    on, as none of its kind follows, fails all tags that come to it.
    """

    def __init__(self, page: str):
        self.page, self.last = page, {q: page.rfind(q) for q in "\"'"}
        self.gap, self.sign = (0, -1), -1
        self.failed: set[int] = set()

    def _next(self, at: int) -> int:
        """The first quote or > from a place on, or -1."""
        if not self.gap[0] <= at <= self.gap[1]:
            m = _IN_TAG.search(self.page, at)
            self.sign = m.start() if m else -1
            self.gap = (at, m.start() if m else len(self.page))
        return self.sign

    def end(self, at: int) -> int | None:
        """The place of the > that ends a tag, the page's end if nothing does, None if a quote stays open: not a tag."""
        seen = []
        while True:
            sign = self._next(at)
            if sign < 0:
                return len(self.page)
            quote = self.page[sign]
            if quote == ">":
                return sign
            seen.append(sign)
            if sign in self.failed or sign == self.last[quote]:
                self.failed.update(seen)
                return None
            at = self.page.find(quote, sign + 1) + 1


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(role, text) of the page's blocks in order; role: main, body or drop. Time grows with the page, however it is made."""
    page = page or ""
    tags = _Tags(page)
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    open_of: dict[str, int] = {}  # open elements by name
    open_blocks: list[int] = []  # places of open blocks on the stack
    drops = mains = 0

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append(("drop" if drops else "main" if mains else "body", joined))
            text.clear()

    def pop() -> None:
        nonlocal drops, mains
        tag, role = stack.pop()
        open_of[tag] -= 1
        if tag in BLOCK:
            open_blocks.pop()
        drops -= role == "drop"
        mains -= role == "main"

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at : m.start()])
        at = m.end()
        if not m[2]:  # a comment or a declaration
            continue
        stop = tags.end(m.end())
        if stop is None and m[1]:  # read like a comment
            at = (page.find(">", at) + 1) or end
            continue
        if stop is None:
            text.append("<")
            at = m.start() + 1
            continue
        attributes, at = page[m.end() : stop], stop + 1
        if stop == end:  # a tag that the page's end cuts off
            break
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            if open_of.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            if tag in ("textarea", "select", "title"):
                flush()
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = close.end() if close else end
            continue
        if tag == "br":
            text.append(" ")
        if tag in BLOCK:
            flush()
            if tag == "body":
                while stack:
                    pop()
            if open_blocks:  # a block ends an open paragraph, a list item the one before
                i = open_blocks[-1]
                t = stack[i][0]
                if t == "p" or (t == tag and tag in ("li", "dt", "dd", "tr", "td", "th")):
                    while len(stack) > i:
                        pop()
        if tag not in VOID and not attributes.rstrip().endswith("/"):
            role = _role(tag, attributes, mains > 0)
            role = "main" if role == "main" and not drops else "drop" if role == "drop" else ""
            if tag in BLOCK:
                open_blocks.append(len(stack))
            stack.append((tag, role))
            open_of[tag] = open_of.get(tag, 0) + 1
            drops += role == "drop"
            mains += role == "main"
    flush()
    return out


def stream(found: list[tuple[str, str]]) -> tuple[list[str], list[int]]:
    """Tokens outside of the article and, for each, its block, or -1 where structure drops it."""
    tokens, of = [], []
    for i, (role, text) in enumerate(found):
        if role != "main":
            words = text.split(" ")
            tokens.extend(words)
            of.extend([i if role == "body" else -1] * len(words))
    return tokens, of


def main_text(found: list[tuple[str, str]], covered: np.ndarray | None = None) -> str:
    """The article's blocks, or those outside of dropped parts without their covered tokens."""
    if any(role == "main" for role, _ in found):
        return "\n".join(text for role, text in found if role == "main")
    tokens, of = stream(found)
    rows: dict[int, list[str]] = {}
    for k, (token, i) in enumerate(zip(tokens, of, strict=True)):
        if i >= 0 and not (covered is not None and covered[k]):
            rows.setdefault(i, []).append(token)
    return "\n".join(" ".join(x) for x in rows.values())


def suffix_array(streams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The concatenation's suffixes in order, what each has in common with the one before it, its stream, its place there.

    Suffixes end with their stream. Ranks by 1, 2, 4, ... tokens sort them by prefix doubling until all differ; common
    prefixes are then measured by the same ranks, the longest step first.
    """
    lengths = np.array([len(x) for x in streams], np.int64)
    n = int(lengths.sum())
    if not n:
        return (np.zeros(0, np.int64),) * 4
    whole = np.concatenate(streams)
    of = np.repeat(np.arange(len(streams)), lengths)
    end = np.cumsum(lengths)[of]
    place, depth = np.arange(n), 1
    ranks = [np.unique(whole, return_inverse=True)[1].astype(np.int64) + 1]
    while depth < lengths.max() and ranks[-1].max() < n:
        there = place + depth
        later = np.where(there < end, ranks[-1][np.minimum(there, n - 1)], 0)  # nothing after a stream's end
        ranks.append(np.unique(ranks[-1] * (n + 1) + later, return_inverse=True)[1].astype(np.int64) + 1)
        depth *= 2
    order = np.lexsort((place, ranks[-1]))
    a, b, common = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
    for k in range(len(ranks) - 1, -1, -1):  # equal ranks by 2**k tokens: these are in common
        while True:
            inside = (a + (1 << k) <= end[order[:-1]]) & (b + (1 << k) <= end[order[1:]])
            same = inside & (ranks[k][np.minimum(a, n - 1)] == ranks[k][np.minimum(b, n - 1)])
            if not same.any():
                break
            step = same.astype(np.int64) << k
            a, b = a + step, b + step
            common[1:] += step
            if k < len(ranks) - 1:
                break  # at most once, but for the longest step
    begins = np.cumsum(lengths) - lengths
    return order, common, of[order], order - begins[of[order]]


def repeats(streams: list[np.ndarray], run: int = RUN, pages: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each substring of `run` tokens: the stream and place of one of them, and on how many distinct pages it stands.

    pages: each stream's page. Neighbours in the suffix array with as much in common are one substring.
    """
    order, common_, of, at = suffix_array(streams)
    lengths = np.array([len(x) for x in streams], np.int64)
    fits = at + run <= lengths[of] if len(order) else np.zeros(0, dtype=bool)
    if not fits.any():
        return (np.zeros(0, np.int64),) * 3
    group = np.cumsum(~(common_ >= run))[fits]
    of, at = of[fits], at[fits]
    names = np.unique(pages, return_inverse=True)[1] if pages is not None else np.arange(len(streams))
    _, first, group = np.unique(group, return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([group, names[of]]), axis=1)
    return of[first], at[first], np.bincount(pairs[0], minlength=len(first))


def covered_tokens(streams: list[np.ndarray], run: int = RUN, min_pages: int = MIN_PAGES, pages: list | None = None) -> list[np.ndarray]:
    """For each stream which tokens lie in substrings of `run` tokens or more that `min_pages` distinct pages hold."""
    at, place, n = repeats(streams, run, None if pages is None else np.asarray(pages))
    known = {windows(streams[s][p : p + run], run)[0] for s, p, k in zip(at.tolist(), place.tolist(), n.tolist(), strict=True) if k >= min_pages}
    return [cover(x, np.isin(windows(x, run), list(known)), run) for x in streams]


def cover(tokens: np.ndarray, hits: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in one of the stretches of `run` tokens that are hit."""
    edges = np.zeros(len(tokens) + 1, np.int64)
    at = np.flatnonzero(hits)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + run, -1)
    return np.cumsum(edges[:-1]) > 0


def windows(tokens: np.ndarray, run: int) -> np.ndarray:
    """A hash of each stretch of `run` tokens."""
    if len(tokens) < run:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(tokens.view(np.uint64), run)
    odd = np.random.default_rng(5).integers(1, 1 << 62, run, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (views * odd).sum(axis=1, dtype=np.uint64)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in tokens), np.uint64, len(tokens)).view(np.int64)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", url or "", flags=re.I).split("/")[0].split("?")[0].split("#")[0].lower()


_STREAM = "host string, key string, open boolean, tokens binary"


def _streams(batches):
    """Rows _STREAM of what stands outside of marked articles; open: whether the page marks none."""
    names = [f.split()[0] for f in _STREAM.split(", ")]
    for big in batches:
        for lo in range(0, big.num_rows, SLICE):
            batch = big.slice(lo, SLICE)
            rows = []
            for url, page, key in zip(*(batch.column(n).to_pylist() for n in ("_url", "_html", "_key")), strict=True):
                found = blocks(page)
                tokens, _ = stream(found)
                if len(tokens) >= RUN:
                    rows.append((host_of(url), key, not any(role == "main" for role, _ in found), _hashes(tokens).tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            types = [pa.string(), pa.string(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def boilerplate(streams: DataFrame, run: int = RUN, min_pages: int = MIN_PAGES, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """host, window: stretches of `run` tokens that a host has on `min_pages` distinct pages."""
    hosts = streams.groupBy(F.col("host").alias("_h")).agg(F.ceil(F.count("*") / shard_pages).alias("_shards"))
    few = hosts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    dealt = streams.join(F.broadcast(hosts) if few else hosts, F.col("host") == F.col("_h")).withColumn("_shard", F.pmod(F.xxhash64("key"), F.col("_shards"))).drop("_h")

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.frombuffer(t, np.int64) for t in pdf["tokens"]]
        pages = np.unique(pdf["key"].to_numpy().astype(str), return_inverse=True)[1]
        s, p, n = repeats(found, run, pages)
        if int(pdf["_shards"].iloc[0]) == 1:  # no other shard adds to these counts
            kept = n >= min_pages
            s, p, n = s[kept], p[kept], n[kept]
        hashes = [windows(found[i][j : j + run], run)[0] for i, j in zip(s.tolist(), p.tolist(), strict=True)]
        return pd.DataFrame({"host": pd.Series([pdf["host"].iloc[0]] * len(hashes), dtype=object), "window": np.array(hashes, np.int64), "pages": n})

    counted = dealt.groupBy("host", "_shard").applyInPandas(within, "host string, window long, pages long")
    # a page is in one shard, so the shards' pages add up
    return counted.groupBy("host", "window").agg(F.sum("pages").alias("_pages")).filter(F.col("_pages") >= min_pages).select("host", "window")


def _stretches(run: int):
    """Rows (key, host, start, window) of a page's stretches of `run` tokens."""

    def run_all(batches):
        for batch in batches:
            for host, key, tokens in zip(*(batch.column(n).to_pylist() for n in ("host", "key", "tokens")), strict=True):
                found = windows(np.frombuffer(tokens, np.int64), run)
                n = len(found)
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.string()), pa.array([host] * n, pa.string()), pa.array(np.arange(n, dtype=np.int32)), pa.array(found)], names=["key", "host", "start", "window"])

    return run_all


def _texts(names: list[str], run: int):
    """The columns in `names`, and the text of each page: of its article, or of what its host doesn't repeat."""

    def run_all(batches):
        for big in batches:
            for lo in range(0, big.num_rows, SLICE):
                batch = big.slice(lo, SLICE)
                texts = []
                for page, starts in zip(batch.column("_html").to_pylist(), batch.column("_starts").to_pylist(), strict=True):
                    found = blocks(page)
                    covered = None
                    if starts:
                        tokens = np.zeros(len(stream(found)[0]), np.int64)
                        hits = np.zeros(len(tokens), dtype=bool)
                        hits[starts] = True
                        covered = cover(tokens, hits, run)
                    texts.append(main_text(found, covered))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "_text"])

    return run_all


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), run: int = RUN, min_pages: int = MIN_PAGES, shard_pages: int = SHARD_PAGES) -> DataFrame:
    """The columns in `keep` and `text`, for every row.

    Null or empty html has no text and gives an empty one. Rows of equal url and html are one page to the host's array
    and have the same text; a null url is an empty one. Very long pages are read whole. An empty table gives an empty
    result.
    """
    own = [f"_k{i}" for i in range(len(keep))]  # so that no name in `keep` clashes
    key = F.sha2(F.concat_ws("\0", F.coalesce(F.col("url"), F.lit("")), F.coalesce(F.col("html"), F.lit(""))).cast("binary"), 256)
    src = pages.select(*(F.col(c).alias(k) for c, k in zip(keep, own, strict=True)), F.col("url").alias("_url"), F.col("html").alias("_html"), key.alias("_key"))
    schema = ", ".join([*(f"`{k}` {src.schema[k].dataType.simpleString()}" for k in own), "_text string"])
    with common.scratch(pages.sparkSession) as path:
        streams = common.written(src.select("_url", "_html", "_key").mapInArrow(_streams, _STREAM), f"{path}/streams")
        known = boilerplate(streams, run, min_pages, shard_pages)
        each = streams.filter("open").dropDuplicates(["key"]).mapInArrow(_stretches(run), "key string, host string, start int, window long")
        starts = common.cut(each.join(known, ["host", "window"]).groupBy(F.col("key").alias("_p")).agg(F.collect_list("start").alias("_starts")))
    few = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = src.join(F.broadcast(starts) if few else starts, F.col("_key") == F.col("_p"), "left").select(*own, "_html", "_starts")
    out = rows.mapInArrow(_texts(own, run), schema)
    return out.select(*(F.col(k).alias(c) for c, k in zip(keep, own, strict=True)), F.col("_text").alias("text"))
