"""Operator 3: main text of web pages, from page structure and host suffix arrays."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_ids, may_broadcast, settle
from .shingles import mix

#: Tokens from which a repeated run counts, the distinct pages it takes, and the pages whose streams one suffix array spans.
RUN, PAGES, SHARD = 8, 2, 256

# Elements by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_CHROME_TAGS = frozenset("nav footer aside form script style noscript template svg button select textarea iframe object dialog menu head title canvas audio video map math datalist".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output picture q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_CHROME_WORDS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs masthead footer sidebar aside widget widgets ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup signin login register search searchbox share sharing social related recommended "
    "recommendations pagination pager toolbar copyright legal disclaimer skip hidden teaser outbrain taboola".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies discussion responses".split())
_HEADER_WORDS = frozenset("header head topbar".split())
_MAIN_WORDS = frozenset("article content post entry story main maincontent articlebody postbody".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_SCOPE = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|([^<]++|<)""", re.S)
_CUT = re.compile(r"/?[a-zA-Z][^>]*\Z")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORDS = re.compile(r"[a-z0-9]+")

#: What a block belongs to; a quote is a blockquote in a likely part.
QUOTE, MAIN, LIKELY, UNSURE, CHROME = 4, 3, 2, 1, 0


def _role(tag: str, attrs: str, above: int, hard: bool, in_header: bool) -> tuple[int, bool, bool]:
    """(part, whether nothing inside can change it, whether inside a header) of an element in a part."""
    a = {}
    if attrs and not attrs.isspace():
        for name, x, y, z in _ATTR.findall(attrs):
            a.setdefault(name.lower(), x or y or z)
    words = set(_WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}".lower())) if a else set()
    if hard:
        return CHROME, True, in_header
    if tag in _CHROME_TAGS or words & _COMMENT_WORDS or a.get("role", "").lower() in _ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        if tag not in ("html", "body"):
            return CHROME, True, in_header
    if tag in ("article", "main") or a.get("role", "").lower() in ("main", "article") or a.get("itemprop", "").lower() == "articlebody":
        return (CHROME, True, in_header) if words & {"ad", "ads", "advert", "promo", "related", "teaser"} else (MAIN, False, False)
    if tag in ("html", "body"):
        return UNSURE, False, False
    if tag == "header" or words & _HEADER_WORDS and tag not in ("h1", "h2", "h3", "h4", "h5", "h6"):
        return above, False, True
    if words & _CHROME_WORDS:
        return CHROME, False, in_header
    if above < LIKELY and above != CHROME and words & _MAIN_WORDS:
        return LIKELY, False, in_header
    if above == LIKELY and tag == "blockquote":
        return QUOTE, False, in_header
    return above, False, in_header


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """(part, text) of a page's non-empty blocks in order; references decoded, white space as single spaces."""
    out: list[tuple[int, str]] = []
    if not page:
        return out
    stack: list[tuple[str, int, bool, bool]] = []
    part, hard, header = UNSURE, False, False
    run: list[str] = []
    run_part = UNSURE

    def flush() -> None:
        if run:
            text = " ".join("".join(run).split())
            if text:
                out.append((run_part, text))
            run.clear()

    def pop(to: int) -> None:
        nonlocal part, hard, header
        del stack[to:]
        _, part, hard, header = stack[-1] if stack else ("", UNSURE, False, False)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        at = m.end()
        text, tag = m[4], m[2]
        if text is not None:
            if text == "<" and _CUT.match(page, at):  # a tag that never ends: the rest is markup
                break
            here = CHROME if header and not (part == MAIN and any(t[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for t in stack)) else part
            if here != run_part:
                flush()
                run_part = here
            run.append(html.unescape(text) if "&" in text else text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            if tag == "br":
                run.append(" ")
            else:
                flush()
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop(i)
                    break
            continue
        if tag in _VOID:
            continue
        if tag in _CLOSES_P:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p":
                    pop(i)
                    break
                if stack[i][0] not in _INLINE:
                    break
        if tag in _SCOPE:
            names, stop = _SCOPE[tag]
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names.split():
                    pop(i)
                    break
                if stack[i][0] in stop:
                    break
        if tag in _RAW:
            close = re.compile(f"</{re.escape(tag)}", re.I).search(page, at)
            at = close.start() if close else end
            if close:
                at = (page.find(">", at) + 1) or end
            continue
        part, hard, header = _role(tag, m[3], part, hard, header)
        stack.append((tag, part, hard, header))
        if m[3].endswith("/") and tag not in _INLINE and tag in ("svg", "path"):
            pop(len(stack) - 1)
    flush()
    return out


def suffix_array(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of a sequence in order, and the tokens that each shares with the one before it.

    Ranks by the first 1, 2, 4 ... tokens are refined until all differ; common prefixes are read
    off the same ranks, from the longest down. The last token must occur nowhere else.
    """
    n = len(text)
    levels = [np.unique(text, return_inverse=True)[1].astype(np.int32)]
    while int(levels[-1].max(initial=-1)) + 1 < n:
        rank, step = levels[-1].astype(np.int64), 1 << (len(levels) - 1)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        levels.append(np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int32))
    order = np.argsort(levels[-1], kind="stable")
    common = np.zeros(n, np.int64)
    at, before = order[1:].copy(), order[:-1].copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero((at < n) & (before < n))
        same = inside[levels[k][at[inside]] == levels[k][before[inside]]]
        for x in (at, before):
            x[same] += 1 << k
        common[same + 1] += 1 << k
    return order, common


def repeated(streams: list[np.ndarray], pages: list[int], run: int = RUN, least: int = PAGES) -> list[np.ndarray]:
    """Which tokens of each stream lie in a substring of `run` or more tokens that `least` distinct pages share; pages: equal numbers are one page.

    The streams are concatenated with a separator of its own after each. Neighbours of the
    suffix array that share `run` tokens or more form an interval; what lies in an interval
    with suffixes of `least` pages is covered.
    """
    sizes = [len(s) for s in streams]
    n = sum(sizes) + len(streams)
    if not n:
        return [np.zeros(0, bool) for _ in streams]
    top = max((int(s.max()) for s in streams if len(s)), default=0) + 1
    text = np.concatenate([np.append(s, top + i) for i, s in enumerate(streams)]).astype(np.int64)
    owner = np.repeat(np.asarray(pages, np.int64), np.asarray(sizes) + 1)
    order, common = suffix_array(text)
    interval = np.cumsum(common < run) - 1
    by_page = np.lexsort((owner[order], interval))
    i, o = interval[by_page], owner[order][by_page]
    fresh = np.concatenate(([True], (i[1:] != i[:-1]) | (o[1:] != o[:-1])))
    shared = np.bincount(i, fresh)[interval] >= least
    edge = np.zeros(n + run + 1, np.int64)
    np.add.at(edge, order[shared], 1)
    np.add.at(edge, order[shared] + run, -1)
    covered = np.cumsum(edge)[:n] > 0
    ends = np.cumsum(np.asarray(sizes) + 1)
    return [covered[e - s - 1 : e - 1] for s, e in zip(sizes, ends, strict=True)]


def _choose(parts: list[int]) -> int:
    """The part that holds the page's text."""
    return MAIN if MAIN in parts else LIKELY if LIKELY in parts or QUOTE in parts else UNSURE


def _whole_runs(covered: np.ndarray, run: int) -> np.ndarray:
    """covered without pieces shorter than run that only reach into a block from the next one."""
    if covered.all():
        return covered
    out = covered.copy()
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        if b - a < run:
            out[a:b] = False
    return out


def stream_of(parts: list[int], texts: list[str]) -> list[str]:
    """The tokens of a page that may be boilerplate, a line end after each block."""
    return [w for p, t in zip(parts, texts, strict=True) if p != MAIN for w in (*t.split(" "), "\n")]


def fingerprints(words: list[str], run: int, known: dict[str, int]) -> np.ndarray:
    """64-bit fingerprints of a stream's windows of run tokens in order; known keeps token hashes."""
    n = len(words) - run + 1
    if n <= 0:
        return np.empty(0, np.int64)
    for w in set(words) - known.keys():
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for j in range(run):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    return mix(out).view(np.int64)


def extract_shard(pages: pd.DataFrame, run: int = RUN, least: int = PAGES, shared: np.ndarray | None = None) -> pd.DataFrame:
    """text and n_repeated for pages (parts, texts) of one shard of a host; shared: fingerprints of windows that the whole host repeats."""
    ids: dict[str, int] = {}
    streams, keys, seen, found = [], [], {}, []
    hashes: dict[str, int] = {}
    for parts, texts in zip(pages["parts"], pages["texts"], strict=True):
        words = stream_of(parts, texts)
        streams.append(np.array([ids.setdefault(w, len(ids)) for w in words], np.int64))
        keys.append(seen.setdefault(streams[-1].tobytes(), len(seen)))
        if shared is not None and len(shared):
            found.append(np.flatnonzero(np.isin(fingerprints(words, run, hashes), shared)))
    covers = repeated(streams, keys, run, least)
    for cover, starts in zip(covers, found):
        for j in range(run):
            cover[starts + j] = True
    out, counts = [], []
    for parts, texts, covered in zip(pages["parts"], pages["texts"], covers, strict=True):
        chosen = _choose(list(parts))
        if chosen == MAIN:
            out.append(" ".join(t for p, t in zip(parts, texts, strict=True) if p == MAIN))
        elif chosen == LIKELY:
            whole, kept, at = [], [], 0
            for p, t in zip(parts, texts, strict=True):
                size = t.count(" ") + 1
                if p in (LIKELY, QUOTE):
                    whole.append(t)
                    if p == QUOTE or not covered[at : at + size].all():
                        kept.append(t)
                at += size + 1
            out.append(" ".join(kept or whole))
        else:
            kept, at = [], 0
            for p, t in zip(parts, texts, strict=True):
                words = t.split(" ")
                if p == UNSURE:
                    kept += [w for w, gone in zip(words, _whole_runs(covered[at : at + len(words)], run), strict=True) if not gone]
                at += len(words) + 1
            out.append(" ".join(kept))
        counts.append(int(covered.sum()))
    return pd.DataFrame({"text": out, "n_repeated": counts})


def extract_text(pages: DataFrame, run: int = RUN, least: int = PAGES, shard: int = SHARD) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_repeated.

    Blocks are read from the markup and given a part: main (article, main), likely main (by
    class or id), chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments,
    hidden elements) or unsure. The token streams outside the main part of all pages of a host
    go into a suffix array; runs of `run` or more tokens that `least` distinct pages share are
    boilerplate. text is the main part, else the likely one without its repeated blocks, else
    what of the unsure part is unique. As articles quote, text of the main part is never dropped
    for being repeated, and of the likely part only blocks that repeated runs cover whole:
    blockquotes and runs inside a block with other text stay, and all stays if nothing else
    would be left. n_repeated counts the tokens outside the main part that repeated runs cover.

    A host of more than `shard` pages is dealt out by a hash of the page in shards of about that
    size, each with a suffix array of its own; windows that pages of different shards share are
    found by fingerprints counted over the whole host, so that shards do not change the result. Null and empty html give an empty text; a null
    url is a host of its own; rows may repeat (equal pages count as one for repetition).
    Unclosed and stray tags, cut comments and very long pages are read whole. Other columns
    are ignored.
    """
    host = F.coalesce(F.lower(F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    base = pages.select("page_id", "url", "html", host.alias("host"))
    sizes = base.groupBy("host").agg(F.ceil(F.count("*") / shard).cast("long").alias("shards"))
    big = settle(sizes.where("shards > 1"), "hosts")
    n_big = big.limit(1).count()
    if may_broadcast(big):
        big = F.broadcast(big)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.iloc[lo : lo + 256]
                found = [blocks_of(h) for h in part["html"]]
                yield pd.DataFrame(
                    {"page_id": part["page_id"].array, "url": part["url"].array, "host": part["host"].array, "parts": [[p for p, _ in f] for f in found], "texts": [[t for _, t in f] for f in found]}
                )

    def windows(batches: Iterator[pd.DataFrame], by: str, most: int, chunk: int = 1 << 19) -> Iterator[pd.DataFrame]:
        """Distinct (host, fp, by) of pages, of each (host, fp) in a chunk `most` at most (0: all)."""

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"host": np.repeat(np.array(hosts, object), [len(f) for f in fps]), "fp": np.concatenate(fps), by: np.repeat(np.array(keys, np.int64), [len(f) for f in fps])}).drop_duplicates()
            return out[out.groupby(["host", "fp"]).cumcount() < most] if most else out

        hosts, fps, keys, size, hashes = [], [], [], 0, {}
        for batch in batches:
            for at, (host, page) in enumerate(zip(batch["host"], batch["html"], strict=True)):
                found = blocks_of(page)
                words = stream_of([p for p, _ in found], [t for _, t in found])
                fp = np.unique(fingerprints(words, run, hashes))
                if not len(fp):
                    continue
                hosts.append(host)
                fps.append(fp)
                keys.append(int(batch["shard"].iat[at]) if by == "shard" else xxhash.xxh3_64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) - (1 << 63))
                size += len(fp)
                if size >= chunk:
                    yield flush()
                    hosts, fps, keys, size, hashes = [], [], [], 0, {}
        if size:
            yield flush()

    # equal streams are one page; `least` pages of a chunk are enough to know that a window has as many
    dealt = base.join(big, "host").withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), "shards")).select("host", "html", "shard")
    if n_big:
        pairs = dealt.mapInPandas(lambda x: windows(x, "page", least), "host string, fp long, page long")
        common = settle(pairs.groupBy("host", "fp").agg(F.count_distinct("page").alias("n")).where(F.col("n") >= least).select("host", "fp"), "windows")
        cross = keep_ids(dealt.mapInPandas(lambda x: windows(x, "shard", 0), "host string, fp long, shard long"), common, ["host", "fp"]).select("host", "shard", "fp").distinct()
    else:
        cross = pages.sparkSession.createDataFrame([], "host string, shard long, fp long")

    schema = "page_id long, url string, host string, parts array<int>, texts array<string>"
    parsed = base.mapInPandas(parse, schema).join(big, "host", "left")
    parsed = parsed.withColumn("shard", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("shards", F.lit(1)))).drop("shards")

    def extract(group: pd.DataFrame, shared: pd.DataFrame) -> pd.DataFrame:
        got = extract_shard(group, run, least, shared["fp"].to_numpy(np.int64))
        return pd.DataFrame({"page_id": group["page_id"].array, "url": group["url"].array, "text": got["text"].array, "n_repeated": got["n_repeated"].array})

    out = parsed.groupBy("host", "shard").cogroup(cross.groupBy("host", "shard")).applyInPandas(extract, "page_id long, url string, text string, n_repeated long")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_repeated")
