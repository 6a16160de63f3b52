"""Main text of web pages: what a host repeats is found by a suffix array over the pages' token streams."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import bounded_batches, staged, table

#: Tokens (words and marks of blocks) in which two suffixes must agree, and window of which one suffix is sampled.
AGREE, WINDOW = 8, 4
#: Share of a block's words that repeats must cover, share of a page's words that must be its own (else it is a copy), pages of a run that fills a host.
COVERED, OWN, FILLS = 0.5, 0.2, 10
#: Keys of articles that a task holds at once when it looks for those on most of a host's pages.
HELD_KEYS = 2_000_000

#: Elements of HTML by their part in a page.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = set("head noscript template svg math canvas object audio video select datalist button".split())
CHROME = set("nav footer aside menu dialog".split())
SOFT = set("form header".split())
CONTENT = set("article main".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Words in classes and ids that name what isn't the article; the second list holds only outside it.
NAMES = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal newsletter subscribe subscription signup login nav navbar navigation menu breadcrumb breadcrumbs sidebar aside widget widgets related recommended share sharing social comment comments disqus respond footer pagination pager copyright toolbar skip".split())
SOFT_NAMES = set("header masthead topbar banner notice notices modal popup wrapper form".split())
COMMENTS = set("comment comments reply".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
#: Classes and ids that hold the article of pages without an element for it.
HOLDERS = set("article article-body article-content content entry entry-content main main-content page-content post post-body post-content story story-body".split())
#: What a start tag ends: an open element of the first kind, unless one of the second kind is nearer.
ENDED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']*+(?:"[^"]*+"|'[^']*+'))*+[^>"']*+|[^>]*+)>|!--|[!?][^>]*+>)""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NEGATED = re.compile(r"(?:has|with|no|is|without)[-_]", re.I)


class Block(NamedTuple):
    text: str
    mark: str
    #: content, chrome, holder or open
    part: str


class _Open(NamedTuple):
    tag: str
    mark: str
    #: what it makes of its text: hard (chrome anywhere), soft (chrome outside an article), content, holder
    kinds: tuple[str, ...]


@lru_cache(4096)
def _opened(tag: str, attributes: str, in_content: bool) -> _Open:
    given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    named = [n for n in f"{given.get('class', '')} {given.get('id', '')}".split()]
    words = {w.lower() for n in named if not _NEGATED.match(n) for w in _PARTS.findall(n)}
    if tag in ("html", "body", "main"):
        words = set()
    elif tag == "article":
        words &= COMMENTS
    role, hidden = given.get("role", "").lower(), "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    soft = not in_content and (tag in SOFT or bool(words & SOFT_NAMES - {"wrapper"}))
    hard = tag in SKIPPED | CHROME or bool(words & NAMES - (set() if in_content else SOFT_NAMES)) or role in ROLES or (hidden and tag != "body") or bool(words & COMMENTS) or (in_content and tag == "form")
    content = tag in CONTENT or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
    holder = bool({n.lower() for n in named} & HOLDERS)
    return _Open(tag, f"<{tag} {given.get('class', '')}>", tuple(k for k, v in (("hard", hard), ("soft", soft), ("content", content), ("holder", holder)) if v))


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page's text in order, white space as one space, character references decoded; never fails on broken markup.

    A block's part is ``content`` within an article or main element, ``chrome`` within elements that name themselves menus, footers,
    forms, notices, comments and the like or consist of links, ``holder`` within an element named as the article's, else ``open``.
    Scripts, styles and other raw texts give no block.
    """
    out: list[Block] = []
    stack: list[_Open] = []
    held = {"hard": 0, "soft": 0, "content": 0, "holder": 0}
    counts: dict[str, int] = {}
    pieces: list[str] = []
    linked = total = 0

    def text(raw: str) -> None:
        nonlocal linked, total
        if raw and not raw.isspace():
            if "&" in raw:
                raw = html.unescape(raw)
            total += len(raw)
            if counts.get("a"):
                linked += len(raw)
        if raw:
            pieces.append(raw)

    def end_block() -> None:
        nonlocal linked, total
        if total and (words := " ".join("".join(pieces).split())):
            chrome = held["hard"] or (held["soft"] and not held["content"])
            part = "chrome" if chrome else "content" if held["content"] else "chrome" if 3 * linked >= 2 * total else "holder" if held["holder"] else "open"
            out.append(Block(words, stack[-1].mark if stack else "<>", part))
        pieces.clear()
        linked = total = 0

    def pop() -> None:
        if stack[-1].kinds:
            end_block()
        gone = stack.pop()
        counts[gone.tag] -= 1
        for k in gone.kinds:
            held[k] -= 1

    def close(tag: str) -> None:
        if counts.get(tag):
            while stack[-1].tag != tag:
                pop()
            pop()

    at, size, last = 0, len(page), page.rfind(">") + 1  # no tag ends beyond, and none before begins in vain
    while at < size:
        m = _TAG.search(page, at, last)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0] == "<!--":
                end = page.find("-->", at - 2)
                at = size if end < 0 else max(at, end + 3)
        elif m[1]:
            if tag in BLOCKS:
                end_block()
            close(tag)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
        else:
            if tag in BLOCKS:
                end_block()
                if counts.get("p"):
                    close("p")
            if tag in ENDED:
                ended, bars = ENDED[tag]
                if any(counts.get(t) for t in ended):
                    near = next((o.tag for o in reversed(stack) if o.tag in ended | bars), None)
                    if near in ended:
                        close(near)
            if tag == "br":
                text(" ")
            elif tag not in VOID and not (m[3].endswith("/") and tag not in BLOCKS):
                now = _opened(tag, m[3], held["content"] > 0)
                if now.kinds and tag not in BLOCKS:
                    end_block()  # an inline advert isn't a part of its block
                stack.append(now)
                counts[tag] = counts.get(tag, 0) + 1
                for k in now.kinds:
                    held[k] += 1
    end_block()
    return out


_hashes: dict[str, int] = {}


def _hash(token: str) -> int:
    known = _hashes.get(token)
    if known is None:
        if len(_hashes) > 200_000:
            _hashes.clear()
        known = _hashes[token] = xxhash.xxh64_intdigest(token)
    return known


def sampled_suffixes(tokens: list[str], host: str, agree: int = AGREE, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of the sampled suffixes of a token stream: a key stands for the host and the suffix's first ``agree`` tokens.

    Sampled are the suffixes that begin with a block's mark, and of each ``window`` in a row the one of least key: equal
    stretches are sampled alike, so a run of agree + window - 1 tokens or more that two pages share has a suffix of equal key. The stream's end
    is padded, so its last suffixes count too.
    """
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    h = np.zeros(n + agree - 1, np.uint64)
    h[:n] = np.fromiter(map(_hash, tokens), np.uint64, n)
    key, by = np.zeros(n, np.uint64), np.uint64(0x9E3779B97F4A7C15)
    for k in range(agree):
        key = key * by + h[k : k + n]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xBF58476D1CE4E5B9)
    key ^= key >> np.uint64(32)
    chosen = np.fromiter((t[0] == "<" and len(t) > 1 for t in tokens), bool, n)
    if n >= window:
        views = np.lib.stride_tricks.sliding_window_view(key, window)
        chosen[np.arange(len(views)) + views.argmin(axis=1)] = True
    else:
        chosen[:] = True
    at = np.flatnonzero(chosen)
    seeded = (key[at] ^ np.uint64(_hash(host))) * np.uint64(0x94D049BB133111EB)
    return at.astype(np.int32), (seeded ^ (seeded >> np.uint64(31))).view(np.int64)


def _stream(blocks: list[Block]) -> tuple[list[str], list[int]]:
    """The tokens of all blocks, each after its mark, and where each block begins. Words can't begin like marks: they are set off."""
    tokens, starts = [], []
    for b in blocks:
        starts.append(len(tokens))
        tokens.append(b.mark)
        tokens += [f" {w}" for w in b.text.split(" ")]
    return tokens, starts


_BLOCK = pa.struct([("text", pa.string()), ("start", pa.int32()), ("chrome", pa.bool_())])
_PARSED = "page_id long, url string, host string, text string, blocks array<struct<text:string,start:int,chrome:boolean>>, places array<int>, keys array<long>, article long, own_keys array<long>"


def article_suffixes(texts: list[str], host: str) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Where each block of an article begins in its stream, and (places, keys) of the sampled suffixes.

    One of ``AGREE`` in a row is sampled, so that what lies between two that a run covers is covered too."""
    tokens, starts = _stream([Block(t, "<>", "content") for t in texts])
    return starts, *sampled_suffixes(tokens, host, window=AGREE)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with an article: its text, its suffixes, and those of what stands around it. Other pages: all blocks and suffixes."""
    for b in batches:
        hosts, texts, kept, places, keys, articles, own_keys = b.column(2).to_pylist(), [], [], [], [], [], []
        for host, page in zip(hosts, b.column(3)):
            blocks = blocks_of(page.as_py())
            for part in ("content", "holder", None):
                own = [x.text for x in blocks if x.part == part]
                if own:
                    break
            rest = [x for x in blocks if x.part != part] if own else blocks
            tokens, starts = _stream(rest)
            at, key = sampled_suffixes(tokens, host)
            texts.append("\n\n".join(own) if own else None if blocks else "")
            kept.append([] if own else [{"text": x.text, "start": s, "chrome": x.part == "chrome"} for x, s in zip(rest, starts)])
            places.append([] if own else at)
            keys.append(key if not own else np.unique(key))
            articles.append(xxhash.xxh64_intdigest(texts[-1]) - 2**63 if own else None)
            own_keys.append(np.unique(article_suffixes(own, host)[2]) if own else [])
        columns = [pa.array(texts, pa.string()), pa.array(kept, pa.list_(_BLOCK)), pa.array(places, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
        columns += [pa.array(articles, pa.int64()), pa.array(own_keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *columns], names=["page_id", "url", "host", "text", "blocks", "places", "keys", "article", "own_keys"])


def _common(batches: Iterator[pa.RecordBatch], held: int | None = None) -> Iterator[pa.RecordBatch]:
    """(host, key) of keys on more than half of a host's pages among those a task holds at once.

    A key on more than half of all its host's pages is so in at least one such set of pages, whatever the sets are."""
    pages: dict[str, list[np.ndarray]] = {}
    size, most = 0, HELD_KEYS if held is None else held

    def rows() -> Iterator[pa.RecordBatch]:
        for host, lists in pages.items():
            values, counts = np.unique(np.concatenate(lists), return_counts=True)
            common = values[2 * counts > len(lists)]
            if len(common):
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(common), pa.string()), pa.array(common, pa.int64())], names=["host", "key"])
        pages.clear()

    for b in batches:
        for host, keys in zip(b.column(0).to_pylist(), b.column(1)):
            own = keys.values.to_numpy()
            pages.setdefault(host, []).append(own)
            size += len(own)
            if size >= most:
                yield from rows()
                size = 0
    yield from rows()


def own_blocks(texts: list[str], host: str, fills: set[int]) -> list[str]:
    """The blocks of an article that runs on most of the host's articles (``fills``) don't cover.

    Where these are most of its words, the article is one of many alike, and is kept whole."""
    starts, places, keys = article_suffixes(texts, host)
    sizes = [t.count(" ") + 1 for t in texts]
    hit = np.zeros(starts[-1] + 1 + sizes[-1] + AGREE, bool)
    for at, key in zip(places.tolist(), keys.tolist()):
        if key in fills:
            hit[at : at + AGREE] = True
    gone = [hit[s + 1 : s + 1 + n].sum() >= COVERED * n for s, n in zip(starts, sizes)]
    return texts if 2 * sum(n for n, g in zip(sizes, gone) if g) > sum(sizes) else [t for t, g in zip(texts, gone) if not g]


def _cleared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = ["\n\n".join(own_blocks(text.split("\n\n"), host, set(hits))) for host, text, hits in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def unique_runs(blocks: list[dict], places: list[int], keys: list[int], spread: dict[int, int], pages: int) -> str:
    """The text of the blocks that repeats don't cover. ``spread``: pages of the host that have a key, where more than one; ``pages``: those of the host.

    A page nearly all of whose words are covered is a copy of others: for it, only runs on most pages of its host count.
    """
    shown = [b for b in blocks if not b["chrome"]]
    sizes = [b["text"].count(" ") + 1 for b in shown]
    if not shown:
        return ""

    def shares(least: int) -> list[int]:
        hit = np.zeros(max(b["start"] for b in blocks) + max(b["text"].count(" ") for b in blocks) + 3 + AGREE, bool)
        for at, key in zip(places, keys):
            if spread.get(key, 1) >= least:
                hit[at : at + AGREE] = True
        return [int(hit[b["start"] + 1 : b["start"] + 1 + n].sum()) for b, n in zip(shown, sizes)]

    hits = shares(2)
    if sum(hits) > (1 - OWN) * sum(sizes):
        hits = shares(max(FILLS, pages // 2 + 1))
    return "\n\n".join(b["text"] for b, n, hit in zip(shown, sizes, hits) if hit < COVERED * n)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = b.to_pylist()
        texts = [unique_runs(r["blocks"], r["places"], r["keys"], {x["key"]: x["pages"] for x in r["spread"] or []}, r["host_pages"]) for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the article's blocks in page order, joined by two line feeds.

    Each page is a stream of words and block marks. The suffixes of all streams of a host are compared in their first ``AGREE``
    tokens, and stretches that other pages of the host have too are covered. Articles share passages, so of what an article or main
    element holds only runs count that are on more than half of the host's pages with an article and in more than half of its
    different articles, of which there are ``FILLS`` or more; blocks of which they cover half the words go. What stands around it goes, covered or not. On pages without one, blocks of
    which half the words are covered are boilerplate, as are those that name themselves so or consist of links, and the rest is kept.

    Hosts are read from urls as they stand before the path, lower-cased; null urls share the host ''. Null html is empty; a page without text
    has ''. Null and repeated ids keep their rows; each row is a page. Other columns are ignored; an empty table gives no rows.

    What shuffles are keys, a number for each sampled suffix, counted within tasks first; the lists of a page are its own. Keys of
    articles leave a task only where they are on most of a host's pages there, and are then counted exactly. Texts are
    written once; pages without an article's element meet the repeated keys, articles the few that fill their host.
    """
    bounded_batches(pages.sparkSession)
    address = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(address, r"^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    parsed = staged(src.mapInArrow(_parsed, _PARSED).withColumn("row", F.monotonically_increasing_id()), "html-pages")
    each = parsed.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("pages"))
    repeated = staged(each.where("pages > 1"), "html-repeats")
    undecided = parsed.where("text is null")
    spread = undecided.select("row", F.explode(F.array_distinct("keys")).alias("key")).join(repeated, "key").groupBy("row").agg(F.collect_list(F.struct("key", "pages")).alias("spread"))
    hosts = parsed.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    known = undecided.join(hosts, "host").join(spread, "row", "left").select("page_id", "url", "blocks", "places", "keys", "spread", "host_pages")

    articles = parsed.where("article is not null")
    sizes = articles.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("article").alias("n_articles")).where(F.col("n_articles") >= FILLS)
    common = staged(articles.select("host", "own_keys").mapInArrow(_common, "host string, key long").distinct().join(sizes, "host"), "html-common")
    met = articles.select("article", F.explode("own_keys").alias("key")).join(common, "key").groupBy("host", "key", "n", "n_articles")
    met = met.agg(F.count(F.lit(1)).alias("on"), F.count_distinct("article").alias("in")).where("2 * on > n and 2 * in > n_articles")
    fills = staged(met.groupBy("host").agg(F.collect_list("key").alias("fills")), "html-fills")
    held = parsed.where("text is not null").join(fills, "host", "left")
    hits = F.array_intersect("own_keys", "fills")
    as_they_are = held.where(F.coalesce(F.size(hits), F.lit(0)) <= 0).select("page_id", "url", "text")
    cleared = held.where(F.size(hits) > 0).select("page_id", "url", "host", "text", hits.alias("hits")).mapInArrow(_cleared, "page_id long, url string, text string")
    texts = as_they_are.unionByName(cleared).unionByName(known.mapInArrow(_decided, "page_id long, url string, text string"))
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
