"""Main text of HTML pages: page structure first, then a suffix array over each host's undecided text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import materialise, slices, small_batches
from murmur.llm._words import rolling, utf8, within, words_of

#: Tokens of a repeated run, and tokens of a host that one suffix array holds.
RUN, HOST_TOKENS = 16, 2_000_000
_ONE, _TWO = 0x9FB21C651E98DF25, 0xD1B54A32D192ED03

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style title textarea iframe noframes xmp noembed".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img input".split())
_IMPLIED = {"p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
_SKIPPED = frozenset("head script style title noscript template nav footer aside form button select textarea iframe object svg canvas audio video dialog menu map".split())
_SKIPPED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar menu nav navbar "
    "navigation breadcrumb breadcrumbs footer comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe signup login search pagination pager widget masthead".split()
)
_SKIPPED_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies teaser related".split())
_SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())


#: Names that boxes have besides those words, and what is no part of an article inside one.
_SKIPPED_NAMES = frozenset("site-header page-header site-footer page-footer main-menu main-nav site-nav main-navigation site-navigation left-sidebar right-sidebar widget-area".split())
_INSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments commentlist disqus respond reply replies popup modal overlay share sharing social newsletter subscribe signup breadcrumb breadcrumbs pagination pager sidebar navbar adsbygoogle".split())
_INSIDE_NAMES = frozenset("related related-posts related-articles related-stories related-links related-content related-topics related-news related-reading recommended promo promotion teaser teasers".split())
_ADVERTS = frozenset("ad ads advert adverts advertisement advertising sponsored adsbygoogle".split())


def _kind(tag: str, attributes: str, in_main: bool) -> str | int | None:
    """skip, main or neither for an element; 1 or 2 if it is skipped unless it encloses an article or a main
    element (1), or a main element (2).

    A word counts as a whole class name or id or as its whole leading part. Inside an article only what can't be
    the article's goes: reader comments, adverts, share bars, boxes of other articles by their whole names, and cards of
    other articles; of paragraphs and inline elements adverts alone. A header inside an article is the article's own.
    """
    if tag in _SKIPPED:
        return 1 if tag == "form" else "skip"
    found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
    if tag in ("body", "html"):
        return None
    names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    words = {*names, *(re.split(r"[^a-z0-9]+", n)[0] for n in names)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return "skip"
    if tag == "article" and (words & _SKIPPED_ARTICLES or in_main and words & {"card", "cards"}):
        return "skip"
    if tag in ("article", "main") or found.get("role") == "main" or found.get("itemprop") == "articleBody":
        return "main"
    if in_main:
        named = bool(words & _ADVERTS if tag == "p" or tag in _INLINE else words & _INSIDE_WORDS or _INSIDE_NAMES.intersection(names))
    else:
        named = tag == "header" or bool(words & (_SKIPPED_WORDS | _SKIPPED_NAMES | {"header"}))
    if named or found.get("role") in _SKIPPED_ROLES:
        return 2 if words & _SKIPPED_ARTICLES else 1
    return None


def _enclosing(html: str) -> dict[int, int]:
    """Where elements start that enclose an article (1) or a main element (2), and which of the two."""
    out: dict[int, int] = {}
    _walk(html, out)
    return out


def blocks(html: str) -> tuple[list[str], list[str]]:
    """(blocks inside article or main elements, other blocks) of a page, in page order, without what is never
    content: scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and comments. A box that
    encloses the article or main element isn't skipped, whatever its name."""
    return _walk(html, None)


def _walk(html: str, probed: dict[int, int] | None) -> tuple[list[str], list[str]]:
    """``blocks``; with ``probed``, boxes are not skipped and what encloses an article is noted there."""
    main: list[str] = []
    other: list[str] = []
    held: list[str] = []
    stack: list[tuple[str, str | None, int]] = []
    open_tags: Counter[str] = Counter()
    blocks_at: list[int] = []  # where in the stack its elements lie that aren't inline
    enclosing: dict[int, int] | None = None
    skips = mains = at = 0
    last = html.rfind(">") + 1  # no tag ends behind it

    def flush() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                (main if mains else other).append(text)
            held.clear()

    def pop_to(size: int) -> None:
        """Close elements until so many are open."""
        nonlocal skips, mains
        while len(stack) > size:
            tag, kind, _ = stack[-1]
            if tag not in _INLINE:
                flush()
                blocks_at.pop()
            stack.pop()
            open_tags[tag] -= 1
            skips -= kind == "skip"
            mains -= kind == "main"

    def close(tag: str) -> None:
        """Close the innermost element of that name and all within it, if one is open."""
        if open_tags[tag]:
            n = len(stack) - 1
            while stack[n][0] != tag:
                n -= 1
            pop_to(n)

    while True:
        found = _TAG.search(html, at, last) if at < last else None
        text = html[at : found.start() if found else len(html)]
        if not found and (hidden := text.find("<!--")) >= 0:
            text = text[:hidden]
        if not skips and text:
            held.append(unescape(text))
        if not found:
            break
        at = found.end()
        closing, name, attributes = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
        if not name:
            if found[0].startswith("<!--") and not found[0].endswith("-->"):  # a comment that never ends
                break
            continue
        tag = name.lower()
        if closing:
            if tag not in _INLINE:
                flush()
            close(tag)
            continue
        if tag not in _INLINE:
            flush()
            if tag == "body":  # ends a head that was left open
                close("head")
            for n in reversed(blocks_at if tag != "br" else []):
                open_ = stack[n][0]
                if open_ in _IMPLIED and (_IMPLIED[open_] is None or tag in _IMPLIED[open_]):
                    pop_to(n)
                    break
                if open_ not in _IMPLIED:
                    break
        if tag in _VOID or attributes.endswith("/") and tag not in _RAW:
            continue
        kind = _kind(tag, attributes, mains > 0)
        if isinstance(kind, int):
            if probed is None and not skips and enclosing is None:
                enclosing = _enclosing(html)
            kind = None if probed is not None or enclosing and enclosing.get(found.start(), 0) >= kind else "skip"
        if probed is not None and kind == "main" and not skips:
            mark = 1 if tag == "article" else 2
            for _, _, start in reversed(stack):
                if probed.get(start, 0) >= mark:
                    break
                probed[start] = mark
        if kind is not None:
            flush()
        if tag not in _INLINE:
            blocks_at.append(len(stack))
        stack.append((tag, kind, found.start()))
        open_tags[tag] += 1
        skips += kind == "skip"
        mains += kind == "main"
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b", re.I).search(html, at)
            if kind != "skip" and not skips:
                held.append(html[at : end.start() if end else len(html)])
            at = end.start() if end else len(html)
    flush()
    return main, other


def repeated(tokens: np.ndarray, page: np.ndarray, run: int) -> np.ndarray:
    """Which tokens lie in a run of ``run`` tokens that another page has too.

    ``tokens`` are the pages' streams on end, each closed by a token of its own. Suffixes are sorted by their
    first 1, 2, 4 ... tokens until the order is by ``run`` of them; neighbours in it that agree are repeats.
    """
    n = len(tokens)
    covered = np.zeros(n + 1, np.int64)
    _, rank = np.unique(tokens, return_inverse=True)
    width = 1
    while width < run:
        step = min(width, run - width)
        behind = np.full(n, -1, np.int64)
        behind[: n - step] = rank[step:]
        _, rank = np.unique(rank * np.int64(n + 2) + behind + 1, return_inverse=True)
        width += step
    order = np.argsort(rank, kind="stable")
    first = np.flatnonzero(np.r_[True, rank[order][1:] != rank[order][:-1]]) if n else np.arange(0)
    if n:
        least, most = np.minimum.reduceat(page[order], first), np.maximum.reduceat(page[order], first)
        starts = np.flatnonzero((least < most)[rank])
        starts = starts[starts + run <= n]
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + run, -1)
    return np.cumsum(covered)[:n] > 0


def unique_runs(streams: list[list[str]], run: int = RUN) -> list[list[str]]:
    """The streams without the runs that different streams of the list share; equal streams count as one."""
    numbers: dict[str, int] = {}
    distinct: dict[tuple[str, ...], int] = {}
    tokens, pages, spans = [], [], []
    for stream in streams:
        key = tuple(stream)
        if key not in distinct:
            distinct[key] = len(spans)
            spans.append((len(tokens), len(tokens) + len(stream)))
            tokens += [numbers.setdefault(t, len(numbers)) for t in stream]
            pages += [len(spans) - 1] * (len(stream) + 1)
            tokens.append(-len(spans))
    gone = repeated(np.array(tokens, np.int64), np.array(pages, np.int64), run)
    out = []
    for stream in streams:
        a, b = spans[distinct[tuple(stream)]]
        out.append([t for t, g in zip(stream, gone[a:b].tolist()) if not g])
    return out


def _unique_runs_of_large_hosts(undecided: DataFrame, run: int) -> DataFrame:
    """As ``unique_runs``, for hosts of any size: a run is the (64 + 32)-bit hash of its tokens, and repeats if
    streams of two texts have it. Equal streams are looked at once and keep what they have in common."""
    streams = undecided.groupBy("host", F.sha2("text", 256).alias("stream")).agg(F.first("text").alias("text"))

    def hashed(batch: pa.RecordBatch):
        data, offsets = utf8(batch.column("text"))
        words = words_of(data, offsets)
        ok = within(words.first, len(words.hashes), run)
        return words, rolling(words.hashes, run, _ONE), rolling(words.hashes, run, _TWO).astype(np.uint32).view(np.int32), ok

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, h, c, ok = hashed(batch)
            at = np.flatnonzero(ok)
            of = pa.array(np.searchsorted(words.first, at, "right") - 1)
            yield pa.record_batch({"host": batch.column("host").take(of), "stream": batch.column("stream").take(of), "h": h[at].view(np.int64), "c": c[at]})

    found = streams.mapInArrow(runs, "host string, stream string, h long, c int")
    shared = found.groupBy("host", "h", "c").agg(F.min("stream").alias("_least"), F.max("stream").alias("_most")).filter("_least < _most")
    gone = found.join(shared, ["host", "h", "c"]).groupBy("host", "stream").agg(F.collect_set(F.struct("h", "c")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words, h, c, _ = hashed(batch)
            texts = []
            for k, (text, gone_) in enumerate(zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist())):
                a, b = int(words.first[k]), int(words.first[k + 1])
                covered = np.zeros(b - a + 1, np.int64)
                if gone_ and b - a >= run:
                    wanted = {(x["h"], x["c"]) for x in gone_}
                    at = np.flatnonzero([x in wanted for x in zip(h[a : b - run + 1].view(np.int64).tolist(), c[a : b - run + 1].tolist())])
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + run, -1)
                texts.append(" ".join(t for t, n in zip(text.split(" "), np.cumsum(covered)[:-1].tolist()) if not n))
            yield pa.record_batch({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string())})

    kept = undecided.withColumn("stream", F.sha2("text", 256)).join(gone, ["host", "stream"], "left")
    return kept.select("id", "url", "text", "gone").mapInArrow(cut, "id long, url string, text string")


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = RUN) -> DataFrame:
    """One row per row of pages: id, url, text.

    The structure of a page decides first: elements that never hold content go, and where an article or main
    element holds text, that text is the page's, repeated elsewhere or not. What is left open are the blocks of
    pages without such an element. These go, by host, into token streams, and a suffix array over the host's
    streams finds runs of at least ``run`` tokens that distinct streams share; covered tokens go and unique runs
    stay. Only open streams are exchanged. A host of more than HOST_TOKENS tokens has too many for one array;
    its suffixes are dealt by the hash of their first ``run`` tokens, and grouped counts find the same runs.

    Character references are decoded, white space in a block becomes one space, and blocks are joined by one
    space. Null and empty pages give an empty text. A null or odd URL is a host of its own kind, the empty one.
    Repeated rows are equal streams, which count once. An empty table gives none.
    """
    small_batches(pages.sparkSession)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts, is_open = [], []
            for html in batch.column("html").to_pylist():
                main, other = blocks(html or "")
                texts.append(" ".join(main or other))
                is_open.append(bool(other) and not main)
            yield pa.record_batch({"id": batch.column("id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "is_open": pa.array(is_open, pa.bool_())})

    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    parsed = materialise(rows.mapInArrow(parse, "id long, url string, text string, is_open boolean"), "pages")
    undecided = parsed.filter("is_open").withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1)))
    sizes = undecided.groupBy("host").agg((F.sum(F.size(F.split("text", " "))) > HOST_TOKENS).alias("_large"))
    undecided = undecided.join(sizes, "host")

    def search(table: pa.Table) -> pa.Table:
        left = unique_runs([t.split(" ") for t in table.column("text").to_pylist()], run)
        return pa.table({"id": table.column("id"), "url": table.column("url"), "text": pa.array([" ".join(x) for x in left], pa.string())})

    small = undecided.filter("NOT _large").select("host", "id", "url", "text").groupBy("host").applyInArrow(search, "id long, url string, text string")
    large = _unique_runs_of_large_hosts(undecided.filter("_large"), run)
    out = parsed.filter("NOT is_open").select("id", "url", "text").union(small).union(large)
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    """All pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))


# For pages like the given ones: one article, of headings, paragraphs and line breaks, with these character references.
SQL = {
    "op4_html_text": r"""
        WITH articles AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS article FROM pages),
        blocks AS (SELECT *, list_transform(string_split_regex(article, '</?p>|<br>|</?h1>'), lambda b:
            trim(regexp_replace(regexp_replace(replace(regexp_replace(b, '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM articles),
        texts AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), ' ') AS text FROM blocks)
        SELECT *, length(text) AS n_chars FROM texts
    """,
}
QUERIES = {"op4_html_text": op4_html_text}
