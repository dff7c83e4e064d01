"""Benchmark passages in documents: q-gram lemma filtering in diagonal bands, verified by banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import slices, small_batches, spans
from murmur.llm._words import utf8

#: Bytes of a q-gram, bytes of a passage, and edits allowed per byte of a passage.
Q, PASSAGE, EDIT_RATE = 8, 64, 0.1
#: Items of fewer normalised bytes, which allow no edits, match between word borders alone.
WORD_BORDERS = 16
#: Normalised bytes of benchmark text that one pass over the documents searches for; fixes what is broadcast at once.
BLOCK_BYTES = 1 << 22
#: Passages that begin in one part of an item, bytes of a stretch of a text, shared q-grams that are looked at together, and
#: passages aligned at once.
PART, STRETCH, PAIRS, LANES = 192, 128, 1 << 20, 4096
_KEPT = np.zeros(256, bool)
_KEPT[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Diagonals count from here, so that none is negative.
_ZERO = 1 << 16


def normalise(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case texts as UTF-8 without ASCII other than letters and digits: bytes and the offsets of the texts."""
    data, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    kept = _KEPT[data]
    upto = np.r_[0, np.cumsum(kept)]
    return data[kept], upto[offsets]


def word_starts(column: pa.Array) -> np.ndarray:
    """Which bytes of the normalised texts follow a byte that was left out."""
    data, _ = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    kept = _KEPT[data]
    return ~np.r_[False, kept[:-1]][kept] if len(kept) else kept


def qgrams(data: np.ndarray) -> np.ndarray:
    """Every Q consecutive bytes as a number."""
    n = max(0, len(data) - Q + 1)
    return np.ndarray(n, "<u8", np.ascontiguousarray(data).tobytes(), strides=(1,)) if n else np.empty(0, np.uint64)


def fewest_edits(passages: np.ndarray, lengths: np.ndarray, regions: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Per passage, the fewest edits that turn it into some substring of its region, regions[which]: an alignment of 64 rows
    at a time, whose vertical differences are the bits of two numbers that each byte of the region moves on. Passages
    are padded to PASSAGE bytes, regions with zeros, which are no bytes of a text."""
    one, n = np.uint64(1), len(passages)
    equal = np.zeros((n, 256), np.uint64)
    row = np.arange(n)
    for k in range(PASSAGE):
        equal[row, passages[:, k]] |= one << np.uint64(k)
    equal[:, 0] = 0
    bottom = (lengths - 1).astype(np.uint64)
    up, down = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)  # where the next row has one more, one less
    edits = lengths.astype(np.int64)
    best = edits.copy()
    for k in range(regions.shape[1]):
        same = equal[row, regions[which, k]]
        diagonal = (((same & up) + up) ^ up) | same | down
        across_less, across_more = up & diagonal, down | ~(up | diagonal)
        edits += ((across_more >> bottom) & one).astype(np.int64) - ((across_less >> bottom) & one).astype(np.int64)
        across_more = across_more << one  # a match may begin anywhere
        up, down = (across_less << one) | ~((same | down) | across_more), across_more & (same | down)
        np.minimum(best, edits, out=best)
    return best


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, on end."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(starts) else np.arange(0)


class Index:
    """The q-grams of a block of benchmark items, by value, with the parts that they are in.

    A part holds the passages that begin in PART places of an item; an item's equal parts are one. Items of fewer
    than WORD_BORDERS bytes are kept aside by their first q-gram.
    """

    def __init__(self, items: list[tuple[int | None, str]], edit_rate: float = EDIT_RATE):
        self.ids = [i for i, _ in items]
        data, offsets = normalise(pa.array([t for _, t in items], pa.string()))
        self.texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        self.short: dict[int, list[int]] = {}
        parts: dict[tuple[int, bytes], None] = {}
        for k, text in enumerate(self.texts):
            if len(text) >= WORD_BORDERS:
                for a in range(0, max(1, len(text) - PASSAGE + 1), PART):
                    parts[k, text[a : a + PART + PASSAGE - 1]] = None
            elif len(text) >= Q:
                self.short.setdefault(int(qgrams(np.frombuffer(text, np.uint8))[0]), []).append(k)
        self.item = np.array([k for k, _ in parts], np.int64)
        self.parts = [np.frombuffer(text, np.uint8) for _, text in parts]
        self.rules: list[tuple[int, int, int]] = []  # bytes of a passage, edits allowed, least shared q-grams
        for text in self.parts:
            length = min(len(text), PASSAGE)
            budget = min(int(length * edit_rate), (length - Q) // Q)
            self.rules.append((length, budget, length - Q + 1 - Q * budget))
        own = [qgrams(x) for x in self.parts]
        grams = np.concatenate([np.empty(0, np.uint64), *own])
        part, place = np.repeat(np.arange(len(own)), [len(x) for x in own]), np.concatenate([np.arange(0), *(np.arange(len(x)) for x in own)])
        order = np.argsort(grams, kind="stable")
        self.part, self.place = part[order].astype(np.int32), place[order].astype(np.int32)
        self.grams, rank = np.unique(grams[order], return_inverse=True)
        self.key = rank * np.int64(max(1, len(own))) + self.part
        self.many = np.bincount(rank, minlength=len(self.grams))
        self.pairs = self.lanes = 0  # work so far: shared q-grams looked at, passages aligned
        self.bits = max(20, min(24, (4 * len(self.grams)).bit_length()))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[self._cell(np.r_[self.grams, np.array([*self.short], np.uint64)])] = True
        self.least = min((least for *_, least in self.rules), default=1)
        self.most = max((budget for _, budget, _ in self.rules), default=0)
        self.width = 1 << self.most.bit_length()  # over the budget

    def _cell(self, grams: np.ndarray) -> np.ndarray:
        return ((grams * _FACTOR) >> np.uint64(64 - self.bits)).astype(np.int64)

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(text's number, item's number, fewest edits of a passage of it) for all texts of a batch."""
        data, offsets = normalise(column)
        grams = qgrams(data)
        at = np.flatnonzero(self.filter[self._cell(grams)])
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + Q <= offsets[text + 1]
        at, text = at[inside], text[inside]
        found: dict[tuple[int, int], int] = {}
        if self.short:
            self._find_short(column, data, offsets, grams, at, text, found)
        if len(at) and len(self.grams):
            rank = np.minimum(np.searchsorted(self.grams, grams[at]), len(self.grams) - 1)
            same = self.grams[rank] == grams[at]
            _Search(self, data, offsets, found).run(at[same], text[same], rank[same])
        return [(t, i, e) for (t, i), e in sorted(found.items())]

    def _find_short(self, column, data, offsets, grams, at, text, found) -> None:
        """Items of few bytes: whole, without edits and between word borders."""
        first, some = word_starts(column), np.isin(grams[at], np.array([*self.short], np.uint64))
        for a, t in zip(at[some].tolist(), text[some].tolist()):
            for k in self.short[int(grams[a])]:
                own, begin, end = self.texts[k], int(offsets[t]), int(offsets[t + 1])
                b = a + len(own)
                if (t, k) not in found and b <= end and (a == begin or first[a]) and (b == end or first[b]) and data[a:b].tobytes() == own:
                    found[t, k] = 0


class _Search:
    """The search of an index's passages in the texts of a batch.

    Texts are looked at in stretches of STRETCH bytes, each with what a passage that begins there reaches over. A stretch
    that recurs, in one text or several, is searched once; so are the equal parts of an item, and passages that a part
    repeats. So texts that repeat themselves cost as much as one of their periods.
    """

    def __init__(self, index: Index, data: np.ndarray, offsets: np.ndarray, found: dict):
        self.index, self.data, self.offsets, self.found = index, data, offsets, found
        self.reach = PASSAGE + index.most

    def run(self, at: np.ndarray, text: np.ndarray, rank: np.ndarray) -> None:
        """Search from the shared q-grams, in their order: places, texts and q-grams by number."""
        block = (at - self.offsets[text]) // STRETCH
        hits, of = [np.arange(len(at))], [block]
        for back in range(1, -(-self.reach // STRETCH) + 1):  # what a stretch reaches over
            inside = np.flatnonzero((block >= back) & (at - self.offsets[text] < (block - back + 1) * STRETCH + self.reach))
            hits.append(inside)
            of.append(block[inside] - back)
        hits, of = np.concatenate(hits), np.concatenate(of)
        order = np.lexsort((hits, of, text[hits]))
        hits, of = hits[order], of[order]
        new = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (text[hits][1:] != text[hits][:-1])])
        ends = np.r_[new[1:], len(hits)]
        enough = ends - new >= self.index.least
        self.regions: list[bytes] = []
        self.texts: list[set[int]] = []
        known: dict[tuple[int, bytes], int] = {}
        held, size = [], 0
        for a, b in zip(new[enough].tolist(), ends[enough].tolist()):
            t = int(text[hits[a]])
            low, high = int(self.offsets[t]), int(self.offsets[t + 1])
            begin = low + int(of[a]) * STRETCH
            x, y = max(low, begin - self.reach), min(high, begin + STRETCH + self.reach + Q)
            key = (begin - x, self.data[x:y].tobytes())
            if key in known:
                self.texts[known[key]].add(t)
                continue
            known[key] = len(self.regions)
            self.regions.append(key[1])
            self.texts.append({t})
            own = hits[a:b]
            held.append((known[key], at[own] - x, rank[own]))
            size += int(self.index.many[rank[own]].sum())
            if size > PAIRS:
                self.look(held)
                held, size = [], 0
        if held:
            self.look(held)

    def look(self, held: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Look at stretches (number, places of q-grams in it, q-grams), in as many turns as the parts of items need."""
        stretch, where, rank = np.repeat([k for k, *_ in held], [len(w) for _, w, _ in held]), np.concatenate([w for _, w, _ in held]), np.concatenate([r for *_, r in held])
        todo = [(0, len(self.index.parts))]
        while todo:
            low, high = todo.pop()
            key = rank * np.int64(len(self.index.parts))
            first, last = np.searchsorted(self.index.key, key + low), np.searchsorted(self.index.key, key + high)
            if (last - first).sum() > 2 * PAIRS and high - low > 1:
                todo += [(low, (low + high) // 2), ((low + high) // 2, high)]
            else:
                self.align(self.passages(stretch, where, first, last - first))

    def passages(self, stretch: np.ndarray, where: np.ndarray, first: np.ndarray, n: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """By stretch and part, which passages reach the count of shared q-grams in a band of diagonals. Bands have two
        widths, each a width further, one of which holds any budget + 1 diagonals."""
        index, width = self.index, self.index.width
        post = _ranges(first, n)
        index.pairs += len(post)
        out: dict[tuple[int, int], np.ndarray] = {}
        if len(post) < index.least:
            return out
        part, place, stretch, where = index.part[post].astype(np.int64), index.place[post], np.repeat(stretch, n), np.repeat(where, n)
        band = (where - place + _ZERO) // width
        span = int(band.max()) + 2
        key = (stretch * span + band) * np.int64(len(index.parts)) + part
        key, place = np.r_[key, key - len(index.parts)], np.r_[place, place]
        order = np.lexsort((place, key))
        key, place = key[order], place[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        ends = np.r_[new[1:], len(key)]
        enough = ends - new >= index.least
        for x, y in zip(new[enough].tolist(), ends[enough].tolist()):
            rest, k = divmod(int(key[x]), len(index.parts))
            length, _, least = index.rules[k]
            places = np.unique(place[x:y])
            starts = np.arange(max(0, int(places[0]) - length + Q), min(len(index.parts[k]) - length, int(places[-1])) + 1)
            shared = np.searchsorted(places, starts + length - Q, "right") - np.searchsorted(places, starts)
            if len(starts := starts[shared >= least]):
                out.setdefault((rest // span, k), np.zeros(PART, bool))[starts] = True
        return out

    def align(self, found: dict[tuple[int, int], np.ndarray]) -> None:
        """Align passages with their stretches, LANES at a time; one that a part repeats once."""
        lanes: list[tuple[int, int, bytes]] = []
        for (s, k), starts in found.items():
            length, own = self.index.rules[k][0], self.index.parts[k].tobytes()
            lanes += [(s, k, x) for x in dict.fromkeys(own[a : a + length] for a in np.flatnonzero(starts).tolist())]
            if len(lanes) >= LANES:
                self._align(lanes)
                lanes = []
        if lanes:
            self._align(lanes)

    def _align(self, lanes: list[tuple[int, int, bytes]]) -> None:
        self.index.lanes += len(lanes)
        number = {s: n for n, s in enumerate(dict.fromkeys(s for s, *_ in lanes))}
        size = max(len(self.regions[s]) for s in number)
        regions = np.frombuffer(b"".join(self.regions[s].ljust(size, b"\0") for s in number), np.uint8).reshape(-1, size)
        passages = np.frombuffer(b"".join(x.ljust(PASSAGE, b"\0") for *_, x in lanes), np.uint8).reshape(-1, PASSAGE)
        edits = fewest_edits(passages, np.array([len(x) for *_, x in lanes]), regions, np.array([number[s] for s, *_ in lanes]))
        for (s, k, _), e in zip(lanes, edits.tolist()):
            if e <= self.index.rules[k][1]:
                item = int(self.index.item[k])
                for t in self.texts[s]:
                    self.found[t, item] = min(e, self.found.get((t, item), e))


def _indexes(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[Index]:
    """Indexes of blocks of items in id order, each of bounded size however large the benchmark."""
    held, size = [], 0
    rows = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).filter("text IS NOT NULL").distinct().orderBy("id", "text")
    for row in rows.toLocalIterator():
        held.append((row["id"], row["text"]))
        size += len(row["text"].encode())
        if size >= block_bytes:
            yield Index(held)
            held, size = [], 0
    if held:
        yield Index(held)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (id, item, edits) for every document and benchmark item such that a passage of the item occurs in
    the document: any PASSAGE bytes of it (all of it, if shorter) with at most EDIT_RATE edits a byte. edits is the
    fewest of any such passage.

    Texts are compared in lower case without ASCII marks and white space. A passage of n bytes within e edits
    shares n - Q + 1 - Q * e q-grams with the document on e + 1 neighbouring diagonals; bands of diagonals
    overlap so that one holds them all, and only passages that reach the count in a band are aligned. Stretches of
    texts, parts of items and passages that repeat are looked at once.

    The benchmark is the query set, searched for in blocks of bounded size: each block's index goes to the tasks
    and all documents are read against it, whole. Items with a null id are searched for as any and give a null item.
    Items of Q to WORD_BORDERS - 1 normalised bytes allow no edits and must lie between word borders; shorter
    ones match nothing, nor do null texts. Repeated items with one id and text count once. Repeated rows and null
    ids of documents are matched like any. Other columns are not read. An empty table on either side gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, item long, edits int"
    out = spark.createDataFrame([], schema)
    for index in _indexes(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                found = sent.value.matches(batch.column("text"))
                of = pa.array([t for t, _, _ in found], pa.int64())
                yield pa.record_batch({"id": batch.column("id").take(of), "item": pa.array([sent.value.ids[i] for _, i, _ in found], pa.int64()), "edits": pa.array([e for *_, e in found], pa.int32())})

        out = out.union(rows.mapInArrow(run, schema))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _clean(sent):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        out, column = np.ones(len(texts), bool), pa.array(texts, pa.string(), from_pandas=True)
        for a, b in spans(column):
            out[[a + t for t, _, _ in sent.value.matches(column.slice(a, b - a))]] = False
        return pd.Series(out)

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, in their own columns, without rows that match any item; see ``benchmark_matches``.

    Rows are judged by their text alone, so repeated rows and null ids are judged alike; null and empty texts stay.
    An empty benchmark leaves docs as they are, empty docs stay empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    for index in _indexes(benchmark, item_col, item_text_col, block_bytes):
        sent = spark.sparkContext.broadcast(index)

        docs = docs.filter(_clean(sent)(F.col(text_col).cast("string")))
    return docs


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds a passage of."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return benchmark_matches(docs, benchmark)


SQL: dict[str, str] = {}
QUERIES = {"op9_decontamination": op9_decontamination}
