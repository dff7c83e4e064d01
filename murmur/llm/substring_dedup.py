"""Removal of word windows that an earlier document holds, by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import materialise, slices, small_batches
from murmur.llm.exact_dedup import dedup_groups
from murmur.llm._words import Words, mix, rolling, utf8, within, words_of

#: The anchor filter: a fixed number of bits, whatever the input, in segments that tasks build alone.
SEGMENT_BITS, CELL_BITS = 8, 20
_ANCHOR, _WINDOW, _CHECK = 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
#: Anchor hashes that a task gathers before it passes them on.
_GATHER = 1 << 20


def _segment(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SEGMENT_BITS)).astype(np.int64)


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << CELL_BITS) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(CELL_BITS)) & mask).astype(np.int64)


def _get(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    return (bits[cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 > 0


def _put(bits: np.ndarray, cell: np.ndarray) -> None:
    np.bitwise_or.at(bits, cell >> 3, np.left_shift(np.uint8(1), (cell & 7).astype(np.uint8)))


def _has(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes the whole filter (all segments on end) may hold."""
    base = _segment(h) << CELL_BITS
    a, b = _cells(h)
    found = _get(filter_, base + a)
    found[found] = _get(filter_, (base + b)[found])
    return found


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words, np.ndarray, np.ndarray]]:
    for batch in slices(batches):
        data, offsets = utf8(batch.column("text"))
        yield batch, words_of(data, offsets), data, offsets


def _by_segment(h: np.ndarray) -> pa.RecordBatch:
    h = np.sort(h)
    cuts = np.searchsorted(_segment(h), np.arange((1 << SEGMENT_BITS) + 1))
    full = np.flatnonzero(np.diff(cuts))
    return pa.record_batch({"segment": pa.array(full.astype(np.int32)), "hashes": pa.array([h[cuts[s] : cuts[s + 1]].tobytes() for s in full], pa.binary())})


def _gathered(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    for part in parts:
        held.append(part)
        if sum(map(len, held)) >= _GATHER:
            yield _by_segment(np.concatenate(held))
            held = []
    if held:
        yield _by_segment(np.concatenate(held))


def _among(h: np.ndarray, c: np.ndarray, of_h: np.ndarray, of_c: np.ndarray) -> np.ndarray:
    """Which pairs (h, c) are among the pairs (of_h, of_c)."""
    order = np.argsort(of_h, kind="stable")
    of_h, of_c = of_h[order], of_c[order]
    at, end = np.searchsorted(of_h, h), np.searchsorted(of_h, h, "right")
    found = np.zeros(len(h), bool)
    while (left := at < end).any():
        found[left] |= of_c[at[left]] == c[left]
        at = at + 1
    return found


def _is_aligned(words: Words, n: int, block: int) -> np.ndarray:
    """Which of the first n words begin a reference block of their text."""
    text = np.searchsorted(words.first, np.arange(n), "right") - 1
    return (np.arange(n) - words.first[text]) % block == 0


def _filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per segment, the cells of all hashes, and those of hashes that were there before: at least those that occur twice."""
    made: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for segment, blob in zip(batch.column("segment").to_pylist(), batch.column("hashes")):
            h = np.frombuffer(blob.as_buffer(), np.uint64)
            once, twice = made.setdefault(segment, tuple(np.zeros(1 << CELL_BITS - 3, np.uint8) for _ in range(2)))
            new = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
            a, b = _cells(h)
            old = ~new | _get(once, a) & _get(once, b)
            for cell in (a, b):
                _put(twice, cell[old])
                _put(once, cell)
    for segment, (once, twice) in made.items():
        yield pa.record_batch({"segment": pa.array([segment], pa.int32()), "once": pa.array([once.tobytes()], pa.binary()), "twice": pa.array([twice.tobytes()], pa.binary())})


def _whole(hashes: DataFrame, *names: str) -> list[np.ndarray]:
    """The named filters on the driver: 2**(SEGMENT_BITS + CELL_BITS) bits each, whatever the input."""
    rows = hashes.repartition("segment").mapInArrow(_filters, "segment int, once binary, twice binary").select("segment", *names)
    size = 1 << CELL_BITS - 3
    out = [np.zeros(size << SEGMENT_BITS, np.uint8) for _ in names]
    for row in rows.toLocalIterator():
        for filter_, name in zip(out, names):
            filter_[row["segment"] * size : (row["segment"] + 1) * size] |= np.frombuffer(row[name], np.uint8)
    return out


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """One row per row of docs: id, text (the kept words joined by one space), n_words, n_removed.

    A word goes if some window of ``window`` consecutive words covers it whose word sequence also starts in a
    row with a smaller id; windows are judged on the input. Words are runs of bytes other than 0x20 and 0x09 to
    0x0D of the whole text.

    Reference blocks of (window + 1) // 2 words lie side by side in every text, so any window holds one of
    its own text's blocks whole. The first scan indexes all blocks, the second probes the index with every
    rolling window of a block's width. The index is a filter of a fixed number of bits: where it is full it
    lets more windows through, never fewer. The third scan takes the windows around blocks that were hit, and
    a grouped minimum over (64 + 32)-bit hashes of their words' 64-bit hashes finds each window's smallest id; joined
    back, windows that follow one another extend a hit to a maximal repeat. A window is let through if the one block of its own text
    that it holds occurs elsewhere. A frequent window is one row per document there, is pre-aggregated before the
    shuffle, and its partition may be split in the join. No pairs of documents are made. Whole copies of a text
    with a smaller id lose all their words and give no windows; digests find them beforehand.

    Null and empty texts have no words. Rows of one id never remove each other. Rows with a null id keep all
    words and remove none. Repeated rows are judged alike. Other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    block = (window + 1) // 2
    groups = dedup_groups(docs, id_col, text_col).groupBy(F.col(id_col).alias("id")).agg(F.bool_and(~F.col("kept")).alias("copy"))
    copies = materialise(groups.filter("copy AND id IS NOT NULL").select("id"), "copies")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def blocks(batches):
        def parts():
            for _, words, _, _ in _batches(batches):
                h = rolling(words.hashes, block, _ANCHOR)
                yield h[within(words.first, len(words.hashes), block) & _is_aligned(words, len(h), block)]

        yield from _gathered(parts())

    once, twice = _whole(rows.select("text").mapInArrow(blocks, "segment int, hashes binary"), "once", "twice")
    index = spark.sparkContext.broadcast(once)

    def probes(batches):
        def parts():
            for _, words, _, _ in _batches(batches):
                h = rolling(words.hashes, block, _ANCHOR)
                h = h[within(words.first, len(words.hashes), block) & ~_is_aligned(words, len(h), block)]
                yield h[_has(index.value, h)]

        yield from _gathered(parts())

    (hit,) = _whole(rows.select("text").mapInArrow(probes, "segment int, hashes binary"), "once")
    index.unpersist()
    hit &= once
    hit |= twice
    anchors = spark.sparkContext.broadcast(hit)
    del once, twice

    def hash_windows(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows' hashes, check hashes and which of them lie in one text."""
        n = len(words.hashes)
        ok = within(words.first, n, window)
        return rolling(words.hashes, window, _WINDOW), rolling(words.hashes, window, _CHECK).astype(np.uint32).view(np.int32), ok

    def windows(batches):
        for batch, words, _, _ in _batches(batches):
            h, check, ok = hash_windows(words)
            starts = np.flatnonzero(ok)
            text = np.searchsorted(words.first, starts, "right") - 1
            own = starts + (words.first[text] - starts) % block  # the block of its text that the window holds
            hit = _has(anchors.value, rolling(words.hashes, block, _ANCHOR)[own])
            starts, text = starts[hit], text[hit]
            ids = batch.column("id")
            known = np.asarray(ids.is_valid())
            starts, text = starts[known[text]], text[known[text]]
            id_ = np.asarray(ids.fill_null(0))[text]
            _, one = np.unique(mix(h[starts] ^ mix(text.astype(np.uint64), 3)), return_index=True)  # one row for a window that a text repeats
            yield pa.record_batch({"h": h[starts[one]].view(np.int64), "c": check[starts[one]], "id": id_[one].astype(np.int64)})

    found = rows.join(copies, "id", "left_anti").select("id", "text").mapInArrow(windows, "h long, c int, id long")
    least = found.groupBy("h", "c").agg(F.min("id").alias("least"))
    gone = found.join(least, ["h", "c"]).filter("id > least").groupBy("id").agg(F.collect_list("h").alias("gone"), F.collect_list("c").alias("gone_c"))  # side by side
    none, none_c = F.array().cast("array<long>"), F.array().cast("array<int>")
    facts = gone.select("id", "gone", "gone_c", F.lit(False).alias("copy")).union(copies.select("id", none, none_c, F.lit(True)))

    def cut(batches):
        for batch, words, data, offsets in _batches(batches):
            h, check, ok = hash_windows(words)
            gone_of, gone_c_of, copy, buffer = batch.column("gone"), batch.column("gone_c"), batch.column("copy").to_pylist(), data.tobytes()
            texts, n_removed = [], []
            lists, lists_c = np.asarray(gone_of.offsets), np.asarray(gone_c_of.offsets)
            gone_h, gone_c = np.asarray(gone_of.values).view(np.uint64), np.asarray(gone_c_of.values)
            for k, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                spans = zip(words.starts[a:b].tolist(), words.ends[a:b].tolist())
                covered = np.zeros(b - a + 1, np.int64)
                if copy[k] and b - a >= window:
                    covered[0] = 1
                elif lists[k + 1] > lists[k] and b - a >= window:
                    own = slice(a, b - window + 1)
                    at = np.flatnonzero(_among(h[own], check[own], gone_h[lists[k] : lists[k + 1]], gone_c[lists_c[k] : lists_c[k + 1]]))
                    np.add.at(covered, at, 1)
                    np.add.at(covered, at + window, -1)
                stays = (np.cumsum(covered)[:-1] == 0).tolist()
                texts.append(b" ".join(buffer[s:e] for (s, e), keep in zip(spans, stays) if keep))
                n_removed.append(b - a - sum(stays))
            yield pa.record_batch({"id": batch.column("id"), "text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": np.diff(words.first).astype(np.int64), "n_removed": pa.array(n_removed, pa.int64())})

    joined = rows.join(facts, "id", "left").select("id", "text", F.coalesce("gone", none).alias("gone"), F.coalesce("gone_c", none_c).alias("gone_c"), F.coalesce("copy", F.lit(False)).alias("copy"))
    return joined.mapInArrow(cut, "id long, text string, n_words long, n_removed long").withColumnRenamed("id", id_col)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents, windows of 13 words."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = {
    "op7_substring_dedup": r"""
        WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS win FROM (SELECT *, unnest(range(1, len(ws) - 11)) AS i FROM split WHERE len(ws) >= 13)),
        least AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM windows JOIN least USING (win) WHERE least < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM split),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM split LEFT JOIN kept USING (doc_id)
    """,
}
QUERIES = {"op7_substring_dedup": op7_substring_dedup}
