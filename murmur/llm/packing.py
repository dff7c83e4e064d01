"""Packing of token ids into fixed-length sequences by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import slices, small_batches
from murmur.llm._tokens import Encoder, default_path, pre_tokens, words_apart
from murmur.llm._words import utf8, words_of

#: Pieces that are packed with one another at most, about; fixes the rows of a group, not their number.
GROUP = 4_096


class OpenWindows:
    """Open windows by remaining capacity: a segment tree whose leaves count the windows of each capacity."""

    def __init__(self, capacity: int):
        self.base = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.base)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, n: int) -> None:
        node = self.base + room
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The tightest open window that holds ``length``, as (its capacity, its number)."""
        node = self.base + length
        if not self.count[node]:
            while node > 1 and (node & 1 or not self.count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.base
        self._add(room, -1)
        return room, self.windows[room].pop()


def best_fit(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece, longest first; equal lengths in the given order."""
    windows, offsets, made, held = [0] * len(lengths), [0] * len(lengths), 0, OpenWindows(capacity)
    for k in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        found = held.take(lengths[k])
        room, window = found or (capacity, made)
        made += found is None
        windows[k], offsets[k] = window, capacity - room
        if room > lengths[k]:
            held.put(room - lengths[k], window)
    return windows, offsets


def cut_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Pieces of every document: id, start, length, ids_crc32, doc_tokens and, if asked for, ids (array of int).

    A document is its token ids and ``end_id``, so an empty or null text is one id. It is cut into full windows
    of ``capacity`` ids and one rest. Distinct words are encoded once in a worker where the vocabulary file, a JSON
    file of the tokenizers library, allows it, else whole texts are. Repeated rows and null ids are documents like
    any. An empty table gives none.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_path()
    apart = words_apart(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches):
            if apart:
                data, offsets = utf8(batch.column("text"))
                starts, ends, first = pre_tokens(data, words_of(data, offsets))
                ids, upto = encoder.ids(data, starts, ends, first)
            else:
                ids, upto = encoder.whole(batch.column("text").to_pylist())
            row, start, crc, pieces = [], [], [], []
            for k, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist())):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for at in range(0, len(own), capacity):
                    piece = own[at : at + capacity]
                    row.append(k)
                    start.append(at)
                    crc.append(zlib.crc32(piece.tobytes()))
                    pieces.append(piece)
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            out = {"id": batch.column("id").take(pa.array(row, pa.int64())), "start": np.array(start, np.int64), "length": lengths, "ids_crc32": np.array(crc, np.int64), "doc_tokens": (np.diff(upto) + 1)[row].astype(np.int64)}
            if with_ids:
                flat = np.concatenate(pieces).astype(np.int32) if pieces else np.empty(0, np.int32)
                out["ids"] = pa.ListArray.from_arrays(np.r_[0, np.cumsum(lengths)].astype(np.int32), pa.array(flat, pa.int32()))
            yield pa.record_batch(out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1, vocabulary: str | None = None, with_ids: bool = True, group: int = GROUP) -> DataFrame:
    """The pieces of ``cut_documents`` with sequence_id and offset: every sequence holds at most ``capacity`` ids.

    Pieces are dealt by a hash of id, start and checksum into groups of about ``group`` pieces or fewer (a text has
    no more ids than bytes), and each group is packed by best-fit decreasing. So no task grows with the table or
    with a long document. A group's padding is that of its few last windows.
    sequence_id is the group's number times 2**32 plus the window's number in it. Equal lengths are packed in the
    order of id, start and checksum. Rows that repeat an id and rows with a null id are packed as documents of their
    own; null and empty texts are one id each. Other columns are not read. An empty table gives none.
    """
    pieces = cut_documents(docs, id_col, text_col, capacity, end_id, vocabulary, with_ids)
    most = docs.agg((F.count("*") + F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0)) / capacity).cast("long").alias("n")).first()["n"]
    groups = max(1, -(-most // group))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        windows, offsets = best_fit(table.column("length").to_pylist(), capacity)
        first = int(table.column("_group")[0].as_py()) << 32 if len(table) else 0
        table = table.append_column("sequence_id", pa.array(np.array(windows, np.int64) + first)).append_column("offset", pa.array(np.array(offsets, np.int64)))
        return table.drop_columns(["_group"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.withColumn("_group", F.pmod(F.xxhash64(id_col, "start", "ids_crc32"), F.lit(groups)).cast("int")).groupBy("_group").applyInArrow(run, f"{kept}, sequence_id long, offset long")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)


SQL: dict[str, str] = {}
QUERIES = {"op3_packing": op3_packing}
