"""Token counts that follow edits: a segment tree over each document's pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import slices, small_batches
from murmur.llm._tokens import Encoder, default_path, pre_tokens, words_apart
from murmur.llm._words import utf8, words_of


class CountTree:
    """Characters and tokens of a text's stretches, each a word and the white space behind it, with subtree sums.

    A stretch ends before a word, so no token spans two of them and the sum over all is the text's count.
    """

    def __init__(self, parts: list[bytes], chars: np.ndarray, tokens: np.ndarray, encoder: Encoder):
        self.parts, self.encoder, self.reencoded = parts, encoder, 0
        self.base = 1 << max(0, len(parts) - 1).bit_length()
        self.chars, self.tokens = self._sums(chars), self._sums(tokens)

    def _sums(self, values: np.ndarray) -> list[int]:
        level = np.zeros(self.base, np.int64)
        level[: len(values)] = values
        levels = [level]
        while len(level) > 1:
            level = level[::2] + level[1::2]
            levels.append(level)
        return np.concatenate([[0], *levels[::-1]]).tolist()

    def __len__(self) -> int:
        return self.chars[1]

    def _find(self, at: int) -> tuple[int, int]:
        """The stretch that holds character ``at`` and the character it begins at; the last one if at is the end."""
        node, begin = 1, 0
        while node < self.base:
            node *= 2
            if at >= begin + self.chars[node] and self.chars[node + 1]:
                begin += self.chars[node]
                node += 1
        return node - self.base, begin

    def _set(self, leaf: int, part: bytes, chars: int, tokens: int) -> None:
        self.parts[leaf] = part
        node = self.base + leaf
        up_chars, up_tokens = chars - self.chars[node], tokens - self.tokens[node]
        while node:
            self.chars[node] += up_chars
            self.tokens[node] += up_tokens
            node >>= 1

    def edit(self, at: int, n_delete: int, insert: str) -> None:
        """Delete n_delete characters from ``at`` on and put ``insert`` there; both are clipped to the text."""
        at = min(max(at, 0), len(self))
        stop = min(at + max(n_delete, 0), len(self))
        low, begin = self._find(at)
        high, high_begin = self._find(stop)
        low, begin = self._find(max(begin - 1, 0)) if begin else (low, begin)  # a stretch of context before
        end = high_begin + self.chars[self.base + high]
        if end < len(self):  # and one behind, which an edit may join to
            high, more = self._find(end)
            end = more + self.chars[self.base + high]
        old = b"".join(self.parts[low : high + 1]).decode()
        new = old[: at - begin] + insert + old[stop - begin :]
        self.reencoded += len(new)
        self._set(low, new.encode(), len(new), self.encoder.count(new))
        for leaf in range(low + 1, high + 1):
            if self.chars[self.base + leaf]:
                self._set(leaf, b"", 0, 0)

    def text(self) -> str:
        return b"".join(self.parts).decode()


def count_tokens(docs: DataFrame, edits: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_tokens of the text as it is, n_tokens_edited after its edits, n_chars_edited,
    n_chars_reencoded and, if asked for, text_edited.

    ``edits`` names a column array<struct<at int, n_delete int, insert string>>, applied in order, each to the
    outcome of the one before; positions count code points and are clipped to the text. Only the stretches that
    an edit touches and one on either side are encoded again; sums above them are updated.

    ``vocabulary`` must encode words by themselves (see ``words_apart``), else an error says so. Null and empty texts
    have no tokens and can be edited. A null edit list is empty; a null field of an edit
    is 0 or the empty string. Null ids and repeated rows are counted like any. Other columns are not read. An
    empty table gives none.
    """
    small_batches(docs.sparkSession)
    path = vocabulary or default_path()
    if not words_apart(path):
        raise ValueError("edit-aware counts need a vocabulary that encodes words by themselves")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches):
            data, offsets = utf8(batch.column("text"))
            words = words_of(data, offsets)
            starts, ends, first = pre_tokens(data, words)
            counts = np.r_[0, np.cumsum(encoder.counts(data, starts, ends))]
            first_part = np.searchsorted(starts, words.starts)
            chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            buffer = data.tobytes()
            lists = batch.column("edits").to_pylist()
            before = counts[first[1:]] - counts[first[:-1]]
            after, n_chars, again, texts = [], [], [], []
            for k, edits_ in enumerate(lists):
                a, b = int(words.first[k]), int(words.first[k + 1])
                bounds = np.r_[offsets[k], words.starts[a + 1 : b], offsets[k + 1]]
                cuts = np.r_[first[k], first_part[a + 1 : b], first[k + 1]]
                whole = bounds.tolist()
                tree = CountTree([buffer[x:y] for x, y in zip(whole, whole[1:])], np.diff(chars[bounds]), np.diff(counts[cuts]), encoder)
                for e in edits_ or []:
                    tree.edit(e["at"] or 0, e["n_delete"] or 0, e["insert"] or "")
                after.append(tree.tokens[1])
                n_chars.append(tree.chars[1])
                again.append(tree.reencoded)
                texts.append(tree.text() if with_text else None)
            out = {"id": batch.column("id"), "n_tokens": before.astype(np.int64), "n_tokens_edited": pa.array(after, pa.int64()), "n_chars_edited": pa.array(n_chars, pa.int64()), "n_chars_reencoded": pa.array(again, pa.int64())}
            yield pa.record_batch(out | ({"text_edited": pa.array(texts, pa.string())} if with_text else {}))

    column = F.col(edits) if edits else F.lit(None)
    column = column.cast("array<struct<at int, n_delete int, insert string>>")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), column.alias("edits"))
    schema = "id long, n_tokens long, n_tokens_edited long, n_chars_edited long, n_chars_reencoded long"
    return rows.mapInArrow(run, schema + ", text_edited string" * with_text).withColumnRenamed("id", id_col)


def three_edits(text: str = "text", id_col: str = "doc_id") -> F.Column:
    """An edit batch that depends on the row alone: at a quarter of the text seven characters are replaced by a
    word made of the id, at its half two characters go (often white space, joining words), and a clause is put
    at three quarters."""
    n = F.coalesce(F.char_length(text), F.lit(0))
    word = F.concat(F.lit(" rev"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "))

    def one(at, n_delete, insert):
        return F.struct(F.floor(at).cast("int").alias("at"), F.lit(n_delete).alias("n_delete"), insert.alias("insert"))

    return F.array(one(n / 4, 7, word), one(n / 2, 2, F.lit("")), one(n * 3 / 4, 0, F.lit("'s new clause, ")))


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """All documents, counted before and after three edits each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs.withColumn("edits", three_edits()), "edits")


SQL: dict[str, str] = {}
QUERIES = {"op10_token_counts": op10_token_counts}
