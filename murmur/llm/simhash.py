"""SimHash near-duplicates, found with vantage-point trees over the fingerprints."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._shared import attach, components, materialise, release, slices, small_batches, trim
from murmur.llm._words import mix, rolling, utf8, within, words_of

#: Fingerprints that the partitioning tree is fitted on, and distinct fingerprints a leaf should hold.
SAMPLE, LEAF = 32_768, 4096
#: Distinct long fingerprints a leaf should hold, the shortest key, the share of pairs at the bound that no key may
#: meet, and bits that drop far pairs.
LONG_LEAF, KEY_BITS, MISSED, CHECK = 16_384, 18, 0.0004, 512
#: Check bits that may differ beyond those expected at the bound: about three standard deviations and a half.
SLACK = 28
#: Entries of one key from which on the nearest of them are taken together before pairs are looked at.
DENSE = 64
#: Bits of a set's sketch at most, as a power of two.
SKETCH = 12
_SHINGLE = 0xC2B2AE3D27D4EB4F
_LANES = np.uint64(0x0101010101010101)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Distances computed at once in a leaf.
_CELLS = 1 << 20
#: Pairs of sketches or of keys compared at once.
_PAIRS = 1 << 14


def majority_bits(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Per text the 64-bit value whose bits are set in over half of its hashes h[first:next first]; 0 for none."""
    counts = np.diff(firsts)
    full = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint64)
    if not len(full):
        return out
    blocks = [np.arange(a, b, 255) for a, b in zip(firsts[full].tolist(), firsts[full + 1].tolist())]
    starts, first_block = np.concatenate(blocks), np.cumsum([0] + [len(b) for b in blocks[:-1]])
    for bit in range(8):  # eight byte counters in a word, of at most 255 each
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, starts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_block, axis=0)
        over = (2 * sums > counts[full, None]).astype(np.uint64)
        for byte in range(8):
            out[full] |= over[:, byte] << np.uint64(8 * byte + bit)
    return out


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The XXH64 of every shingle of a batch of texts, and the first one of each text (n + 1 entries)."""
    data, offsets = utf8(column)
    data = _LOWER[data]
    words = words_of(data, offsets)
    inner = np.zeros(len(data) + 1, bool)  # drop all but one byte of white space between words
    space = np.isin(data, np.array([0x20, 9, 10, 11, 12, 13], np.uint8))
    inner[1:] = ~space | np.r_[False, ~space[:-1]]
    at = np.cumsum(inner)
    text = np.where(space, np.uint8(32), data)[inner[1:]].tobytes()
    n_words = np.diff(words.first)
    n_shingles = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    firsts = np.r_[0, np.cumsum(n_shingles)]
    first_word = np.repeat(words.first[:-1], n_shingles) + np.arange(firsts[-1]) - np.repeat(firsts[:-1], n_shingles)
    last_word = np.minimum(first_word + shingle, np.repeat(words.first[1:], n_shingles)) - 1
    starts, ends = at[words.starts[first_word]], at[words.ends[last_word] - 1] + 1
    one = xxhash.xxh64_intdigest
    return np.fromiter((one(text[a:b], 42) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts)), firsts


def fingerprints_of(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """The fingerprints of a batch of texts."""
    return majority_bits(*shingle_hashes(column, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (id, fingerprint as signed long) per row of docs, repeated rows and null ids too. A text without words
    gets 0, and so do null texts. Other columns are not read. An empty table gives none."""

    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.record_batch({"id": batch.column("id"), "fp": fingerprints_of(batch.column("text"), shingle).view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def distance(a, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


@dataclass
class Tree:
    """A vantage-point tree: per node its point, radius and children; a child below 0 is leaf ~child."""

    points: list[int] = field(default_factory=list)
    radii: list[int] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    leaves: int = 0

    def _grow(self, sample: np.ndarray, depth: int) -> int:
        if depth > 0 and len(sample) > 8:
            tried = sample[:: max(1, len(sample) // 6)][:6]
            spread = [distance(sample, p) for p in tried]
            best = int(np.argmax([d.std() for d in spread]))
            d = spread[best]
            radii = np.unique(d)[:-1]
            if len(radii):
                radius = int(min(radii, key=lambda r: abs(np.count_nonzero(d <= r) * 2 - len(d))))
                node = len(self.points)
                self.points.append(int(tried[best]))
                self.radii.append(radius)
                self.children.append((0, 0))
                self.children[node] = (self._grow(sample[d <= radius], depth - 1), self._grow(sample[d > radius], depth - 1))
                return node
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, fps: np.ndarray, reach: int, n: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(leaf, homes, visitors) as indexes of fps: each of the first ``n`` fingerprints (all, if not given) has one
        home, and of any two within reach that have different homes, exactly one side visits: the inner one visits
        outwards. The other fingerprints visit alone. A branch is left out where the triangle inequality excludes it."""
        n = len(fps) if n is None else n
        todo = [(0 if self.points else -1, np.arange(n), np.arange(n, len(fps)))]
        while todo:
            node, homes, visitors = todo.pop()
            if not len(homes) and not len(visitors):
                continue
            if node < 0:
                yield ~node, homes, visitors
                continue
            radius, point = self.radii[node], np.uint64(self.points[node])
            dh, dv = distance(fps[homes], point), distance(fps[visitors], point)
            inner, outer = self.children[node]
            todo.append((inner, homes[dh <= radius], visitors[dv <= radius + reach]))
            todo.append((outer, homes[dh > radius], np.r_[homes[(dh <= radius) & (dh > radius - reach)], visitors[dv > radius - reach]]))


def fit_tree(sample: np.ndarray, leaves: int) -> Tree:
    tree = Tree()
    root = tree._grow(np.sort(sample), max(0, int(leaves - 1).bit_length()))
    assert root <= 0
    return tree


def _union(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the sets of a[i] and b[i]; labels hold each member's smallest index and stay flat."""
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            return
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while (up := labels[labels]).tobytes() != labels.tobytes():
            labels[:] = up


def leaf_links(homes: np.ndarray, visitors: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links (as two arrays of fingerprints) among homes, and between homes and visitors.

    A leaf of many more homes than LEAF deals them once more by a tree of its own. In a small one all are ordered
    by their distance to the first home; only distances at most reach apart are compared.
    """
    every = np.r_[homes, visitors]
    if len(homes) > 4 * LEAF:
        tree = fit_tree(homes[:: -(-len(homes) // SAMPLE)], -(-len(homes) // LEAF))
        if tree.leaves > 1:
            parts = [leaf_links(every[h], every[v], reach) for _, h, v in tree.route(every, reach, len(homes)) if len(h)]
            a, b = (np.concatenate(x) for x in zip(*parts))
            return a, b
    labels = np.arange(len(every))
    d = distance(every, homes[0])
    order = np.argsort(d, kind="stable")
    sorted_d = d[order]
    by_home = np.argsort(d[: len(homes)], kind="stable")
    home_d = d[by_home]
    for value in np.unique(home_d).tolist():
        own = by_home[np.searchsorted(home_d, value) : np.searchsorted(home_d, value, "right")]
        near = order[np.searchsorted(sorted_d, value - reach) : np.searchsorted(sorted_d, value + reach, "right")]
        step = max(1, _CELLS // max(1, len(near)))
        for k in range(0, len(own), step):
            part = own[k : k + step]
            i, j = np.nonzero(np.bitwise_count(every[part][:, None] ^ every[near][None, :]) <= reach)
            _union(labels, part[i], near[j])
    linked = np.flatnonzero(labels != np.arange(len(every)))
    return every[linked], every[labels[linked]]


def near_duplicates(prints: DataFrame, reach: int = 2) -> DataFrame:
    """(id, fp, component_id) per row of prints (id, fp): component_id is the smallest id reachable over links
    between fingerprints that differ in at most ``reach`` bits, the row's own id included.

    Rows of one fingerprint are one class, counted before any search. A vantage-point tree fitted on a bounded
    sample of classes (at most SAMPLE) deals the classes to leaves; it alone goes to the tasks. A class has one
    home leaf and visits leaves beyond a boundary only within reach of it. Each leaf returns a spanning set of
    its links, at most one per class, so thousands of near copies make no pairs. The links of all leaves go to
    distributed connected components. A fingerprint that fills a third of the table joins back salted.

    Null ids are ignored by the minimum; a component of null ids only gets null. Repeated ids and rows each give
    their row. An empty table gives none.
    """
    spark = prints.sparkSession
    prints = materialise(prints, "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "classes")
    total = classes.count()
    picked = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").toPandas()["fp"].to_numpy(np.int64)
    tree = spark.sparkContext.broadcast(fit_tree(picked.view(np.uint64), -(-total // LEAF)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.asarray(batch.column("fp"))
            for leaf, homes, visitors in tree.value.route(fps.view(np.uint64), reach):
                at = np.r_[homes, visitors]
                yield pa.record_batch({"leaf": np.full(len(at), leaf, np.int32), "fp": fps[at], "home": np.arange(len(at)) < len(homes)})

    def search(table: pa.Table) -> pa.Table:
        fps, home = table.column("fp").to_numpy().view(np.uint64), table.column("home").to_numpy()
        a, b = leaf_links(np.sort(fps[home]), np.sort(fps[~home]), reach) if home.any() else (fps[:0], fps[:0])
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    links = classes.select("fp").mapInArrow(deal, "leaf int, fp long, home boolean").groupBy("leaf").applyInArrow(search, "a long, b long")
    nodes = components(links).withColumnRenamed("node", "fp")
    nodes = nodes.join(classes, "fp").select("fp", "root", "least")
    roots = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = nodes.join(roots, "root").select("fp", "component_id")
    facts = classes.join(linked, "fp", "left").filter("n > 1 OR component_id IS NOT NULL").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return attach(prints, facts, ["fp"], "id").select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def shingle_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    """The sorted 64-bit hashes of the distinct shingles of every text of a batch, in lower case A to Z; of fewer words
    than a shingle, that of the whole sequence."""
    data, offsets = utf8(column)
    words = words_of(_LOWER[data], offsets)
    n_words = np.diff(words.first)
    every = rolling(words.hashes, shingle, _SHINGLE)[within(words.first, len(words.hashes), shingle)]
    upto = np.r_[0, np.cumsum(np.maximum(n_words - shingle + 1, 0))].tolist()
    out = []
    for k, n in enumerate(n_words.tolist()):
        if n >= shingle:
            out.append(np.unique(every[upto[k] : upto[k + 1]]))
        else:
            out.append(rolling(words.hashes[words.first[k] : words.first[k + 1]], n, _SHINGLE) if n else every[:0])
    return out


def key_plan(rows: int, similarity: float) -> tuple[int, int]:
    """(bits of a key, number of keys) of a long fingerprint for a table of so many rows.

    Keys grow with the table so that about four rows share one. Their number follows from the chance that a key
    of a pair at the bound differs in at most one bit, so that all miss it with a chance of MISSED at every size.
    """
    bits = min(60, max(KEY_BITS, max(rows - 1, 1).bit_length() - 2))
    p = most_bits(similarity, 1 << 20) / (1 << 20)
    hit = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, math.ceil(math.log(MISSED) / math.log1p(-hit))


def long_prints_of(sets: list[np.ndarray], words: int) -> np.ndarray:
    """Fingerprints of words * 64 bits, one row a set of shingles."""
    h, firsts = np.concatenate([np.empty(0, np.uint64), *sets]), np.r_[0, np.cumsum([len(s) for s in sets], dtype=np.int64)]
    return np.stack([majority_bits(mix(h, seed), firsts) for seed in range(words)], 1)


def set_digest(own: np.ndarray) -> bytes:
    """A digest that equal sets of shingles share."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ``least`` or more, in whole numbers."""
    if min(len(a), len(b)) * least.denominator < least.numerator * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * least.denominator >= least.numerator * (len(a) + len(b) - both)


def keys_of(prints: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The keys of long fingerprints, one column a table."""
    own = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8).reshape(len(prints), prints.shape[1] * 8), axis=1, bitorder="little")
    own = own[:, : bits * tables].reshape(len(prints), tables, bits)
    keys = np.zeros((len(prints), tables), np.uint64)
    for k in range(bits):
        keys |= own[:, :, k].astype(np.uint64) << np.uint64(k)
    return keys


def most_bits(similarity: float, bits: int) -> int:
    """How many of ``bits`` fingerprint bits differ at a Jaccard similarity: the angle of the shingles' vectors,
    whose cosine is 2 J / (1 + J), over half a turn."""
    return int(bits * np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges that begin at ``starts``, on end."""
    return np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum()) if len(starts) else np.arange(0)


def _apart(table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many bits rows i and j of a table differ in, looked at _PAIRS at a time."""
    parts = (slice(k, k + _PAIRS) for k in range(0, len(i), _PAIRS))
    return np.concatenate([np.zeros(0, np.int64), *(np.bitwise_count(table[i[p]] ^ table[j[p]]).sum(1, dtype=np.int64) for p in parts)])


def _proposed(keys: np.ndarray, checks: np.ndarray, groups: np.ndarray, n: int, bits: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing check bits) of the pairs of one of the first n entries, the homes, and any entry of another
    group: keys within one bit, checks within ``most``. All pairs of a home come together.

    Entries are sorted by key and group; a home looks up its key and every key one bit away, and passes over the
    entries of its own group there.
    """
    _, groups, members = np.unique(groups, return_inverse=True, return_counts=True)
    order = np.lexsort((groups, keys))
    group = groups[order]
    distinct, start, rank = np.unique(keys[order], return_index=True, return_inverse=True)
    start, place = np.r_[start, len(order)], rank * np.int64(len(members)) + group
    edges = [(np.arange(len(distinct)), np.arange(len(distinct)))]
    for bit in range(bits):
        wanted = distinct ^ np.uint64(1 << bit)
        at = np.minimum(np.searchsorted(distinct, wanted), len(distinct) - 1)
        found = np.flatnonzero(distinct[at] == wanted)
        edges.append((found, at[found]))
    own, other = (np.concatenate(x) for x in zip(*edges))
    by_key = np.argsort(own, kind="stable")
    own, other = own[by_key], other[by_key]
    first_edge = np.searchsorted(own, np.arange(len(distinct) + 1))
    load = np.add.reduceat(start[other + 1] - start[other], first_edge[:-1])
    homes = np.flatnonzero(order < n)
    upto = np.cumsum(load[rank[homes]])
    k = 0
    while k < len(homes):
        end = max(k + 1, int(np.searchsorted(upto, (upto[k - 1] if k else 0) + _CELLS // 4, "right")))
        part, k = homes[k:end], end
        n_edges = first_edge[rank[part] + 1] - first_edge[rank[part]]
        home, key = np.repeat(part, n_edges), other[_ranges(first_edge[rank[part]], n_edges)]
        low, high = start[key], start[key + 1]
        mine = key * np.int64(len(members)) + group[home]
        low_own, high_own = low.copy(), low.copy()
        shared = members[group[home]] > 1
        low_own[shared], high_own[shared] = np.searchsorted(place, mine[shared]), np.searchsorted(place, mine[shared], "right")
        home, low, high = np.r_[home, home], np.r_[low, high_own], np.r_[low_own, high]
        i, j = order[np.repeat(home, high - low)], order[_ranges(low, high - low)]
        i, j = i[i != j], j[i != j]
        differ = _apart(checks, i, j)
        yield i[differ <= most], j[differ <= most], differ[differ <= most]


def _dense(keys: np.ndarray, checks: np.ndarray, n: int, most: int) -> np.ndarray:
    """Groups of entries that lie about one home: where more than DENSE entries share a key, the first home among
    them takes all entries within half of ``most`` check bits, any two of which lie within ``most``."""
    groups = np.arange(len(keys))
    distinct, first, count = np.unique(keys, return_index=True, return_counts=True)
    for key in distinct[(count > DENSE) & (first < n)]:
        free = groups == np.arange(len(keys))
        pivots = np.flatnonzero(free[:n] & (keys[:n] == key))
        if len(pivots):
            free = np.flatnonzero(free)
            near = free[np.bitwise_count(checks[free] ^ checks[pivots[0]]).sum(1, dtype=np.int64) <= most // 2]
            groups[near] = pivots[0]
    return groups


def similar_links(keys: np.ndarray, checks: np.ndarray, ids: np.ndarray, home: np.ndarray, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of links of a leaf: keys within one bit, checks within ``most``."""
    order = np.lexsort((ids, ~home))
    keys, checks, ids, n = keys[order], checks[order], ids[order], int(home.sum())
    labels, groups = np.arange(len(keys)), _dense(keys, checks, n, most)
    taken = np.flatnonzero(groups != labels)
    _union(labels, taken, groups[taken])
    for i, j, _ in _proposed(keys, checks, groups, n, bits, most):
        _union(labels, i, j)
    linked = np.flatnonzero(labels != np.arange(len(keys)))
    return ids[linked], ids[labels[linked]]


def sketch_of(own: np.ndarray) -> bytes:
    """The parities of a set's counts in buckets of its hashes, four buckets or more for each, up to 2 ** SKETCH."""
    buckets = 1 << min(SKETCH, max(6, (4 * len(own) - 1).bit_length()))
    at = (mix(own, 0) & np.uint64(buckets - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=buckets) & 1).astype(np.uint8), bitorder="little").tobytes()


class Sketches:
    """Sketches of sets, and a lower bound of how many hashes two of them don't share: each such hash turns one parity. A
    longer sketch is folded to the length of the other."""

    def __init__(self, sketches: list[bytes]):
        own = [np.frombuffer(x, np.uint64) for x in sketches]
        self.level = np.array([len(x).bit_length() - 1 for x in own], np.int64)
        self.folded: dict[int, np.ndarray] = {}
        top = int(self.level.max(initial=0))
        table = np.zeros((len(own), 1 << top), np.uint64)
        for level in range(top, -1, -1):
            if level < top:
                table = table[:, : 1 << level] ^ table[:, 1 << level :]
            for k in np.flatnonzero(self.level == level).tolist():
                table[k] = own[k]
            self.folded[level] = table

    def least_apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        level = np.minimum(self.level[i], self.level[j])
        out = np.zeros(len(i), np.int64)
        for own in np.unique(level).tolist():
            at, table = np.flatnonzero(level == own), self.folded[own]
            for k in range(0, len(at), _PAIRS):
                part = at[k : k + _PAIRS]
                out[part] = _apart(table, i[part], j[part])
        return out


def _first_met(keys: np.ndarray, i: np.ndarray, j: np.ndarray, table: int) -> np.ndarray:
    """Whether no table before this one has keys of i and j within one bit."""
    out = np.ones(len(i), bool)
    for k in range(0, len(i) if table else 0, _PAIRS):
        part = slice(k, k + _PAIRS)
        out[part] = (np.bitwise_count(keys[i[part], :table] ^ keys[j[part], :table]) > 1).all(1)
    return out


def links_between_parts(every: np.ndarray, table: int, checks: np.ndarray, ids: np.ndarray, parts: np.ndarray, home: np.ndarray, sizes: np.ndarray, sketches: list[bytes], bits: int, most: int, per: int, least: Fraction) -> tuple[np.ndarray, np.ndarray, bool]:
    """The proposed pairs of a leaf whose parts differ, of every home the ``per`` nearest by their checks, and
    whether some were left for later. ``every`` has the keys of all tables, of which the leaf belongs to one.

    A pair that several tables propose is left to the first of them, and one whose sketches prove it to be below
    ``least`` to none: sets of m and n hashes that similar don't share at most (m + n)(1 - least)/(1 + least) of them.
    """
    order = np.lexsort((ids, ~home))
    every, checks, ids, parts, sizes, n = every[order], checks[order], ids[order], parts[order], sizes[order], int(home.sum())
    of = Sketches([sketches[k] for k in order.tolist()])
    found, more = [(ids[:0], ids[:0])], False
    for i, j, differ in _proposed(every[:, table], checks, parts, n, bits, most):
        near = of.least_apart(i, j) * (least.denominator + least.numerator) <= (sizes[i] + sizes[j]) * (least.denominator - least.numerator)
        i, j, differ = i[near], j[near], differ[near]
        first = _first_met(every, i, j, table)
        i, j, differ = i[first], j[first], differ[first]
        order = np.lexsort((ids[j], differ, i))
        i, j = i[order], j[order]
        nth = np.arange(len(i)) - np.searchsorted(i, i)
        more = more or bool((nth >= per).any())
        found.append((ids[i[nth < per]], ids[j[nth < per]]))
    a, b = (np.concatenate(x) for x in zip(*found))
    once = np.unique(np.c_[np.maximum(a, b), np.minimum(a, b)], axis=0)  # two homes of one leaf find each other
    return once[:, 0], once[:, 1], more


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, ok) per pair of classes (a, b): whether their sets of shingles are as similar as asked. Both sides
    are fetched by salted joins, so a class in many pairs is spread."""
    least = Fraction(str(similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = ((np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column("set_a"), batch.column("set_b")))
            yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"), "ok": pa.array([similar(x, y, least) for x, y in of], pa.bool_())})

    both = attach(pairs, sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b")), ["b"], "a")
    both = attach(both, sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a")), ["a"], "b")
    return materialise(both.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long, ok boolean"), "confirmed")


def _relabelled(parts: DataFrame, tested: DataFrame) -> DataFrame:
    """(node, part) with the parts that confirmed links (a, b, ok) between them join, under the smallest of their numbers."""
    roots = components(tested.filter("ok")).select(F.col("node").alias("part"), "root")
    return attach(parts, roots, ["part"], "node").select("node", F.coalesce("root", "part").alias("part"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, text_sha256, component_id) per row of docs with an id: component_id is the smallest id reachable over
    links of texts whose distinct shingles have a Jaccard similarity of ``similarity`` or more.

    Texts of equal sets of shingles are one class, by a 128-bit digest of the set, and classes are numbered once, as
    they are written, so no two of them share a number. Fingerprints only propose pairs of classes. At such similarities they differ in too many bits for a vantage-point tree to prune, so a
    class has a long fingerprint of its distinct shingles: keys (see ``key_plan``) that are looked up within one
    bit, each in a tree of its own, and CHECK bits that drop pairs far below the bound. By calculation a pair at
    0.8 is proposed with a probability of 0.996 or more (sets of 6 shingles or more; sets of 5 meet their subsets
    of 4 by digest, always). A lower ``similarity`` takes more keys.

    Every link is confirmed on the sorted hashes of both sets. First each leaf proposes spanning links. Groups
    that these confirm whole are settled; in the others all pairs between parts that are not yet linked are
    proposed, of every class the nearest first and eight times as many a round, until none is left, but for pairs
    that sketches of both sets prove to lie below the bound. Each is proposed by one table alone. So a large
    group of near copies makes few pairs, and no link hangs on a pair that was turned down.

    Rows without an id are left out. Null texts count as empty, and texts without words are one class. Repeated
    rows each give their row. Other columns are not read. An empty table gives none.
    """
    spark = docs.sparkSession
    small_batches(spark)
    most, least = most_bits(similarity, CHECK) + SLACK, Fraction(str(similarity))
    text = F.col(text_col).cast("string")
    rows = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text.alias("text"), _text_sha256(text).alias("text_sha256"))
    bits, tables = key_plan(docs.count(), similarity)
    words = -(-(bits * tables + CHECK) // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingle_sets(batch.column("text"), shingle)
            prints = pa.array([p.tobytes() for p in long_prints_of(sets, words)], pa.binary())
            less = pa.array([[set_digest(np.delete(s, k)) for k in range(5)] if len(s) == 5 else [] for s in sets], pa.list_(pa.binary()))
            yield pa.record_batch({"id": batch.column("id"), "text_sha256": batch.column("text_sha256"), "digest": pa.array([set_digest(s) for s in sets], pa.binary()), "fp": prints, "less": less})

    prints = materialise(rows.mapInArrow(run, "id long, text_sha256 binary, digest binary, fp binary, less array<binary>"), "prints")
    of_class = F.struct("id", "text_sha256")
    classes = prints.groupBy("digest").agg(F.min("id").alias("least"), F.min(of_class).alias("row"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("less").alias("less"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    if not total:
        return prints.select("id", "text_sha256", F.col("id").alias("component_id"))
    picked = classes.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE // 4).select("fp").toPandas()["fp"]
    sample = keys_of(np.frombuffer(b"".join(picked), np.uint64).reshape(-1, words), bits, tables)
    del picked
    trees = spark.sparkContext.broadcast([fit_tree(sample[:, t], -(-total // LONG_LEAF)) for t in range(tables)])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "fp"):
            prints = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint64).reshape(-1, words)
            every = keys_of(prints, bits, tables)
            checks = np.ascontiguousarray(prints[:, -CHECK // 64 :]).view(f"V{CHECK // 8}")[:, 0]
            for t, tree in enumerate(trees.value):
                for leaf, homes, visitors in tree.route(every[:, t], 1):
                    at = np.r_[homes, visitors]
                    some = batch.select([c for c in batch.schema.names if c != "fp"]).take(pa.array(at))
                    yield pa.record_batch({"leaf": np.full(len(at), t << 32 | leaf, np.int64), "key": every[at, t].astype(np.int64), **dict(zip(some.schema.names, some.columns)), "home": np.arange(len(at)) < len(homes), "checks": pa.FixedSizeBinaryArray.from_buffers(pa.binary(CHECK // 8), len(at), [None, pa.py_buffer(checks[at].tobytes())]).cast(pa.binary())})

    def arrays(table: pa.Table, *names: str) -> list[np.ndarray]:
        return [table.column(c).to_numpy() for c in names]

    del sample
    release(spark)

    def checks_of(table: pa.Table) -> np.ndarray:
        column = table.column("checks").cast(pa.binary(CHECK // 8)).combine_chunks()
        return np.frombuffer(column.buffers()[1], np.uint64, len(column) * CHECK // 64, column.offset * CHECK // 8).reshape(-1, CHECK // 64)

    def spanning(table: pa.Table) -> pa.Table:
        key, node, home = arrays(table, "key", "node", "home")
        a, b = similar_links(key.astype(np.uint64), checks_of(table), node, home, bits, most)
        trim()
        return pa.table({"a": a, "b": b})

    def between(nodes: DataFrame, per: int) -> DataFrame:
        """(a, b, more) for nodes (fp, node, part, n, sketch): of every home at most ``per`` links between parts."""

        def search(table: pa.Table) -> pa.Table:
            leaf, node, part, home, n = arrays(table, "leaf", "node", "part", "home", "n")
            every = keys_of(np.frombuffer(b"".join(table.column("print").to_pylist()), np.uint64).reshape(-1, words), bits, tables)
            a, b, more = links_between_parts(every, int(leaf[0]) >> 32, checks_of(table), node, part, home, n, table.column("sketch").to_pylist(), bits, most, per, least)
            trim()
            return pa.table({"a": a, "b": b, "more": np.full(len(a), more)})

        dealt = nodes.withColumn("print", F.col("fp")).mapInArrow(deal, "leaf long, key long, node long, part long, n long, sketch binary, print binary, home boolean, checks binary")
        return dealt.groupBy("leaf").applyInArrow(search, "a long, b long, more boolean")

    subsets = classes.select(F.explode("less").alias("digest"), F.col("node").alias("_of")).join(classes.select("digest", "node"), "digest")
    dealt = classes.select("fp", "node").mapInArrow(deal, "leaf long, key long, node long, home boolean, checks binary")
    links = dealt.groupBy("leaf").applyInArrow(spanning, "a long, b long").union(subsets.select(F.col("_of").alias("a"), F.col("node").alias("b")))
    links = materialise(links.filter("a <> b").distinct(), "links")
    loose = materialise(components(links).withColumnRenamed("root", "loose"), "loose")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = shingle_sets(batch.column("text"), shingle)
            yield pa.record_batch({"node": batch.column("node"), "hashes": pa.array([s.tobytes() for s in own], pa.binary()), "n": pa.array([len(s) for s in own], pa.int64()), "sketch": pa.array([sketch_of(s) for s in own], pa.binary())})

    wanted = loose.join(classes.select("node", "row"), "node").select("node", F.col("row.id").alias("id"), F.col("row.text_sha256").alias("text_sha256"))
    sets = rows.join(wanted, ["id", "text_sha256"]).select("node", "text").dropDuplicates(["node"])
    sets = materialise(sets.mapInArrow(hashed, "node long, hashes binary, n long, sketch binary"), "sets")

    tested, per, more = _confirmed(links, sets, similarity), 16, True
    parts = materialise(_relabelled(loose.select("node", F.col("node").alias("part")), tested), "parts")
    while more:
        members = loose.join(parts, "node")
        unsettled = members.groupBy("loose").agg(F.min("part").alias("_low"), F.max("part").alias("_high"), F.count("*").alias("_n")).filter("_low < _high AND _n > 2")
        unsettled = materialise(attach(members, unsettled, ["loose"], "node").filter("_n IS NOT NULL").select("node", "part"), "unsettled")
        if unsettled.isEmpty():
            break
        facts = classes.select("fp", "node").join(unsettled, "node").join(sets.select("node", "n", "sketch"), "node")
        found = materialise(between(facts.select("fp", "node", "part", "n", "sketch"), per), "proposed")
        new = materialise(found.select("a", "b").join(tested.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti"), "links")
        more, per = not found.filter("more").isEmpty(), per * 8
        if not new.isEmpty():
            ends = _confirmed(new, sets, similarity)
            tested = materialise(tested.union(ends), "tested")
            for end in ("a", "b"):  # links between parts, of which there are few, instead of links between classes
                ends = attach(ends.filter("ok"), unsettled.select(F.col("node").alias(end), F.col("part").alias(f"part_{end}")), [end], "b" if end == "a" else "a")
            parts = materialise(_relabelled(parts, ends.select(F.col("part_a").alias("a"), F.col("part_b").alias("b"), "ok")), "parts")

    release(spark)
    nodes = classes.select("digest", "node", "least", "n").join(parts, "node", "left")
    roots = nodes.filter("part IS NOT NULL").groupBy("part").agg(F.min("least").alias("_least"))
    nodes = attach(nodes, roots, ["part"], "node")
    facts = nodes.filter("n > 1 OR part IS NOT NULL").select("digest", F.coalesce("_least", "least").alias("component_id"))
    return attach(prints.select("id", "text_sha256", "digest"), facts, ["digest"], "id").select("id", "text_sha256", F.coalesce("component_id", "id").alias("component_id"))


def _text_sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs in their own columns with one row of each group of ``similar_groups``: the one with the smallest id.

    Rows are named by id and text digest, so another text under a removed row's id stays. Rows that repeat the
    smallest id all stay; rows with a null id stay. Texts without words are one group. An empty table gives none.
    """
    gone = similar_groups(docs, id_col, text_col, shingle, similarity).filter("component_id <> id").select(F.col("id").alias("_gone"), F.col("text_sha256").alias("_gone_text")).distinct()
    return docs.join(gone, (docs[id_col] == gone["_gone"]) & (_text_sha256(docs[text_col].cast("string")) == gone["_gone_text"]), "left_anti")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents: 3-word shingles, links at two or fewer differing bits."""
    found = near_duplicates(fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


SQL: dict[str, str] = {}
QUERIES = {"op5_simhash": op5_simhash}
