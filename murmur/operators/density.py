"""Density clusters of each recording's vectors: core distances, a tree of mutual reachability, and the clusters that last.

A recording's vectors are dealt in blocks; distances are looked at by pairs of blocks, one pair a row, and only what a pair
finds leaves it. So a long recording is many tasks, and no task holds more than two blocks, or the edges of one tree.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block, about: blocks are dealt by the hash of the vectors' ids.
BLOCK = 256
#: A distance that is no distance: weights below are taken as this.
LEAST = 1e-12


def blocks(vectors: DataFrame, recording: str, vec_id: str, vector: str, block: int = BLOCK) -> DataFrame:
    """(rec, block, n_blocks, items): a recording's vectors (id, v) in blocks of about ``block``; null ids and null or empty
    vectors are left out, of a repeated id one stays."""
    rows = vectors.select(F.col(recording).alias("rec"), F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("rec IS NOT NULL AND id IS NOT NULL AND size(v) > 0")
    rows = rows.groupBy("rec", "id").agg(F.min("v").alias("v"))
    sizes = rows.groupBy("rec").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    dealt = rows.join(sizes, "rec").withColumn("block", F.pmod(F.xxhash64("id"), F.col("n_blocks")).cast("int"))
    return dealt.groupBy("rec", "block", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("items"))


def block_pairs(held: DataFrame) -> DataFrame:
    """(rec, a, b, items, others): each block with itself and with every later block of its recording. The earlier one is
    repeated by the number of the later, so the pairs of one recording are spread over all tasks."""
    first = held.withColumn("b", F.explode(F.sequence("block", F.col("n_blocks") - 1))).select("rec", F.col("block").alias("a"), "b", "items")
    return first.join(held.select("rec", F.col("block").alias("b"), F.col("items").alias("others")), ["rec", "b"])


def distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Cosine or euclidean distances of rows, to nine places, so that they don't depend on the block that a row is in."""
    if metric == "cosine":
        x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), LEAST) for v in (x, y))
        return np.round(np.maximum(1 - x @ y.T, 0), 9)
    return np.round(np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T, 0)), 9)


def _items(items) -> tuple[np.ndarray, np.ndarray]:
    return np.array([r["id"] for r in items], np.int64), np.array([r["v"] for r in items], float)


def _by_pair(pairs: DataFrame, of, schema: str) -> DataFrame:
    """The rows that ``of`` finds for each pair of blocks."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples(index=False):
                yield of(row)

    return pairs.mapInPandas(run, schema)


def nearest(vectors: DataFrame, recording: str, k: int, vec_id: str = "vec_id", vector: str = "embedding", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(rec, id, place, other, distance): the k nearest other vectors of each vector of a recording, from place 1, nearer ids
    first on a tie. A pair of blocks gives the k nearest within it; of these, k a block, the k nearest stay.

    Vectors without an id or a recording, and null or empty ones, have no neighbours; of a repeated id one vector counts. Ids
    and recordings are named rec and id, whatever their columns' names. An empty table gives none.
    """
    kind = vectors.schema[recording].dataType.simpleString()

    def of(row) -> pd.DataFrame:
        (ids, x), (others, y) = _items(row.items), _items(row.others)
        d = distances(x, y, metric)
        sides = [(ids, others, d)] if row.a == row.b else [(ids, others, d), (others, ids, d.T)]
        found = []
        for own, far, m in sides:
            if row.a == row.b:
                m = np.where(np.eye(len(own), dtype=bool), np.inf, m)
            order = np.lexsort((np.broadcast_to(far, m.shape), m))[:, :k] if m.size else np.zeros((len(own), 0), int)
            near = np.take_along_axis(m, order, 1)
            ok = np.isfinite(near)
            found.append(pd.DataFrame({"rec": row.rec, "id": np.repeat(own, ok.sum(1)), "other": far[order][ok], "distance": near[ok]}))
        return pd.concat(found)

    found = _by_pair(block_pairs(blocks(vectors, recording, vec_id, vector, block)), of, f"rec {kind}, id long, other long, distance double")
    best = F.slice(F.sort_array(F.collect_list(F.struct("distance", "other"))), 1, k)
    return found.groupBy("rec", "id").agg(best.alias("best")).select("rec", "id", F.posexplode("best").alias("place", "x")).select("rec", "id", (F.col("place") + 1).alias("place"), "x.other", "x.distance")


def core_distances(vectors: DataFrame, recording: str, k: int = 3, vec_id: str = "vec_id", vector: str = "embedding", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(rec, id, core): the distance of each vector to its k-th nearest other one, the farthest where there are fewer. A
    vector that is alone has none and is left out."""
    return nearest(vectors, recording, k, vec_id, vector, metric, block).groupBy("rec", "id").agg(F.max("distance").alias("core"))


def spanning_tree(weights: np.ndarray) -> list[tuple[int, int]]:
    """The edges of a minimum spanning tree of a full graph, grown from the first node."""
    n = len(weights)
    best, source = weights[0].copy(), np.zeros(n, int)
    best[0] = np.inf
    inside, out = np.zeros(n, bool), []
    inside[0] = True
    for _ in range(n - 1):
        new = int(np.argmin(best))
        out.append((int(source[new]), new))
        inside[new] = True
        nearer = (weights[new] < best) & ~inside
        best[nearer], source[nearer] = weights[new][nearer], new
        best[new] = np.inf
    return out


class Joined:
    """Sets that are joined two by two."""

    def __init__(self, n: int):
        self.of = list(range(n))

    def root(self, x: int) -> int:
        while self.of[x] != x:
            self.of[x] = x = self.of[self.of[x]]
        return x


def reachability_tree(vectors: DataFrame, recording: str, k: int = 3, vec_id: str = "vec_id", vector: str = "embedding", metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(rec, a, b, weight): a minimum spanning tree of each recording's mutual reachability, the largest of two vectors'
    distance and their core distances; a < b.

    A tree of all vectors lies within the trees of the pairs of blocks, so a pair gives the edges of its own tree, one a
    vector, and of a recording's edges the lightest that close no circle stay, in one pass over them in order (ties: by the
    ids). A vector that is alone, and an empty table, give no edge.
    """
    kind = vectors.schema[recording].dataType.simpleString()
    held = blocks(vectors, recording, vec_id, vector, block)
    cores = core_distances(vectors, recording, k, vec_id, vector, metric, block)
    cored = held.select("rec", "block", "n_blocks", F.explode("items").alias("x")).select("rec", "block", "n_blocks", F.col("x.id").alias("id"), F.col("x.v").alias("v")).join(cores, ["rec", "id"])
    cored = cored.groupBy("rec", "block", "n_blocks").agg(F.sort_array(F.collect_list(F.struct("id", "v", "core"))).alias("items"))

    def of(row) -> pd.DataFrame:
        rows = list(row.items) + (list(row.others) if row.a != row.b else [])
        rows.sort(key=lambda r: r["id"])
        ids, x = _items(rows)
        core = np.array([r["core"] for r in rows])
        w = np.maximum(distances(x, x, metric), np.maximum(core[:, None], core))
        np.fill_diagonal(w, np.inf)
        edges = [(*sorted((int(ids[a]), int(ids[b]))), float(w[a, b])) for a, b in spanning_tree(w)]
        return pd.DataFrame([(row.rec, *e) for e in edges], columns=["rec", "a", "b", "weight"])

    def lightest(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["a", "b"]).sort_values(["weight", "a", "b"])
        ids, ends = np.unique(part[["a", "b"]].to_numpy(), return_inverse=True)
        sets, keep = Joined(len(ids)), []
        for a, b in ends.reshape(-1, 2).tolist():
            x, y = sets.root(a), sets.root(b)
            keep.append(x != y)
            sets.of[max(x, y)] = min(x, y)
        return part[keep]

    edges = _by_pair(block_pairs(cored), of, f"rec {kind}, a long, b long, weight double")
    return edges.groupBy("rec").applyInPandas(lightest, f"rec {kind}, a long, b long, weight double")


def lasting(a: np.ndarray, b: np.ndarray, weight: np.ndarray, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(ids, labels) of a tree's nodes: the clusters of at least ``least`` nodes that last longest while edges are taken away
    from the heaviest on; -1 for nodes of none. Clusters are numbered by their smallest id.

    Edges of one weight go at once. A cluster begins where its parent falls into two parts or more of at least ``least``; smaller
    parts fall off, and so does what is left without such a part. It lasts for the sum over its nodes of how far 1 / weight moves on before they leave. From the leaves up, a
    cluster is taken if it lasts as long as the best of what it falls into; all nodes together are no cluster.
    """
    ids, ends = np.unique(np.stack([a, b], 1), return_inverse=True)
    ends, n = ends.reshape(-1, 2), len(ids)
    order = np.argsort(weight, kind="stable")
    sets, node, size = Joined(n), list(range(n)), [1] * n
    parts: list[list[int]] = []  # of node n + k, whose parts are joined at levels[k]
    levels: list[float] = []
    for group in np.split(order, np.flatnonzero(np.diff(weight[order])) + 1):  # edges of one weight are taken away at once
        touched = dict.fromkeys(sets.root(x) for x in ends[group].ravel().tolist())
        for x, y in ends[group].tolist():
            x, y = sets.root(x), sets.root(y)
            sets.of[max(x, y)] = min(x, y)
        made: dict[int, list[int]] = {}
        for x in touched:
            made.setdefault(sets.root(x), []).append(node[x])
        for x, own in made.items():
            node[x] = len(size)
            parts.append(own)
            size.append(sum(size[p] for p in own))
            levels.append(1 / max(float(weight[group[0]]), LEAST))
    parent, born, lasts, left = [-1], [0.0], [0.0], np.zeros(n, int)  # clusters; left: the cluster that a node leaves

    def leaves(top: int) -> list[int]:
        found, todo = [], [top]
        while todo:
            at = todo.pop()
            if at < n:
                found.append(at)
            else:
                todo += parts[at - n]
        return found

    todo = [(len(size) - 1, 0)]
    while todo:
        at, cluster = todo.pop()
        level, big = levels[at - n], [x for x in parts[at - n] if size[x] >= least]
        for x in parts[at - n]:
            if len(big) > 1 and size[x] >= least:
                parent.append(cluster)
                born.append(level)
                lasts.append(0.0)
            if size[x] >= least and x >= n:
                todo.append((x, len(parent) - 1 if len(big) > 1 else cluster))
            else:
                left[leaves(x)] = len(parent) - 1 if len(big) > 1 and size[x] >= least else cluster
            if len(big) > 1 or size[x] < least or x < n:
                lasts[cluster] += size[x] * (level - born[cluster])
    below, taken = [0.0] * len(parent), [False] * len(parent)
    for c in range(len(parent) - 1, 0, -1):
        taken[c] = below[c] <= lasts[c]
        below[parent[c]] += max(lasts[c], below[c])
    label = [-1] * len(parent)
    for c in range(1, len(parent)):
        label[c] = label[parent[c]] if label[parent[c]] >= 0 else c if taken[c] else -1
    of = np.array(label)[left]
    number = {c: k for k, c in enumerate(dict.fromkeys(of[of >= 0].tolist()))}
    return ids, np.array([number.get(c, -1) for c in of.tolist()])


def density_clusters(vectors: DataFrame, recording: str, vec_id: str = "vec_id", vector: str = "embedding", least: int = 3, metric: str = "cosine", block: int = BLOCK) -> DataFrame:
    """(rec, id, label): the clusters of each recording's vectors that ``lasting`` finds in its ``reachability_tree``, -1 for
    vectors of none. A recording's tree, an edge of 24 bytes a vector, is read in one task. A vector that is alone in its
    recording has no edge and no row."""
    kind = vectors.schema[recording].dataType.simpleString()

    def of(part: pd.DataFrame) -> pd.DataFrame:
        ids, labels = lasting(part["a"].to_numpy(), part["b"].to_numpy(), part["weight"].to_numpy(), least)
        return pd.DataFrame({"rec": part["rec"].iloc[0], "id": ids, "label": labels})

    return reachability_tree(vectors, recording, least, vec_id, vector, metric, block).groupBy("rec").applyInPandas(of, f"rec {kind}, id long, label long")
