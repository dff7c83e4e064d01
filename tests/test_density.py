"""Density clusters and layouts against brute force, on vectors with nulls, repeats and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmur.operators import density, embeddings, layout

VECTORS = "rec string, vec_id long, embedding array<double>"


def speakers(seed=1, n=90, kinds=3, size=8, noise=0.05, odd=4):
    r = np.random.default_rng(seed)
    base = np.eye(kinds, size)
    return np.array([base[k % kinds] + r.normal(0, noise, size) for k in range(n)] + [r.normal(0, 1, size) for _ in range(odd)])


def reachability(x, k=3):
    d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
    core = np.sort(d, 1)[:, k]
    return np.maximum(d, np.maximum(core[:, None], core))


def clusters_by_brute_force(w, least=3):
    """Labels from the definition: components of the whole graph below each level, from the top."""
    n = len(w)

    def components(nodes, below):
        left, out = set(nodes), []
        while left:
            todo, found = [left.pop()], set()
            while todo:
                a = todo.pop()
                found.add(a)
                near = {b for b in left if w[a, b] < below}
                left -= near
                todo += near
            out.append(sorted(found))
        return out

    def level_of(nodes):
        """The least weight that keeps the nodes in one component."""
        levels = sorted({w[a, b] for a in nodes for b in nodes if a < b})
        low, high = 0, len(levels) - 1
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if len(components(nodes, np.nextafter(levels[middle], 9e9))) == 1 else (middle + 1, high)
        return levels[low]

    def lasting(nodes, born, is_root):
        """(how long the best choice lasts, its clusters) for a cluster that begins with these nodes."""
        lasts, now = 0.0, nodes
        while True:
            level = level_of(now)
            parts = components(now, level)
            big = [p for p in parts if len(p) >= least]
            if len(big) >= 2:
                lasts += len(now) * (1 / level - born)
                below = [lasting(p, 1 / level, False) for p in big]
                total = sum(x for x, _ in below)
                chosen = [c for _, found in below for c in found]
                return (lasts, [nodes]) if not is_root and lasts >= total else (total, chosen)
            lasts += (len(now) - (len(big[0]) if big else 0)) * (1 / level - born)
            if not big:
                return lasts, [] if is_root else [nodes]
            now = big[0]

    label = np.full(n, -1)
    for k, nodes in enumerate(sorted(lasting(list(range(n)), 0.0, True)[1])):
        label[nodes] = k
    return label


@pytest.mark.parametrize("seed", range(8))
def test_lasting_clusters_by_brute_force(seed):
    x = speakers(seed, n=36, noise=0.05 + 0.07 * seed)
    w = reachability(x)
    full = w.copy()
    np.fill_diagonal(full, np.inf)
    edges = density.spanning_tree(full)
    a, b = (np.array([e[k] for e in edges]) for k in (0, 1))
    ids, labels = density.lasting(a, b, full[a, b])
    assert ids.tolist() == list(range(len(x)))
    assert labels.tolist() == clusters_by_brute_force(w).tolist()


def frame(spark, groups):
    rows = [(rec, 1000 * n + k, v.tolist()) for n, (rec, x) in enumerate(groups.items()) for k, v in enumerate(x)]
    return spark.createDataFrame(rows + [rows[0], (None, 5, [1.0] * 8), ("a", None, [1.0] * 8), ("a", 999_999, None)], VECTORS).withColumns({"id": F.lit(1), "block": F.lit(2), "rec_": F.lit(3), "weight": F.lit("x"), "found": F.lit(0)})


@pytest.mark.parametrize("block", [7, 256])
def test_neighbours_and_trees_in_blocks(spark, block):
    groups = {"a": speakers(3, 60), "b": np.repeat(speakers(4, 5, odd=0), 3, axis=0), "c": speakers(5, 1, odd=0)}
    df = frame(spark, groups)
    near = density.nearest(df, "rec", 4, metric="euclidean", block=block).collect()
    tree = density.reachability_tree(df, "rec", metric="euclidean", block=block).collect()
    labels = density.density_clusters(df, "rec", metric="euclidean", block=block).collect()
    for n, (rec, x) in enumerate(groups.items()):
        d = np.sqrt(((x[:, None] - x) ** 2).sum(2))
        np.fill_diagonal(d, np.inf)
        got = {}
        for r in near:
            if r["rec"] == rec:
                got.setdefault(r["id"] - 1000 * n, []).append((r["place"], r["distance"]))
        assert all(np.allclose([v for _, v in sorted(got.get(k, []))], np.sort(d[k])[: min(4, len(x) - 1)], atol=1e-6) for k in range(len(x)))
        if len(x) == 1:
            assert not any(r["rec"] == rec for r in [*tree, *labels])
            continue
        w = reachability(x)
        np.fill_diagonal(w, np.inf)
        best = sum(w[a, b] for a, b in density.spanning_tree(w))
        mine = [r for r in tree if r["rec"] == rec]
        assert len(mine) == len(x) - 1 and abs(sum(r["weight"] for r in mine) - best) < 1e-5
        if rec == "a":
            assert [r["label"] for r in sorted(labels, key=lambda r: r["id"]) if r["rec"] == rec] == clusters_by_brute_force(reachability(x)).tolist()


def test_silhouettes_by_brute_force(spark):
    x = speakers(6, 30)
    of = [k % 4 if k else 9 for k in range(len(x))]
    rows = [("a", of[k], v.tolist()) for k, v in enumerate(x)] + [("one", 1, [1.0, 0.0])] * 3
    got = {r["rec"]: (r["n"], r["silhouette"]) for r in embeddings.silhouettes(spark.createDataFrame(rows, "rec string, label long, embedding array<double>"), "rec").collect()}
    assert got["one"] == (3, 0.0) and got["a"][0] == len(x) and abs(got["a"][1] - embeddings.silhouette(x, np.unique(of, return_inverse=True)[1])) < 1e-6


def test_layout_keeps_neighbours_and_is_the_same_every_time(spark):
    groups = {"a": speakers(7, 90, noise=0.15), "b": speakers(8, 40), "c": speakers(9, 3, odd=0), "d": speakers(9, 1, odd=0)}
    df = frame(spark, groups)
    places = layout.layout(df, "rec").cache()
    again = layout.layout(df.repartition(3), "rec", block=11)
    as_rows = lambda p: sorted((r["rec"], r["vec_id"], tuple(r["embedding"])) for r in p.collect())
    assert as_rows(places) == as_rows(again)
    assert {r["rec"]: len(r["embedding"]) for r in places.collect()} == {"a": 32, "b": 32, "c": 1}
    kept = {r["rec"]: r["kept"] for r in layout.kept_neighbours(df, places, "rec").collect()}
    assert kept["a"] > 0.4 and kept["b"] > 0.4 and kept["c"] == 1.0  # chance: 0.05 and 0.11


def test_memberships_add_up():
    d = np.sort(np.random.default_rng(2).uniform(0.1, 1, (20, 4)), 1)
    near, width = layout.widths(d, 2.0)
    assert np.allclose(np.exp(-np.maximum(d - near[:, None], 0) / width[:, None]).sum(1), 2.0, atol=1e-3)
    near, width = layout.widths(np.array([[0.0, 0.0, 0.0, 0.0], [0.5, np.inf, np.inf, np.inf]]), 2.0)
    assert near.tolist() == [0.0, 0.5] and (width > 0).all()


def test_speakers_of_an_unknown_number(spark):
    r = np.random.default_rng(11)
    groups = {"three": speakers(10, 90, odd=0), "two": speakers(11, 60, kinds=2, odd=0), "one": np.eye(1, 8) + r.normal(0, 0.3, (40, 8)), "pair": np.eye(2, 8), "single": np.eye(1, 8)}
    got = embeddings.cluster_speakers(frame(spark, groups), "rec").collect()
    assert len(got) == sum(map(len, groups.values()))
    for n, (rec, x) in enumerate(groups.items()):
        of = {q["vec_id"] - 1000 * n: q["speaker"] for q in got if q["rec"] == rec}
        kinds = {"three": 3, "two": 2}.get(rec, 1)
        if rec in ("three", "two"):
            assert len({v for v in of.values() if v >= 0}) == kinds and all(of[k] in (-1, of[k % kinds]) for k in of)
            assert sum(v < 0 for v in of.values()) <= len(x) // 10
        else:
            assert set(of.values()) == {0} or rec == "one"


def test_density_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    for out in (density.nearest(empty, "rec", 3), density.density_clusters(empty, "rec"), layout.layout(empty, "rec"), embeddings.dense_speakers(empty, "rec"), embeddings.silhouettes(empty.withColumn("label", F.lit(1)), "rec")):
        assert out.count() == 0
