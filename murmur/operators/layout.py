"""A low-dimensional layout of each recording's vectors: a fuzzy graph of their neighbours, laid out from a seed."""

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from murmur.operators.density import BLOCK, nearest

#: Forces of the layout for a least distance of 0.1 and a spread of 1: a curve 1 / (1 + FORCE d^(2 SHAPE)).
FORCE, SHAPE = 1.577, 0.895
#: Rounds of the layout, and of the iteration that it starts from; random partners of a vector in a round.
ROUNDS, STARTS, PARTNERS = 200, 60, 5


def widths(distances: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, width) of rows of ascending distances, infinite where there are none: with that width the memberships
    exp(-(d - nearest) / width) of a row add up to ``wanted``, by halving. nearest is the least distance that isn't 0."""
    real = np.isfinite(distances)
    near = np.where((distances > 0) & real, distances, np.inf).min(1)
    near = np.where(np.isfinite(near), near, 0.0)
    beyond = np.where(real, np.maximum(distances - near[:, None], 0), np.inf)
    low, high, width = np.zeros(len(near)), np.full(len(near), np.inf), np.ones(len(near))
    for _ in range(64):
        more = np.exp(-beyond / width[:, None]).sum(1) < wanted
        low, high = np.where(more, width, low), np.where(more, high, width)
        width = np.where(np.isfinite(high), (low + high) / 2, 2 * width)
    mean = np.where(real, distances, 0).sum(1) / np.maximum(real.sum(1), 1)
    return near, np.clip(width, 1e-3 * np.maximum(mean, 1e-12), 1e6)


def fuzzy_graph(vectors: DataFrame, recording: str, neighbours: int = 5, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(rec, a, b, weight), a < b: how much two vectors of a recording are neighbours, by cosine. A vector and the
    ``neighbours`` - 1 nearest others make a neighbourhood, whose memberships fall off from the nearest on and add up
    to log2(neighbours); of two memberships x and y of a pair the weight is x + y - x y. Nulls, repeats and empty tables are as in ``nearest``.
    """
    found = nearest(vectors, recording, neighbours - 1, vec_id, vector, "cosine", block)
    rows = found.groupBy("rec", "id").agg(F.sort_array(F.collect_list(F.struct("distance", "other"))).alias("near"))

    @F.pandas_udf("array<double>")
    def memberships(column: pd.Series) -> pd.Series:
        d = np.full((len(column), max(1, neighbours - 1)), np.inf)
        for k, x in enumerate(column):
            d[k, : len(x)] = x
        near, width = widths(d, np.log2(neighbours))
        m = np.exp(-np.maximum(d - near[:, None], 0) / width[:, None])
        return pd.Series([m[k, : len(x)].tolist() for k, x in enumerate(column)])

    weighed = rows.withColumn("m", memberships(F.transform("near", lambda x: x["distance"])))
    edges = weighed.select("rec", "id", F.explode(F.arrays_zip("near", "m")).alias("x")).select("rec", F.least("id", "x.near.other").alias("a"), F.greatest("id", "x.near.other").alias("b"), F.col("x.m").alias("m"))
    both = edges.groupBy("rec", "a", "b").agg(F.max("m").alias("x"), F.when(F.count("*") > 1, F.min("m")).otherwise(0.0).alias("y"))
    return both.select("rec", "a", "b", (F.col("x") + F.col("y") - F.col("x") * F.col("y")).alias("weight"))


def _start(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, size: int, draw: np.random.Generator) -> np.ndarray:
    """Smooth places on the graph: its leading directions by repeated averaging over neighbours, the constant one left out."""
    weight = np.bincount(a, w, n) + np.bincount(b, w, n)
    scale = 1 / np.sqrt(np.maximum(weight, 1e-12))
    x = draw.normal(size=(n, size + 1))
    x[:, 0] = np.sqrt(weight)
    for _ in range(STARTS):
        x, _ = np.linalg.qr(x)
        y, moved = x * scale[:, None], x.copy()
        np.add.at(moved, a, (w * scale[a])[:, None] * y[b])
        np.add.at(moved, b, (w * scale[b])[:, None] * y[a])
        x = moved
    x = np.linalg.qr(x)[0][:, 1:]
    return 10 * x / max(np.abs(x).max(), 1e-12) + draw.normal(scale=1e-4, size=x.shape)


def laid_out(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Places of n nodes: edges draw their ends together by their weights, random partners push each other away, with steps
    that shrink to nothing. The same seed gives the same places."""
    draw = np.random.default_rng(seed)
    x = _start(n, a, b, w, size, draw)
    for k in range(ROUNDS):
        step = 1 - k / ROUNDS
        apart = x[a] - x[b]
        square = np.maximum((apart**2).sum(1), 1e-12)
        pull = -2 * FORCE * SHAPE * square ** (SHAPE - 1) / (1 + FORCE * square**SHAPE)
        move = np.clip((w * pull)[:, None] * apart, -4, 4) * step
        moved = np.zeros_like(x)
        np.add.at(moved, a, move)
        np.add.at(moved, b, -move)
        own, far = np.repeat(np.arange(n), PARTNERS), draw.integers(0, n, n * PARTNERS)
        apart = x[own] - x[far]
        square = (apart**2).sum(1)
        push = 2 * SHAPE / ((0.001 + square) * (1 + FORCE * np.maximum(square, 1e-12) ** SHAPE))
        np.add.at(moved, own, np.clip(push[:, None] * apart, -4, 4) * step * (own != far)[:, None])
        x = x + moved
    return x


def layout(vectors: DataFrame, recording: str, size: int = 32, neighbours: int = 5, seed: int = 2023, vec_id: str = "vec_id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(rec, vec_id, embedding): places of each recording's vectors in ``size`` dimensions, two fewer than vectors at most and
    one at least, in which neighbours of the ``fuzzy_graph`` lie near each other.

    The graph is made in blocks; a recording's edges, at most ``neighbours`` - 1 a vector, are laid out in one task. A
    recording's seed comes from ``seed`` and its name, so recordings, runs and partitions don't matter to each other. A
    vector without neighbours (alone in its recording) has no place.
    """
    kind = vectors.schema[recording].dataType.simpleString()

    def of(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["a", "b"])
        ids, ends = np.unique(part[["a", "b"]].to_numpy(), return_inverse=True)
        ends = ends.reshape(-1, 2)
        own = zlib.crc32(f"{seed}:{part['rec'].iloc[0]}".encode())
        x = laid_out(len(ids), ends[:, 0], ends[:, 1], part["weight"].round(6).to_numpy(), max(1, min(size, len(ids) - 2)), own)
        return pd.DataFrame({"rec": part["rec"].iloc[0], "vec_id": ids, "embedding": list(x)})

    return fuzzy_graph(vectors, recording, neighbours, vec_id, vector, block).groupBy("rec").applyInPandas(of, f"rec {kind}, vec_id long, embedding array<double>")


def kept_neighbours(vectors: DataFrame, places: DataFrame, recording: str, neighbours: int = 5, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(rec, n, kept): of each recording's pairs of nearest neighbours by cosine, the share that is among as many nearest in
    the layout."""
    near = nearest(vectors, recording, neighbours, vec_id, vector).select("rec", "id", "other")
    there = nearest(places, "rec", neighbours, metric="euclidean").select("rec", "id", "other", F.lit(1).alias("kept"))
    return near.join(there, ["rec", "id", "other"], "left").groupBy("rec").agg(F.count("*").alias("n"), (F.count("kept") / F.count("*")).alias("kept"))
