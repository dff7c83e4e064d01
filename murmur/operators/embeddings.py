"""Vectors of speakers: norms, similarities, clusters and their quality."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.operators.density import density_clusters
from murmur.operators.layout import layout
from murmur.sources.scratch import materialise


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """v over its length, which 1e-8 keeps from 0."""
    return F.transform(v, lambda x: x.cast("double") / (norm(v) + 1e-8))


def centred(v: Column) -> Column:
    """v without its mean."""
    mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) / F.size(v)
    return F.transform(v, lambda x: x.cast("double") - mean)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """The mean vector of each label, in one pass with a row per label and place before the shuffle."""
    places = vectors.select(label, F.posexplode(vector).alias("place", "x")).groupBy(label, "place").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = F.array_sort(F.collect_list(F.struct("place", "x")))
    return places.groupBy(label).agg(F.transform(rows, lambda r: r["x"]).alias("centroid"))


def cosine_to_centroid(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """Each vector's cosine to the centroid of its own label."""
    both = vectors.join(centroids(vectors, label, vector), label)
    return both.withColumn("cosine", F.round(dot(F.col(vector), F.col("centroid")) / (norm(F.col(vector)) * norm(F.col("centroid")) + 1e-8), 6)).drop("centroid")


def average_linkage(x: np.ndarray, n_clusters: int, distance: float | None = None) -> np.ndarray:
    """Labels of agglomerative clustering by mean cosine distance, down to ``n_clusters`` or while the nearest
    pair is nearer than ``distance``.

    Clusters follow a chain of nearest neighbours until two are each other's nearest, which are then merged: with
    mean distances that gives the tree of merges in a number of steps that grows with the square of the vectors.
    The merges are then taken from the nearest on.
    """
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, merges, chain = np.ones(len(x)), [], []
    alive = np.ones(len(x), bool)
    while len(merges) < len(x) - 1:
        if not chain:
            chain.append(int(np.argmax(alive)))
        a = chain[-1]
        b = int(np.argmin(d[a]))
        if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
            b = chain[-2]
            del chain[-2:]
            merges.append((float(d[a, b]), a, b))
            merged = (d[a] * size[a] + d[b] * size[b]) / (size[a] + size[b])
            d[a], d[:, a] = merged, merged
            d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
            size[a] += size[b]
            alive[b] = False
        else:
            chain.append(b)
    labels = np.arange(len(x))
    merges.sort(key=lambda m: m[0])
    for near, a, b in merges[: max(0, len(x) - max(1, n_clusters))]:
        if distance is not None and near >= distance:
            break
        labels[labels == labels[b]] = labels[a]
    return np.unique(labels, return_inverse=True)[1]


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette by cosine distance; 0 where it is not defined."""
    k = len(np.unique(labels))
    if not 2 <= k < len(x):
        return 0.0
    x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)
    d = 1 - x @ x.T
    member = np.eye(k)[labels]
    sums, sizes = d @ member, member.sum(0)
    own = sizes[labels]
    a = np.where(own > 1, sums[np.arange(len(x)), labels] / np.maximum(own - 1, 1), 0)
    others = np.where(member > 0, np.inf, sums / sizes)
    b = others.min(1)
    return float(np.where(own > 1, (b - a) / np.maximum(a, b), 0).mean())


def silhouettes(labelled: DataFrame, recording: str, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(recording, n, silhouette) of each recording's labelled vectors by cosine distance; 0 where it isn't defined. A vector's mean
    distance to a label is one minus its product with the mean of the label's unit vectors, so no pairs are made and a
    recording is as many tasks as it has rows. Null labels are one label; rows without a recording or a vector are left out."""
    labelled = labelled.filter(F.col(recording).isNotNull() & (F.size(vector) > 0))
    rows = labelled.select(F.col(recording).alias("rec"), F.col(label).alias("own"), normalised(F.col(vector)).alias("unit"))
    sums = rows.select("rec", "own", F.posexplode("unit").alias("place", "x")).groupBy("rec", "own", "place").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    sums = sums.groupBy("rec", "own").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda r: r["x"]).alias("total"), F.first("n").alias("n_own")).withColumnRenamed("own", "of")
    met = rows.join(sums, "rec").withColumn("is_own", F.col("own").eqNullSafe(F.col("of")))
    near = 1 - dot(F.col("unit"), F.col("total")) / F.col("n_own")
    inside = (F.col("n_own") - dot(F.col("unit"), F.col("total")) - (1 - dot(F.col("unit"), F.col("unit")))) / (F.col("n_own") - 1)
    met = met.withColumns({"a": F.when(F.col("is_own") & (F.col("n_own") > 1), inside), "b": F.when(~F.col("is_own"), near)})
    scored = met.withColumn("row", F.struct("unit", "own")).groupBy("rec", "row").agg(F.max("a").alias("a"), F.min("b").alias("b"), F.count_if("is_own").alias("same"))
    score = F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))
    counts = sums.groupBy("rec").agg(F.sum("n_own").alias("n"), F.count("*").alias("k"))
    out = scored.groupBy("rec").agg((F.sum(score * F.col("same")) / F.sum("same")).alias("mean")).join(counts, "rec")
    return out.select(F.col("rec").alias(recording), "n", F.when((F.col("k") >= 2) & (F.col("k") < F.col("n")), F.col("mean")).otherwise(0.0).alias("silhouette"))


def dense_speakers(vectors: DataFrame, recording: str, vec_id: str = "vec_id", vector: str = "embedding", least: int = 3, least_silhouette: float = 0.1) -> DataFrame:
    """(recording, vec_id, speaker, silhouette): as many speakers as a recording's vectors show, -1 for vectors of none.

    The vectors are laid out by their neighbours (``layout``) and density clusters of the layout are the speakers. A
    recording is one speaker if it has two vectors or fewer, if no vector has a cluster, or if the silhouette of the labels
    over the vectors themselves stays under ``least_silhouette``. Rows without a recording, an id or a vector have no
    speaker and are left out; of a repeated id one row stays. An empty table gives none.
    """
    places = materialise(layout(vectors, recording, vec_id=vec_id, vector=vector), "places")
    labels = density_clusters(places, "rec", least=least, metric="euclidean").withColumnRenamed("label", "found")
    rows = vectors.select(F.col(recording).alias("rec"), F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("rec IS NOT NULL AND id IS NOT NULL AND size(v) > 0").groupBy("rec", "id").agg(F.min("v").alias("v"))
    labelled = materialise(rows.join(labels, ["rec", "id"], "left"), "labels")
    scores = silhouettes(labelled.withColumn("found", F.coalesce("found", F.lit(-1))), "rec", "found", "v")
    known = labelled.groupBy("rec").agg(F.count("*").alias("n_all"), F.max("found").alias("top"), F.countDistinct("found").alias("kinds"))
    out = labelled.join(known.join(scores, "rec"), "rec")
    one = (F.col("n_all") <= 2) | F.coalesce(F.col("top") < 0, F.lit(True)) | ((F.col("kinds") > 1) & (F.col("silhouette") < least_silhouette))
    return out.select(F.col("rec").alias(recording), F.col("id").alias(vec_id), F.when(one, 0).otherwise(F.coalesce("found", F.lit(-1))).cast("long").alias("speaker"), F.round("silhouette", 6).alias("silhouette"))


def cluster_speakers(vectors: DataFrame, recording: str, vec_id: str = "vec_id", vector: str = "embedding", num_speakers: int = -1, distance: float | None = None, least_silhouette: float = 0.1) -> DataFrame:
    """A speaker number for each vector of a recording: one speaker for two vectors or fewer, or where the
    silhouette stays under ``least_silhouette``. Where the number of speakers isn't known and no ``distance`` is given, they are
    those of ``dense_speakers``. Else a recording is one group: a call has some thousands of vectors
    at most, and their distances are its square."""
    if num_speakers < 2 and distance is None:
        return dense_speakers(vectors, recording, vec_id, vector, least_silhouette=least_silhouette)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(vec_id)
        x = np.array(part[vector].tolist(), float)
        labels = np.zeros(len(part), int)
        if len(part) > 2:
            labels = average_linkage(x, num_speakers) if num_speakers >= 2 else average_linkage(x, 1, distance)
        score = silhouette(x, labels)
        if len(np.unique(labels)) > 1 and score < least_silhouette:
            labels[:] = 0
        return pd.DataFrame({recording: part[recording], vec_id: part[vec_id], "speaker": labels, "silhouette": round(score, 6)})

    return vectors.select(recording, vec_id, vector).groupBy(recording).applyInPandas(run, f"{recording} long, {vec_id} long, speaker long, silhouette double")
