"""Approximate nearest neighbours over balanced posting lists.

Lists come from a bounded sample: it is halved again and again at the median along the line
between two means, which gives lists of equal share, and the means of the leaves are the
centroids. Every vector goes to its nearest centroid and, when it lies near a boundary, also
to others about as near. Centroids are searched by best-first walks over a graph of their
neighbours, held in the memory of each task. Lists are selected by the ratio of a centroid's
distance to that of a near one (not the nearest, which a tight group of copies may have to
itself), so a vector amid many centroids gets more lists than one that has a clear home. The
ratio of the queries is fitted on the sample: the least one that finds the wanted share of the
nearest within it, so vectors in groups need few lists and vectors without any need many. In a
sample of a larger table the nearest are farther off, which makes the ratio larger, not smaller.

Nearness is the inner product. Vectors get one more component that lifts all to the same
length, so the nearest in space are those of largest product. Postings and queries meet in
cells of a list: large lists are cut into pieces and many queries of one list into blocks, so
no task holds a whole hot list, and each cell gives its best k per query. What is best is
decided by scores summed in one order, whatever the size of a cell.

Of vectors with equal components only the k + 1 of least id can be among anybody's nearest,
so only those are posted; equal queries are searched once. Vectors that are null, zero, of
another dimension than most, or hold a null or non-finite component take no part; repeated
rows count once; an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.sources.staging import stage


@dataclass(frozen=True)
class ListSettings:
    """``sample`` bounds the vectors the lists are fitted on, ``most_lists`` their number.

    A vector has at most ``copies`` postings and a query at most ``probes`` lists for a
    thousand lists, growing with the square root of their number. A vector is posted to lists
    up to ``ratio`` times the distance of a near centroid. A query takes lists up to a ratio
    that finds the share ``recall`` of the nearest of ``trials`` sampled vectors, against the
    distance of the ``near``-th centroid, and ``least`` of them in any case. A walk keeps the
    best ``beam`` centroids, or twice the lists wanted.
    ``piece`` and ``block`` bound the postings and queries of a cell, on average, and
    ``asked`` the queries of a task that selects lists.
    """

    sample: int = 100_000
    most_lists: int = 8_192
    copies: int = 6
    probes: int = 96
    least_probes: int = 64
    near: int = 8
    least: int = 8
    ratio: float = 1.15
    recall: float = 0.95
    trials: int = 256
    beam: int = 64
    degree: int = 24
    piece: int = 4_096
    block: int = 1_024
    asked: int = 512


class CentroidGraph:
    """Centroids and the nearest neighbours of each, searched many at a time."""

    def __init__(self, centroids: np.ndarray, degree: int) -> None:
        self.centroids = centroids
        n = len(centroids)
        square = (centroids**2).sum(1)
        near = np.zeros((n, min(degree, max(n - 1, 1))), np.int64)
        for at in range(0, n, 1024):
            part = square[None, :] - 2 * centroids[at : at + 1024] @ centroids.T
            rows = np.arange(len(part))
            part[rows, at + rows] = np.inf if n > 1 else 0
            near[at : at + 1024] = np.argpartition(part, near.shape[1] - 1, axis=1)[:, : near.shape[1]]
        # a few steps at doubling distances keep far parts of the graph connected
        jumps = (np.arange(n)[:, None] + (1 << np.arange(max(1, n.bit_length())))[None, :]) % n
        self.links = np.concatenate([near, jumps], 1)
        self._square = square

    def distances(self, vectors: np.ndarray) -> np.ndarray:
        """Squared distances to all centroids, for a few vectors."""
        return np.maximum(self._square - 2 * vectors @ self.centroids.T + (vectors**2).sum(1)[:, None], 0)

    def search(self, vectors: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """For each vector the nearest centroids found and their squared distances, in order."""
        n, width = len(vectors), min(beam, len(self.centroids))
        size = (vectors**2).sum(1)

        def distance(ids: np.ndarray) -> np.ndarray:
            dots = np.einsum("qd,qkd->qk", vectors, self.centroids[ids])
            return np.maximum(self._square[ids] - 2 * dots + size[:, None], 0)

        start = np.unique(np.linspace(0, len(self.centroids) - 1, min(width, 16)).astype(np.int64))
        ids = np.broadcast_to(start, (n, len(start))).copy()
        far, done = distance(ids), np.zeros((n, len(start)), bool)
        rows = np.arange(n)[:, None]
        while not done.all():
            step = np.argsort(np.where(done, np.inf, far), axis=1, kind="stable")[:, :4]
            fresh = ~done[rows, step]
            done[rows, step] = True
            new = self.links[ids[rows, step]]
            new = np.where(fresh[:, :, None], new, ids[rows, step][:, :, None]).reshape(n, -1)
            ids = np.concatenate([ids, new], 1)
            far = np.concatenate([far, distance(new)], 1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], 1)
            order = np.lexsort((~done, ids), axis=1)
            ids, far, done = ids[rows, order], far[rows, order], done[rows, order]
            again = np.zeros(ids.shape, bool)
            again[:, 1:] = ids[:, 1:] == ids[:, :-1]
            far = np.where(again, np.inf, far)
            order = np.argsort(far, axis=1, kind="stable")[:, :width]
            ids, far, done = ids[rows, order], far[rows, order], done[rows, order]
            done |= np.isinf(far)
        return ids, far


def balanced_centroids(vectors: np.ndarray, lists: int) -> np.ndarray:
    """Means of equal parts of the vectors."""
    groups = [np.arange(len(vectors))]
    while len(groups) < lists:
        halves = []
        for group in groups:
            if len(group) < 2:
                halves.append(group)
                continue
            part = vectors[group]
            ends = part[[0, int(np.argmax(((part - part[0]) ** 2).sum(1)))]]
            for _ in range(4):
                side = ((part - ends[0]) ** 2).sum(1) > ((part - ends[1]) ** 2).sum(1)
                if side.all() or not side.any():
                    break
                ends = np.stack([part[~side].mean(0), part[side].mean(0)])
            order = group[np.argsort(part @ (ends[1] - ends[0]), kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        if len(halves) == len(groups):
            break
        groups = halves
    return np.stack([vectors[g].mean(0) for g in groups if len(g)])


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with a component that lifts all to the length of the longest."""
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], 1)


def _within(far: np.ndarray, ratio: float, near: int, least: int, most: int) -> np.ndarray:
    """Which of the centroids in order of distance are selected; distances are squared."""
    chosen = far <= ratio**2 * far[:, min(near, far.shape[1]) - 1][:, None]
    chosen[:, :least] = True
    chosen[:, most:] = False
    return chosen & np.isfinite(far)


def query_ratio(points: np.ndarray, graph: CentroidGraph, k: int, settings: ListSettings) -> float:
    """The least ratio at which the lists of sampled vectors hold the wanted share of their nearest.

    ``points`` are lifted and distinct. With fewer than two there is nothing to learn, and the
    ratio is that of the postings.
    """
    k = min(k, len(points) - 1)
    if k < 1:
        return settings.ratio
    trials = np.unique(np.linspace(0, len(points) - 1, min(settings.trials, len(points))).astype(np.int64))
    asking = points[trials].copy()
    asking[:, -1] = 0
    scores = asking @ points.T
    scores[np.arange(len(trials)), trials] = -np.inf
    nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    found, home = np.unique(nearest, return_inverse=True)
    distance = graph.distances(asking)
    anchor = np.partition(distance, min(settings.near, distance.shape[1]) - 1, axis=1)[:, min(settings.near, distance.shape[1]) - 1]
    copies = min(settings.copies, distance.shape[1])
    lists, far = np.empty((len(found), copies), np.int64), np.empty((len(found), copies))
    for at in range(0, len(found), 512):
        part = graph.distances(points[found[at : at + 512]])
        lists[at : at + 512] = np.argsort(part, axis=1, kind="stable")[:, :copies]
        far[at : at + 512] = np.take_along_axis(part, lists[at : at + 512], 1)
    posted = _within(far, settings.ratio, copies // 2 or 1, 1, copies)
    home = home.reshape(nearest.shape)
    needed = np.full(nearest.shape, np.inf)
    for nth in range(copies):
        reached = np.take_along_axis(distance, lists[home, nth], 1)
        needed = np.minimum(needed, np.where(posted[home, nth], reached, np.inf))
    ratios = np.sort((needed / np.maximum(anchor[:, None], 1e-300)).ravel())
    at = ratios[min(int(settings.recall * len(ratios)), len(ratios) - 1)]
    return float(np.sqrt(at)) * (1 + 1e-9)


def _matrix(column: pa.Array | pd.Series, dimension: int) -> np.ndarray:
    values = column.to_pylist() if isinstance(column, pa.Array) else column
    return np.frombuffer(b"".join(values), "<f8").reshape(-1, dimension)


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The k vectors of largest product with each query: largest first, then least id.

    The last bit of a product of matrices depends on their shapes, so whatever is within rounding
    of the k-th is taken along, and products summed in one order decide.
    """
    longest = np.sqrt((vectors**2).sum(1).max())
    for query, row in zip(queries, queries @ vectors.T, strict=True):
        at = np.arange(len(row))
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            at = np.flatnonzero(row >= least - 1e-12 * longest * np.sqrt((query**2).sum()))
        exact = (vectors[at] * query).sum(1)
        order = np.lexsort((ids[at], -exact))[:k]
        yield ids[at[order]], exact[order]


def nearest_by_lists(
    vectors: DataFrame, is_query: Column, k: int, settings: ListSettings = ListSettings(),
    id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """The k nearest rows found of every query row: query_id, rank, vec_id and score."""
    spark = vectors.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    items = F.col(f"`{embedding}`").cast("array<double>")
    usable = (
        F.forall(items, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(items, lambda x: x != 0)
    )
    plain = vectors.select(
        F.col(f"`{id}`").cast("long").alias("vec_id"), items.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")
    ).filter(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    sizes = plain.groupBy(F.size("v").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.max(squared)).alias("longest"), F.count_if("asks").alias("asked")
    ).orderBy(F.desc("n"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dimension, n, longest = sizes["d"], sizes["n"], sizes["longest"]
    plain = plain.filter(F.size("v") == dimension)

    lists = int(np.clip(4 * np.sqrt(n), 1, settings.most_lists))
    share = min(1.0, settings.sample / n)
    chosen = plain.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f4").tobytes()
            step = 4 * dimension
            yield pa.RecordBatch.from_arrays([pa.array([flat[i : i + step] for i in range(0, len(flat), step)], pa.binary())], names=["v"])

    # at most about ``sample`` rows of four bytes a component
    sample = sorted(set(chosen.select("v").mapInArrow(short, "v binary").toArrow().column(0).to_pylist()))
    points = np.frombuffer(b"".join(sample), "<f4").reshape(-1, dimension).astype(float)
    points = _lifted(points if len(points) else np.zeros((1, dimension)), longest)
    fitted = CentroidGraph(balanced_centroids(points, lists), settings.degree)
    ratio = query_ratio(points, fitted, k, settings)
    graph = spark.sparkContext.broadcast(fitted)
    most_probes = max(settings.least_probes, int(settings.probes * np.sqrt(len(fitted.centroids) / 1000)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<f8")
            flat = flat + 0.0  # a negative zero equals zero
            step = 8 * dimension
            raw = flat.tobytes()
            v = [raw[i : i + step] for i in range(0, len(raw), step)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(v, pa.binary()), batch.column(2)], names=["vec_id", "v", "asks"])

    rows = stage(plain.mapInArrow(packed, "vec_id long, v binary, asks boolean").distinct())
    same = Window.partitionBy("v").orderBy("vec_id")
    posted = rows.select("vec_id", "v").withColumn("nth", F.row_number().over(same)).filter(F.col("nth") <= k + 1)
    asked = rows.filter("asks").groupBy("v").agg(F.min("vec_id").alias("query"))
    spread = asked.repartition(int(np.ceil(sizes["asked"] / settings.asked)) or 1, "query")

    def lists_of(ratio: float, most: int, near: int, least: int, lift: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    v = _matrix(part.column(1), dimension)
                    lifted = _lifted(v, longest) if lift else np.concatenate([v, np.zeros((len(v), 1))], 1)
                    ids, far = graph.value.search(lifted, max(settings.beam, 2 * most))
                    chosen = _within(far, ratio, near, least, most)
                    row = np.repeat(np.arange(len(v)), chosen.sum(1))
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), pa.array(ids[chosen].astype(np.int32))],
                        names=["id", "v", "list"],
                    )

        return run

    kinds = "id long, v binary, list int"
    postings = stage(posted.select("vec_id", "v").mapInArrow(lists_of(settings.ratio, settings.copies, settings.copies // 2, 1, True), kinds))
    probes = stage(spread.select("query", "v").mapInArrow(lists_of(ratio, most_probes, settings.near, settings.least, False), kinds))
    # one row per list, so the sides joined are bounded by ``most_lists``
    pieces = postings.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.piece).cast("int").alias("pieces"))
    blocks = probes.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / settings.block).cast("int").alias("blocks"))
    cells = F.broadcast(stage(pieces.join(blocks, "list").coalesce(1)))
    left = postings.join(cells, "list").select(
        "list", F.pmod(F.xxhash64("id"), "pieces").cast("int").alias("piece"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "v",
    )
    right = probes.join(cells, "list").select(
        "list", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"),
        F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"), "id", "v",
    )

    def cell(postings: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        ids, out = postings["id"].to_numpy(), []
        if len(ids) and len(queries):
            v, q = _matrix(postings["v"], dimension), _matrix(queries["v"], dimension)
            asking = queries["id"].to_numpy()
            for at in range(0, len(q), 256):
                # k + 1, as a query may be one of its own nearest
                out += [
                    (a, i, s) for a, (i, s) in zip(asking[at : at + 256], _best(q[at : at + 256], v, ids, k + 1), strict=True)
                ]
        return pd.DataFrame(out, columns=["query", "ids", "scores"])

    found = left.groupBy("list", "piece", "block").cogroup(right.groupBy("list", "piece", "block")).applyInPandas(
        cell, "query long, ids array<long>, scores array<double>"
    )

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        ids, first = np.unique(np.concatenate(part["ids"].to_list()), return_index=True)
        scores = np.concatenate(part["scores"].to_list())[first]
        order = np.lexsort((ids, -scores))[: k + 1]
        return pd.DataFrame({"query": part["query"].iloc[0], "ids": [ids[order]], "scores": [scores[order]]})

    best = found.groupBy("query").applyInPandas(merged, "query long, ids array<long>, scores array<double>")
    everyone = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "v").join(asked, "v").drop("v")
    answers = everyone.join(best, "query").select("query_id", F.arrays_zip("ids", "scores").alias("near"))
    others = F.slice(F.filter("near", lambda x: x["ids"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"),
        F.col("hit.ids").alias("vec_id"), F.col("hit.scores").alias("score"),
    )
