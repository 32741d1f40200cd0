"""Exact top-k search by inner product with MaxScore.

A component x of a vector becomes the integer floor(scale * x). A term is a dimension with a sign: its
posting list holds the vectors whose component has that sign, with the component's size as weight. For a
query, the terms of its own signs can only add to a score and the others only take from it, so the sum of
|query weight| * largest weight over the adding terms bounds any score. Terms are sorted by that bound.
The smallest ones whose bounds together stay below the query's k-th best score are non-essential: a vector
that is in none of the other, essential, lists can't enter the result. Essential lists are traversed;
the rest of the terms, the taking ones too, are probed group by group, and a vector is given up as soon as
what it has and what it could still get is below the k-th best score.

Vectors are packed into shards of ``SHARD`` and queries into blocks of ``BLOCK``; shards are dealt to
lanes, and each (query block, lane) is one group, so a task's memory is bounded at any size. Before that every
query is scored against one shard that all tasks get: its k-th best score there is a bound with which
each lane starts. Each lane gives the k best of its shards and the lanes are merged.

Defined results: vectors that are null, hold a null or non-finite component, or have a null id take no
part; every row is a candidate for all other rows, so rows repeated with one id, the same vector or another, each count,
and a repeated query row gives its k rows each time; vectors of different lengths are
compared over the shorter one (missing components are zero); an empty vector scores 0 against all; ties go
to the smaller id; scores must fit into 64 bits. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize

SHARD, BLOCK, LANE = 4096, 16_384, 4
PROBE = 8  # terms that are probed between two looks at the bound
CHUNK = 512  # vectors that are scored in full to have a first k-th best score


class Shard:
    """Vectors of one shard with their posting lists by dimension and sign."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, values: np.ndarray):
        self.ids, self.rows, self.values = ids, rows, values
        self.lists: list[tuple[np.ndarray, np.ndarray]] = []
        for column in values.T:
            for sign in (1, -1):
                rows = np.flatnonzero(column * sign > 0)
                self.lists.append((rows, np.abs(column[rows])))
        self.largest = np.array([w.max(initial=0) for _, w in self.lists], np.int64)


class Best:
    """The k best (score, id) of a query so far; ``floor``: a score that k vectors are known to reach."""

    def __init__(self, k: int, floor: int | None = None):
        self.k, self.floor, self.scores, self.ids = k, floor, np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def least(self) -> int | None:
        """A score below which no vector can be among the k best; None while fewer are known."""
        own = int(self.scores[-1]) if len(self.scores) == self.k else None
        return self.floor if own is None else own if self.floor is None else max(own, self.floor)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]


def _added(lists: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n: int, exact: bool) -> np.ndarray:
    """What the lists add to each of n vectors; ``exact``: sums of doubles are whole numbers below 2**53."""
    if exact:
        rows = np.concatenate([r for r, _ in lists])
        each = np.concatenate([w * q for (_, w), q in zip(lists, weights, strict=True)])
        return np.bincount(rows, each, n).astype(np.int64)
    out = np.zeros(n, np.int64)
    for (rows, w), q in zip(lists, weights, strict=True):
        out[rows] += w * q
    return out


def search_shard(shard: Shard, query: np.ndarray, own_row: int, best: Best) -> None:
    """Add to ``best`` the vectors of the shard that belong there."""
    n = len(shard.ids)
    live = np.flatnonzero(shard.rows != own_row)
    while best.least is None and len(live):  # score some vectors in full for a first bound
        best.add(shard.values[live[:CHUNK]] @ query, shard.ids[live[:CHUNK]])
        live = live[CHUNK:]
    if not len(live):
        return
    used = np.flatnonzero(query)
    terms = 2 * used + (query[used] < 0)  # the sign of the query's own component adds
    weights = np.abs(query[used])
    bounds = weights * shard.largest[terms]
    order = np.argsort(bounds, kind="stable")
    used, terms, weights, bounds = used[order], terms[order], weights[order], bounds[order]
    below = np.cumsum(bounds)
    split = int(np.searchsorted(below, best.least, "left")) if best.least > 0 else 0  # bounds up to here stay below the k-th score
    if split == len(terms) and best.least > 0:
        return
    exact = int(bounds.sum()) < 1 << 52
    if split < len(terms):
        got = _added([shard.lists[t] for t in terms[split:]], weights[split:], n, exact)
    else:
        got = np.zeros(n, np.int64)
    if best.least > 0:
        live = live[got[live] > 0]  # in an essential list
    rest = int(below[split - 1]) if split else 0
    live = live[got[live] + rest >= best.least]
    score = got[live]
    # probe what the essential lists have left out: their taking side, then the non-essential dimensions
    left = [(used[i : i + PROBE], -1) for i in range(split, len(used), PROBE)] + [(used[max(0, i - PROBE) : i], 0) for i in range(split, 0, -PROBE)]
    for chosen, sign in left:
        if not len(live):
            return
        part = shard.values[live][:, chosen] * query[chosen]
        if sign:
            part = np.minimum(part, 0)
        else:
            rest -= int((np.abs(query[chosen]) * shard.largest[2 * chosen + (query[chosen] < 0)]).sum())
        score = score + part.sum(axis=1)
        keep = score + rest >= best.least
        live, score = live[keep], score[keep]
    best.add(score, shard.ids[live])


def _pack(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (ids, rows, width, packed) of at most ``size`` vectors (row, vec_id, v) each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for batch in batches:
            held.append(batch)
            while sum(map(len, held)) >= size:
                whole = pd.concat(held)
                yield frame(whole[:size])
                held = [whole[size:]]
        if held and len(whole := pd.concat(held)):
            yield frame(whole)

    def frame(rows: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, rows["v"]))
        values = np.zeros((len(rows), width), np.int64)
        for i, v in enumerate(rows["v"]):
            values[i, : len(v)] = v
        small = np.int16 if width and np.abs(values).max() < 1 << 15 else np.int64
        return pd.DataFrame({"ids": [rows["vec_id"].to_numpy(np.int64)], "rows": [rows["row"].to_numpy(np.int64)], "width": width, "packed": [values.astype(small).tobytes()]})

    return vectors.mapInPandas(run, "ids array<long>, rows array<long>, width int, packed binary")


def _values(ids: np.ndarray, width: int, packed: bytes) -> np.ndarray:
    kind = np.int16 if len(packed) == 2 * len(ids) * width else np.int64
    return np.frombuffer(packed, kind).reshape(len(ids), width).astype(np.int64)


def _fit(values: np.ndarray, width: int) -> np.ndarray:
    return values[:, :width] if values.shape[1] >= width else np.hstack([values, np.zeros((len(values), width - values.shape[1]), np.int64)])


def _shard(r) -> Shard:
    return Shard(np.asarray(r.ids, np.int64), np.asarray(r.rows, np.int64), _values(r.ids, r.width, r.packed))


def _with_floors(queries: DataFrame, shard: DataFrame, k: int) -> DataFrame:
    """The query blocks with ``floors``: each query's k-th best score in one shard, null if that has fewer vectors."""
    seed = queries.sparkSession.sparkContext.broadcast(shard.toPandas())  # one row of SHARD vectors

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [_shard(r) for r in seed.value.itertuples()]
        for batch in batches:
            floors = []
            for r in batch.itertuples():
                own = []
                for row, query in zip(r.rows, _values(r.ids, r.width, r.packed), strict=True):
                    best = Best(k)
                    for one in known:
                        search_shard(one, _fit(query[None], one.values.shape[1])[0], row, best)
                    own.append(best.least)
                floors.append(own)
            yield batch.assign(floors=floors)

    return queries.mapInPandas(run, "block long, ids array<long>, rows array<long>, width int, packed binary, floors array<long>")


def _search(k: int):
    def run(queries: pd.DataFrame, shards: pd.DataFrame) -> pd.DataFrame:
        asked = [(i, row, floor, v) for r in queries.itertuples() for i, row, floor, v in zip(r.ids, r.rows, r.floors, _values(r.ids, r.width, r.packed), strict=True)]
        best = [Best(k, None if floor is None or floor != floor else int(floor)) for _, _, floor, _ in asked]
        for r in shards.itertuples():
            shard = _shard(r)
            for (_, row, _, query), found in zip(asked, best, strict=True):
                search_shard(shard, _fit(query[None], shard.values.shape[1])[0], row, found)
        rows = [(own, row, i, s) for (own, row, _, _), found in zip(asked, best, strict=True) for i, s in zip(found.ids, found.scores, strict=True)]
        return pd.DataFrame(rows, columns=["query_id", "query_row", "vec_id", "score"])

    return run


def usable(table: DataFrame, vector: str, scale: float) -> DataFrame:
    """(row, vec_id, v array<long>) of the rows that take part; row is another number in each."""
    x = F.col(vector)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    rows = table.where(F.col("vec_id").isNotNull() & x.isNotNull() & ~bad)
    v = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    return rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


def top_k(table: DataFrame, is_query: Column, k: int = 5, vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other vectors for each row where ``is_query`` (of vec_id) holds."""
    spark = table.sparkSession
    vectors = materialize(usable(table, vector, scale), "maxscore-vectors")
    asked = vectors.where(is_query)
    n, m = vectors.count(), asked.count()
    blocks = max(1, math.ceil(m / BLOCK))
    lanes = max(math.ceil(n / (SHARD * LANE)), min(math.ceil(n / SHARD), 4 * spark.sparkContext.defaultParallelism), 1)
    shards = _pack(vectors.repartition(lanes), SHARD).withColumn("lane", F.spark_partition_id())
    shards = materialize(shards, "maxscore-shards")
    queries = _pack(asked.repartition(blocks), BLOCK).withColumn("block", F.monotonically_increasing_id())
    queries = materialize(_with_floors(queries.select("block", "ids", "rows", "width", "packed"), shards.limit(1), k), "maxscore-queries")  # block numbers must not change
    # blocks and shards are few beside their vectors; each block meets each lane once
    left = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    named = queries.select(F.col("block").alias("asked")).withColumn("dealt", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    right = shards.join(named, F.col("lane") == F.col("dealt")).drop("lane")
    groups = min(4 * blocks * lanes, 100_000)  # partitions, so that few groups meet in one task
    pairs = left.repartition(groups, "block", "lane").groupBy("block", "lane").cogroup(right.repartition(groups, "asked", "dealt").groupBy("asked", "dealt"))
    found = pairs.applyInPandas(_search(k), "query_id long, query_row long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
