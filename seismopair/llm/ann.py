"""Approximate nearest neighbours by largest inner product: inverted lists, scanned by an adaptive number of dimensions.

One more component makes all vectors equally long, so that the largest inner product is the least distance. Vectors are
rotated at random and held by blocks of columns; after each block a hypothesis test on the partial distance drops
candidates that can hardly be among the nearest, within each probed list. Scores of what is left
are computed on the original vectors. The rotation, the lists' centres and the number of lists to
probe are fitted on a bounded sample; every row is in the index.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, vectors

#: Rows that the index is fitted on at most, rows of these that a list stands for at least, and rows that tell a score which k rows of the probed lists surely have.
SAMPLE, PER_LIST, FLOOR = 16_384, 16, 4096
#: Part of a sample query's neighbours that the probed lists have to hold.
RECALL = 0.98
#: Columns of a block, and how many standard deviations a partial distance may fall short of the whole.
COLUMNS, DEVIATIONS = 16, 2.1
#: Queries packed into a row, and queries whose neighbours a task holds at a time, at most.
PACKED, HELD = 1024, 100_000


class Index:
    """What is fitted: centres in the lengthened space, its rotation, the squared length, and lists to probe."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, n: int, longest: float, k: int, seed: int = 29):
        rng = np.random.default_rng(seed)
        self.size, self.longest, self.k = x.shape[1], longest, k
        self.rotation = np.linalg.qr(rng.standard_normal((self.size + 1, self.size + 1)))[0]
        self.ids, self.x = ids, x
        lists = int(np.clip(round(np.sqrt(n) / 4), 1, max(1, len(x) // PER_LIST)))
        y = self.longer(x)
        centers = y[rng.permutation(len(y))[:lists]]
        for _ in range(8):
            own = self._nearest(y, centers)
            sums = np.zeros_like(centers)
            np.add.at(sums, own, y)
            count = np.bincount(own, minlength=lists)
            centers = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        self.centers = centers
        self.own = self._nearest(y, centers)
        self.probes = self._probes() if lists > 1 else 1

    def longer(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.longest - (x * x).sum(1), 0))])

    @staticmethod
    def _nearest(y: np.ndarray, centers: np.ndarray) -> np.ndarray:
        return ((centers * centers).sum(1)[None] - 2 * y @ centers.T).argmin(1)

    def lists(self, x: np.ndarray) -> np.ndarray:
        """The list of each row."""
        return self._nearest(self.longer(x), self.centers)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query, nearest centre first; a query's further component is 0."""
        return np.argsort((self.centers * self.centers).sum(1)[None] - 2 * q @ self.centers[:, :-1].T, axis=1, kind="stable")

    def _probes(self) -> int:
        """Lists to probe so that RECALL of the neighbours inside the sample are found, on average."""
        some = np.arange(0, len(self.x), max(1, len(self.x) // 400))
        score = self.x[some] @ self.x.T
        score[np.arange(len(some)), some] = -np.inf
        near = np.argpartition(-score, min(self.k, score.shape[1] - 1) - 1, axis=1)[:, : self.k]
        own = self.own[near]
        place = np.argsort(self.order(self.x[some]), axis=1)
        at = np.sort(np.take_along_axis(place, own, axis=1).ravel())
        return int(at[min(len(at) - 1, int(np.ceil(RECALL * len(at))) - 1)]) + 1

    def least(self, ids: np.ndarray, q: np.ndarray, probed: np.ndarray) -> np.ndarray:
        """A score that over k rows of the probed lists have, whatever the tests drop: the 2k-th best of FLOOR rows of the sample, as far as they are in these lists."""
        score = q @ self.x[:FLOOR].T
        score[~probed[:, self.own[:FLOOR]] | (ids[:, None] == self.ids[None, :FLOOR])] = -np.inf
        if score.shape[1] <= 2 * self.k:
            return np.full(len(q), -np.inf)
        return np.partition(score, score.shape[1] - 2 * self.k, axis=1)[:, score.shape[1] - 2 * self.k]


def fit(rows: DataFrame, size: int, k: int) -> Index:
    """An index over rows (id, v): a job for their number and greatest length, and one for the sample."""
    n, longest = rows.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    return Index(*vectors.sample(rows, SAMPLE, size), n, (longest or 1.0) * (1 + 1e-9), k)


def scan(index: Index, ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score) of what may be among the nearest, from blocks of columns and tests between them."""
    y = (index.longer(x) @ index.rotation).astype(np.float32)
    z = (q @ index.rotation[:-1]).astype(np.float32)
    width = y.shape[1]
    limit = (q * q).sum(1) + index.longest - 2 * least  # squared distance that the k-th nearest has at most
    limit = np.where(np.isfinite(limit), np.maximum(limit, 0) + 1e-4 * (index.longest + (q * q).sum(1)), np.inf)
    many = min(COLUMNS, width)

    def bound(columns: int) -> np.ndarray:
        share = columns / width
        return limit * (min(1.0, share * (1 + DEVIATIONS / np.sqrt(columns)) ** 2) if columns < width else 1.0)

    a, b = z[:, :many], y[:, :many]
    part = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    i, j = np.nonzero((part <= bound(many)[:, None]) & (query_ids[:, None] != ids[None]))
    part = part[i, j]
    while many < width and len(i):
        to = min(many + COLUMNS, width)
        difference = z[i, many:to] - y[j, many:to]
        part = part + (difference * difference).sum(1)
        many = to
        near = part <= bound(many)[i]
        i, j, part = i[near], j[near], part[near]
    score = np.einsum("ij,ij->i", q[i], x[j])
    near = score >= least[i]
    return i[near], j[near], score[near]


class Nearest:
    """The k best of each query so far."""

    def __init__(self, k: int):
        self.k, self.rows = k, {}

    def least(self, ids: np.ndarray, start: np.ndarray) -> np.ndarray:
        full = [r[0][-1] if (r := self.rows.get(i)) is not None and len(r[0]) == self.k else -np.inf for i in ids.tolist()]
        return np.maximum(start, full)

    def add(self, query: int, score: np.ndarray, ids: np.ndarray) -> None:
        if (old := self.rows.get(query)) is not None:
            score, ids = np.concatenate([old[0], score]), np.concatenate([old[1], ids])
        best = np.lexsort((ids, -score))[: self.k]
        self.rows[query] = (score[best], ids[best])

    def out(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            sizes = [len(r[0]) for r in self.rows.values()]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(list(self.rows), sizes)), pa.array(np.concatenate([r[1] for r in self.rows.values()])), pa.array(np.concatenate([r[0] for r in self.rows.values()]))], names=["query_id", "vec_id", "score"])
        self.rows = {}


def search(df: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `queries` its k nearest rows of df, but for the row of its own key.

    Nearest is the largest inner product, ties go to the smaller key; equal vectors are rows of their own. Vectors that are null, zero, not finite, or of another
    length than that of the smallest key take no part, on either side. Keys are unique integers. A query with at most k candidates gets all of them. An empty table gives
    no rows, and other columns are not carried, whatever their names. Lists are probed at any size; a table of few rows has few.
    """
    spark = df.sparkSession
    size, form = vectors.dimension(df, key, vector), vectors.packing(df, vector)
    form = "<f8" if vectors.packing(queries, vector) == "<f8" else form
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not size:
        return spark.createDataFrame([], empty)
    rows = vectors.prepared(df, key, vector, size)
    held = spark.sparkContext.broadcast(fit(rows, size, k))  # SAMPLE vectors and a centre for each PER_LIST of them at most

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = vectors.matrix(batch.column("v"), size)
                yield packed(batch.column("id").to_numpy(), x, held.value.lists(x), np.arange(len(x)))

    def packed(ids: np.ndarray, x: np.ndarray, lists: np.ndarray, row: np.ndarray, least: np.ndarray | None = None) -> pa.RecordBatch:
        order = np.argsort(lists, kind="stable")
        lists, row = lists[order], row[order]
        cut = np.concatenate([[0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]])
        spans = list(zip(cut[:-1], cut[1:], strict=True))
        side = "q" if least is not None else "x"
        columns = [pa.array([int(lists[a]) for a, _ in spans], pa.int32()), pa.array([b - a for a, b in spans], pa.int64()), pa.array([ids[row[a:b]].astype("<i8").tobytes() for a, b in spans]), pa.array([x[row[a:b]].astype(form).tobytes() for a, b in spans])]
        names = ["list", f"{side}_n", f"{side}_ids", f"{side}_body"]
        if least is not None:
            columns.append(pa.array([least[row[a:b]].astype("<f8").tobytes() for a, b in spans]))
            names.append("least")
        return pa.RecordBatch.from_arrays(columns, names=names)

    lists = common.stage(rows.mapInArrow(listed, "list int, x_n bigint, x_ids binary, x_body binary"), "lists")
    counts = np.zeros(len(held.value.centers), np.int64)
    for r in lists.groupBy("list").agg(F.sum("x_n").alias("n")).collect():  # a row for each list
        counts[r["list"]] = r["n"]

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, PACKED):
                batch = whole.slice(at, PACKED)
                ids, q = batch.column("id").to_numpy(), vectors.matrix(batch.column("v"), size)
                order = index.order(q)
                before = np.cumsum(counts[order], axis=1) - counts[order]
                probed = (np.arange(order.shape[1])[None] < index.probes) | (before < 4 * index.k + 1)
                row, place = np.nonzero(probed)
                by_list = np.zeros(probed.shape, bool)
                by_list[row, order[row, place]] = True
                yield packed(ids, q, order[row, place], row, index.least(ids, q, by_list))

    asked = vectors.prepared(queries, key, vector, size)
    some = asked.repartition(max(1, -(-asked.count() // PACKED)))
    wanted = common.stage(some.mapInArrow(routed, "list int, q_n bigint, q_ids binary, q_body binary, least binary"), "queries")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, best = held.value, Nearest(k)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x, query_ids, q, start = (np.frombuffer(batch.column(c)[r].as_py(), t) for c, t in (("x_ids", "<i8"), ("x_body", form), ("q_ids", "<i8"), ("q_body", form), ("least", "<f8")))
                x, q = x.reshape(-1, size).astype(float), q.reshape(-1, size).astype(float)
                i, j, score = scan(index, ids, x, query_ids, q, best.least(query_ids, start))
                cut = np.searchsorted(i, np.arange(len(q) + 1))
                for n in np.unique(i).tolist():
                    best.add(int(query_ids[n]), score[cut[n] : cut[n + 1]], ids[j[cut[n] : cut[n + 1]]])
                if len(best.rows) > HELD:
                    yield from best.out()
        yield from best.out()


    found = lists.join(wanted, "list").mapInArrow(scanned, "query_id bigint, vec_id bigint, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
