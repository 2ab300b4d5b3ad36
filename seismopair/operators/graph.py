"""Connected components, greedy families and average linkage over link tables."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import release, small, stage

#: Pairs that are packed together, and events whose components may be sent to every executor.
HELD = 1 << 19


def _contracted(links: DataFrame, parent: DataFrame) -> DataFrame:
    """Links between the parents of their ends, without loops and repeats."""
    for end in ("a", "b"):
        to = parent.select(F.col("id").alias(end), F.col("up").alias("_up"))
        links = links.join(to, end, "left").withColumn(end, F.coalesce("_up", end)).drop("_up")
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return stage(ordered.distinct(), "links")


def components(links: DataFrame, jumps: int = 1) -> DataFrame:
    """(id, component): the smallest id reachable, for each id in the links (a, b), given in either direction.

    Each round points every node at its smallest neighbour, shortens the pointers and contracts the links;
    stars end in a round, and any graph in a number of rounds about the logarithm of its longest path. Nothing
    reaches the driver but whether links are left. A round's tables go once the next round's stand; pointers are a table
    before each jump, so that both sides of its join are plain exchanges and the rows of a hot node part.
    """
    ordered = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = stage(ordered, "links")
    labels = left.select("a").unionAll(left.select("b")).distinct().select(F.col("a").alias("id"), F.col("a").alias("component"))
    more = True
    while more:
        both = left.unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stage(both.groupBy("a").agg(F.least("a", F.min("b")).alias("up")).withColumnRenamed("a", "id"), "parents")
        for _ in range(jumps):
            old, over = parent, parent.select(F.col("id").alias("up"), F.col("up").alias("_over"))
            parent = stage(parent.join(over, "up", "left").select("id", F.coalesce("_over", "up").alias("up")), "parents")
            release(old)
        to = parent.select(F.col("id").alias("component"), "up")
        old = labels, left, parent
        labels = stage(labels.join(to, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")
        left = _contracted(left, parent)
        release(*old)
        more = left.limit(1).count() > 0
    release(left)
    return labels


def adjacency(pairs: DataFrame, order: str = "seq") -> DataFrame:
    """(a, b, cc) in both directions; of repeated pairs the last by `order` counts."""
    last = pairs.groupBy(F.least("evid1", "evid2").alias("a"), F.greatest("evid1", "evid2").alias("b")).agg(F.max_by("cc", order).alias("cc"))
    return last.unionAll(last.select(F.col("b").alias("a"), F.col("a").alias("b"), "cc"))


def average_linkage(sums: np.ndarray, n: int, cut: float) -> np.ndarray:
    """Cluster of each of n items, as its first item, by average linkage, merges up to height `cut` included; ties go to the pair that stands first.

    `sums` are the distances above the diagonal, row by row; those of clusters are added up in them, so that whole numbers stay exact. A row's nearest is looked up anew only when its turn comes:
    as averages lie between those they are made of, what is known of it can't be too large.
    """
    size, label, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    row = np.arange(n, dtype=np.int64)
    base = row * n - row * (row + 1) // 2 - row - 1  # the place of (i, j) is base[i] + j
    near, height, known = np.zeros(n, np.int64), np.full(n, np.inf), np.ones(n, bool)
    top, most = float(np.abs(sums).max(initial=0)), 1.0

    def look(i: int) -> None:
        height[i], known[i] = np.inf, True
        if i + 1 < n:
            mean = sums[base[i] + i + 1 : base[i] + n] / np.where(alive[i + 1 :], size[i] * size[i + 1 :], np.nan)
            mean[~alive[i + 1 :]] = np.inf
            near[i] = i + 1 + np.argmin(mean)
            height[i] = mean[near[i] - i - 1]

    for i in range(n):
        look(i)
    while n > 1:
        i = int(np.argmin(height))
        if not height[i] <= cut:
            break
        if not known[i]:
            look(i)
            continue
        j = int(near[i])
        most = max(most, size[i] + size[j])
        if sums.dtype == np.int32 and top * most * most >= 2**31:
            sums = sums.astype(np.int64)
        sums[base[:i] + i] += sums[base[:i] + j]
        sums[base[i] + i + 1 : base[i] + j] += sums[base[i + 1 : j] + j]
        sums[base[i] + j + 1 : base[i] + n] += sums[base[j] + j + 1 : base[j] + n]
        size[i] += size[j]
        alive[j], height[j] = False, np.inf
        label[label == j] = i
        known &= ~((near == i) | (near == j))
        look(i)
    return label


_PACKED = "component string, one array<string>, two array<string>, n bigint, hundredths boolean, pairs binary"


def packed(component: str, one: pa.Array, two: pa.Array, i: np.ndarray, j: np.ndarray, cc: np.ndarray) -> pa.RecordBatch:
    """A row for pairs of names, by their places: `cc` are whole hundredths, or doubles."""
    body = b"".join(np.diff(x, prepend=0).astype("<i4").tobytes() for x in (i, j)) + cc.astype("<i2" if cc.dtype.kind == "i" else "<f8").tobytes()
    lists = [pa.array([x.to_pylist()], pa.list_(pa.string())) for x in (one, two)]
    return pa.RecordBatch.from_arrays([pa.array([component], pa.string()), *lists, pa.array([len(i)], pa.int64()), pa.array([cc.dtype.kind == "i"]), pa.array([zlib.compress(body, 1)], pa.binary())], names=["component", "one", "two", "n", "hundredths", "pairs"])


def _packed_rows(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """Pairs within a component, many to a row; components travel to pairs where that is possible."""
    one, two = (small(part.select(F.col("id").alias(f"evid{k}"), F.col("component").alias(f"c{k}")), HELD) for k in (1, 2))
    rows = pairs.join(one, "evid1").join(two, "evid2").where("c1 = c2").select("c1", "evid1", "evid2", "cc")

    def told(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(held).combine_chunks()
        name = pc.dictionary_encode(whole["c1"].combine_chunks())
        code = name.indices.to_numpy()
        for k, c in enumerate(name.dictionary.to_pylist()):
            own = whole.take(pa.array(np.flatnonzero(code == k)))
            a, b = (pc.dictionary_encode(own[f"evid{x}"].combine_chunks()) for x in (1, 2))
            yield packed(c, a.dictionary, b.dictionary, a.indices.to_numpy().astype(np.int64), b.indices.to_numpy().astype(np.int64), _hundredths(own["cc"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD:
                yield from told(held)
                held, n = [], 0
        if n:
            yield from told(held)

    return rows.mapInArrow(run, _PACKED)


def _hundredths(cc: np.ndarray) -> np.ndarray:
    """cc in whole hundredths, if it is in such."""
    whole = np.rint(cc * 100)
    return whole.astype(np.int64) if np.array_equal(whole / 100, cc) and np.abs(whole).max(initial=0) < 2**15 else cc


def _clustered(least: float, cc_min: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        names = pc.unique(pa.chunked_array([x.column(c).flatten() for x in held for c in ("one", "two")]))
        names = names.take(pc.array_sort_indices(names))
        n = len(names)
        whole = _hundredths(np.array([least])).dtype.kind == "i" and all(pc.all(x.column("hundredths")).as_py() in (True, None) for x in held)
        scale = 100 if whole else 1
        sums = np.full(n * (n - 1) // 2, scale - round(scale * least) if whole else 1 - least, np.int32 if whole else float)
        while held:  # what is read may go
            batch = held.pop()
            for one, two, m, is_whole, blob in zip(*(batch.column(c) for c in ("one", "two", "n", "hundredths", "pairs")), strict=True):
                body, m = zlib.decompress(blob.as_py()), m.as_py()
                cc = np.frombuffer(body[8 * m :], "<i2" if is_whole.as_py() else "<f8")
                if is_whole.as_py() and not whole:
                    cc = cc / 100
                at = [np.asarray(pc.index_in(x.values, value_set=names)).astype(np.int64)[np.cumsum(np.frombuffer(body[4 * m * k : 4 * m * (k + 1)], "<i4"))] for k, x in enumerate((one, two))]
                i, j = np.minimum(*at), np.maximum(*at)
                sums[i * n - i * (i + 1) // 2 + j - i - 1] = scale - cc.astype(sums.dtype)
            del batch
        pa.default_memory_pool().release_unused()
        label = average_linkage(sums, n, scale * (1 - cc_min) + (1e-9 if whole else 1e-12))
        own = np.flatnonzero(np.bincount(label, minlength=n)[label] > 1)
        yield pa.RecordBatch.from_arrays([names.take(pa.array(x)) for x in (own, label[own])], names=["evid", "cluster"])

    return run


def upgma(pairs: DataFrame, cc_min: float, whole: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(evid, cluster) of clusters of two events or more, by average linkage on 1 - cc, cut at 1 - cc_min; a missing pair has the least cc of all.

    A merge below the cut takes a pair with cc >= cc_min, so clusters lie within components of such pairs and
    each component is clustered alone, on all the pairs inside it. cluster is the smallest evid. Pairs inside components travel `packed`; where `pairs` has but those of cc_min or more,
    and one of the least cc, `whole` makes all that are inside from (id, component).
    """
    least = pairs.agg(F.min("cc")).first()[0]
    if least is None:
        return pairs.select(F.col("evid1").alias("evid"), F.col("evid1").alias("cluster")).limit(0)
    part = stage(components(pairs.where(F.col("cc") >= cc_min).select(F.col("evid1").alias("a"), F.col("evid2").alias("b"))), "parts")
    inner = _packed_rows(pairs, part) if whole is None else whole(part)
    return inner.groupBy("component").applyInArrow(_clustered(least, cc_min), "evid string, cluster string")


def greedy(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """(evid, cluster) by the order-dependent rule: events in time order bring their closed neighbourhoods, each of which joins the first family that it overlaps.

    Families that come to overlap later aren't joined, so an event may be in several. Families stay within
    connected components, and each component is folded alone. cluster is `component#number`.
    """
    both = pairs.select(F.col("evid1").alias("a"), F.col("evid2").alias("b")).unionAll(pairs.select(F.col("evid2").alias("a"), F.col("evid1").alias("b"))).distinct()
    part = stage(components(pairs.select(F.col("evid1").alias("a"), F.col("evid2").alias("b"))), "parts")
    rows = both.join(part.withColumnRenamed("id", "a"), "a").join(events.select(F.col("evid").alias("a"), F.unix_micros("orig_time").alias("t")), "a")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set[str]] = {}
        for a, b in zip(group["a"], group["b"], strict=True):
            near.setdefault(a, {a}).add(b)
        families: list[set[str]] = []
        first: dict[str, int] = {}  # the first family that an event is in
        for _, a in sorted(set(zip(group["t"], group["a"], strict=True))):
            home = min((first[e] for e in near[a] if e in first), default=len(families))
            if home == len(families):
                families.append(set())
            families[home] |= near[a]
            for e in near[a]:
                first[e] = min(first.get(e, home), home)
        name = group["component"].iloc[0]
        found = [(e, f"{name}#{k}") for k, f in enumerate(families) for e in sorted(f)]
        return pd.DataFrame(found, columns=["evid", "cluster"])

    return rows.groupBy("component").applyInPandas(run, "evid string, cluster string")
