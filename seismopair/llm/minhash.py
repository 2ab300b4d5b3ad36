"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A signature estimates the probability Jaccard similarity of two texts' word shingles weighted by their counts,

    J(u, v) = sum over x of 1 / sum over y of max(u_y / u_x, v_y / v_x).

Each shingle is a Poisson process of arrivals at a rate of its weight; each arrival falls into a random register, and a
register holds the shingle that arrived first. A shingle's process ends once its time is past the last
register's, so that most stop after one arrival.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from ..operators.graph import components

SHINGLE = 5
THRESHOLD = 0.8
#: At 0.8 a pair shares no band once in 20,000 times.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: From this count on a packed set holds it in eight bytes instead of two.
ESCAPE = 65535


def weighted(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), by row and shingle; texts in any case, shingles of 48 bits."""
    import pyarrow.compute as pc

    body, starts = common.flat(pc.utf8_lower(texts.cast(pa.string())))
    row, value = common.shingles(*common.words(body, starts), size)
    key = np.sort(row.astype(np.uint64) << np.uint64(48) | value >> np.uint64(16)) if len(starts) < 1 << 16 else None
    if key is None:
        raise ValueError("a piece of a batch holds at most 65,535 rows")
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, int)
    key, count = key[at], np.diff(np.append(at, len(key)))
    return (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1), count


def signatures(row: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int = REGISTERS) -> np.ndarray:
    """n rows of `registers` shingles; a row without shingles has zeros."""
    first = np.full(n * registers, np.inf)
    held = np.zeros(n * registers, np.uint64)
    live, state, time = np.arange(len(row)), common.mix(element + np.uint64(0x51ED27)), np.zeros(len(row))
    rate = weight.astype(float)
    last = np.full(n, np.inf)
    while len(live):
        state = common.mix(state + np.uint64(0x9E3779B97F4A7C15))
        time = time - np.log(((state >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)) / rate[live]
        still = time < last[row[live]]
        live, state, time = live[still], state[still], time[still]
        register = row[live] * registers + ((common.mix(state) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = first[register] == time
        held[register[won]] = element[live[won]]
        last = first.reshape(n, registers).max(axis=1)
    return held.reshape(n, registers)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    total = np.zeros((len(signature), BANDS), np.uint64)
    parts = signature.reshape(len(signature), BANDS, ROWS)
    for k in range(ROWS):
        total = common.mix(total + parts[:, :, k] + np.uint64(k + 1))
    return common.mix(total + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def similarity(u: tuple[np.ndarray, np.ndarray], v: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two (sorted shingles, counts); 0 if either is empty."""
    if not len(u[0]) or not len(v[0]):
        return 0.0
    every = np.union1d(u[0], v[0])
    a, b = np.zeros(len(every)), np.zeros(len(every))
    a[np.searchsorted(every, u[0])] = u[1]
    b[np.searchsorted(every, v[0])] = v[1]
    both = (a > 0) & (b > 0)
    if a.max() == 1 and b.max() == 1:
        return both.sum() / len(every)
    with np.errstate(divide="ignore"):
        ratio = a / b
    order = np.argsort(-ratio, kind="stable")
    ratio, a, b, both = ratio[order], a[order], b[order], both[order]
    rest = b.sum() - np.cumsum(b)
    sums = np.cumsum(a)
    # members of one ratio weigh alike on either side, so each may be split where it stands
    return float((1 / (sums[both] / a[both] + rest[both] / b[both])).sum())


def pack(row: np.ndarray, element: np.ndarray, count: np.ndarray, n: int) -> list[bytes]:
    """Each row's shingles, six bytes each, then their counts, two bytes each.

    A count of 65,535 or more is written as 65,535, and whole, in eight bytes, behind the others; the number of these ends
    such a row in four bytes, by which its length is told from a row's without any.
    """
    cut = np.searchsorted(row, np.arange(n + 1)).tolist()
    six = np.ascontiguousarray(element.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
    two = np.minimum(count, ESCAPE).astype("<u2")
    out = [six[a:b].tobytes() + two[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    large = np.flatnonzero(count >= ESCAPE)
    for i in np.unique(row[large]).tolist():
        own = large[row[large] == i]
        out[i] += count[own].astype("<u8").tobytes() + np.array(len(own), "<u4").tobytes()
    return out


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    large = int.from_bytes(data[-4:], "little") if len(data) % 8 else 0
    n = len(data) // 8 - large
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n).reshape(-1, 6)
    count = np.frombuffer(data, "<u2", n, 6 * n)
    if large:
        count = count.astype(np.int64)
        count[count == ESCAPE] = np.frombuffer(data, "<u8", large, 8 * n)
    return wide.view("<u8").ravel(), count


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, digest, bands): a digest of the whole text and the keys of its bands (null for a text without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "_text"):
            row, element, count = weighted(batch.column("_text"))
            keys = band_keys(signatures(row, element, count, batch.num_rows)).view(np.int64)
            seen = np.bincount(row, minlength=batch.num_rows) > 0
            digest = [None if t is None else hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in batch.column("_text").to_pylist()]
            bands = pa.array([k.tobytes() if s else None for k, s in zip(keys, seen, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(digest, pa.binary()), bands], names=[key, "digest", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return common.small_batches(docs.select(F.col(key), F.col(text).alias("_text"))).mapInArrow(run, f"`{key}` {kind}, digest binary, bands binary")


def sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, set): the packed shingles of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "_text"):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pack(*weighted(batch.column("_text")), batch.num_rows), pa.binary())], names=["id", "set"])

    return common.small_batches(docs.select(F.col(key).alias("id"), F.col(text).alias("_text"))).mapInArrow(run, "id bigint, set binary")


def similar(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Similarity of the packed sets left[i] and right[i], for each i.

    All sets without repeated shingles are compared at once, by one sort; the others one by one.
    """
    out = np.zeros(len(left))
    for at in range(0, len(left), 1 << 12):
        one, two = ([unpack(x) for x in side[at : at + (1 << 12)]] for side in (left, right))
        sizes = np.array([(len(u[0]), len(v[0])) for u, v in zip(one, two, strict=True)]).reshape(-1, 2)
        plain = np.array([(u[1] == 1).all() and (v[1] == 1).all() for u, v in zip(one, two, strict=True)], bool)
        own = np.flatnonzero(plain)
        every = np.concatenate([np.zeros(0, np.uint64), *(part[k][0] | np.uint64(i << 48) for i, k in enumerate(own.tolist()) for part in (one, two))])
        every.sort()
        shared = np.bincount((every[1:][every[1:] == every[:-1]] >> np.uint64(48)).astype(np.int64), minlength=len(own))
        out[at + own] = shared / np.maximum(sizes[own].sum(1) - shared, 1)
        for k in np.flatnonzero(~plain).tolist():
            out[at + k] = similarity(one[k], two[k])
    return out


def verified(pairs: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs (a, b) that are similar enough, from the sets of their ends; a staged table."""
    half = pairs.join(of.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    rows = half.join(of.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = similar(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())], names=["a", "b", "similarity"]).filter(pa.array(value >= threshold, pa.bool_()))

    return common.stage(rows.mapInArrow(run, "a bigint, b bigint, similarity double"), "verified")


#: Members of a bucket that are compared with one another, or with as many others, at a time.
BLOCK = 256


def compare(left: list[tuple], right: list[tuple] | None, threshold: float) -> list[tuple[int, int]]:
    """Links (a, b) that join what no link joined before, among members (id, component, packed set) of a block, or of two.

    Shared weight is found for all pairs at once by products of matrices over the members' shingles. It decides pairs
    without repeated shingles outright, and bounds the similarity of the others from above before it is computed.
    """
    every = left + (right or [])
    n = len(left)
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    parts = [unpack(m[2]) for m in every]
    sizes = [len(p[0]) for p in parts]
    if not sum(sizes):
        return []
    column_of, column = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    row = np.repeat(np.arange(len(every)), sizes)
    weight = np.concatenate([p[1] for p in parts]).astype(np.float64)
    total = np.bincount(row, weight, len(every))
    kind = np.float32 if total.max() < 1 << 24 else np.float64  # sums of whole numbers are exact in either
    ones = np.bincount(row, weight > 1, len(every)) == 0
    other = range(n, len(every)) if right is not None else range(n)
    m = len(other)
    mass, count = np.zeros((2, n, m)), np.zeros((n, m))
    for at in range(0, len(column_of), 8192):
        own = (column >= at) & (column < at + 8192)
        here, some = np.zeros((2, len(every), min(8192, len(column_of) - at)), kind)
        here[row[own], column[own] - at] = 1
        some[row[own], column[own] - at] = weight[own]
        b = here[n:] if right is not None else here
        c = some[n:] if right is not None else some
        count += here[:n] @ b.T
        mass[0] += some[:n] @ b.T
        mass[1] += here[:n] @ c.T
    totals, sized, single = total[list(other)], np.array(sizes)[list(other)], ones[list(other)]
    jaccard = count / np.maximum(np.array(sizes)[:n, None] + sized[None] - count, 1)
    bound = np.minimum(mass[0] / np.maximum(total[:n, None], 1), mass[1] / np.maximum(totals[None], 1))
    plain = ones[:n, None] & single[None]
    maybe = np.where(plain, jaccard >= threshold, bound >= threshold - 1e-9)
    if right is None:
        maybe &= np.arange(m)[None] > np.arange(n)[:, None]
    i, j = np.nonzero(maybe)
    order = np.argsort(~plain[i, j], kind="stable")  # sure links first: they spare others their test
    found = []
    for i, j in zip(i[order].tolist(), j[order].tolist(), strict=True):
        k = other[j]
        a, b = root(every[i][1]), root(every[k][1])
        if a != b and (plain[i, j] or similarity(parts[i], parts[k]) >= threshold):
            up[max(a, b)] = min(a, b)
            found.append((every[i][0], every[k][0]))
    return found


def _bucket_rows(heads: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("bands").to_pylist()), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("id").to_numpy(), BANDS)), pa.array(keys)], names=["id", "band"])

    return heads.select("id", "bands").mapInArrow(run, "id bigint, band bigint")


def _within(rows: DataFrame, buckets: DataFrame, labels: DataFrame, of: DataFrame, threshold: float) -> DataFrame:
    """Links within buckets of three or more whose members the stars haven't all joined: a staged table (a, b).

    Members are dealt to blocks. A component with BLOCK members or more in a bucket has blocks of its own, the smaller ones
    share blocks; two blocks of one component have nothing left to find, and all other pairs of a bucket's blocks are compared whole. So a
    bucket of one large component and some strays costs in proportion to its size. Pairs of blocks travel as ids, and
    bodies join them.
    """
    large = rows.join(buckets.where("n > 2"), "band").select("band", "id", "n")
    marked = common.stage(large.join(labels, "id", "left").select("band", "id", "n", F.coalesce("component", "id").alias("component")), "marked")
    # of buckets with the same members one is enough; two sums of 64 bits and the count stand for the members
    same = [F.bit_xor(F.xxhash64("id", F.lit(seed))).alias(f"members{seed}") for seed in (3, 11)]
    seen = marked.groupBy("band").agg(*same, F.first("n").alias("n"), F.min("component").alias("low"), F.max("component").alias("high"))
    chosen = seen.where("low <> high").groupBy("members3", "members11", "n").agg(F.min("band").alias("band")).select("band")
    member = common.stage(marked.join(chosen, "band").select("band", "id", "component"), "members")
    sizes = common.stage(member.groupBy("band", "component").agg(F.count(F.lit(1)).alias("size")).withColumn("own", F.col("size") >= BLOCK), "sizes")
    band = sizes.groupBy("band").agg(F.coalesce(F.sum(F.when(~F.col("own"), F.col("size"))), F.lit(0)).alias("pooled"), F.bool_or("own").alias("any_own"))
    placed = member.join(sizes, ["band", "component"]).join(band, "band").withColumn("one", ~F.col("any_own") & (F.col("pooled") <= BLOCK))

    def alone(group: pa.Table) -> pa.Table:
        return told(compare(list(zip(*(group[c].to_pylist() for c in ("id", "component", "set")), strict=True)), None, threshold))

    def told(links: list[tuple[int, int]]) -> pa.Table:
        return pa.table({"a": pa.array([x[0] for x in links], pa.int64()), "b": pa.array([x[1] for x in links], pa.int64())})

    # a bucket of one block is compared where its members meet
    within = placed.where("one").select("band", "id", "component").join(of, "id").groupBy("band").applyInArrow(alone, "a bigint, b bigint")
    many = F.ceil(F.when(F.col("own"), F.col("size")).otherwise(F.col("pooled")) / BLOCK).cast("int")
    part = F.pmod(F.when(F.col("own"), F.xxhash64("id", "band")).otherwise(F.xxhash64("component", "band")), many).cast("int")
    placed = placed.where("not one").select("band", "id", "component", F.when(F.col("own"), F.col("component")).alias("of"), part.alias("part"))
    made = placed.join(of, "id").groupBy("band", "of", "part").agg(F.collect_list(F.struct("id", "component", "set")).alias("members"))
    full = common.stage(made.withColumn("block", F.monotonically_increasing_id()), "blocks")
    ids = full.select("band", "of", "block")
    other = ids.select("band", F.col("of").alias("of_2"), F.col("block").alias("block_2"))
    mixed = ids.where("of is null").join(other, "band").where("of_2 is not null or block_2 >= block")
    several = sizes.where("own").groupBy("band").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    apart = ids.where("of is not null").join(several, "band", "left_semi").join(other, "band").where("of < of_2")
    pairs = mixed.unionByName(apart).select(F.least("block", "block_2").alias("low"), F.greatest("block", "block_2").alias("high"))
    ends = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("block"))
    dealt = ends.join(full.select("block", "members"), "block")

    def run(group: pa.Table) -> pa.Table:
        sides = {row["block"]: [(m["id"], m["component"], m["set"]) for m in row["members"]] for row in group.select(["block", "members"]).to_pylist()}
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        return told(compare(sides[low], None if low == high else sides[high], threshold))

    out = common.stage(within.unionByName(dealt.groupBy("low", "high").applyInArrow(run, "a bigint, b bigint")), "links")
    common.release(marked, member, sizes, full)
    return out


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: key, class_id, component_id, kept.

    class_id is the smallest key of the same text, component_id the smallest key that links of similarity >= threshold
    reach, and kept whether that is the row's own. A text that is null or has no word, and a row with a null key, is alone (its ids are
    its own key). A text of fewer than five words is one shingle; texts of any length are read whole. Rows that share a key are one document to the links.
    An empty table gives none, and other columns of docs are not carried, whatever their names.
    """
    base = common.stage(sketches(docs, key, text).withColumn("id", F.col(key).cast("bigint")).drop(*([key] if key != "id" else [])), "sketches")
    some = base.where("id is not null and bands is not null")
    first = common.stage(some.groupBy("digest").agg(F.min("id").alias("class_id")), "classes")  # a table, so that copies of a hot text part in the joins
    classed = common.stage(some.select("id", "digest").join(first, "digest").select("id", "class_id"), "classed")
    heads = common.stage(some.join(first.select(F.col("class_id").alias("id"), "digest"), ["id", "digest"]).select("id", "bands").dropDuplicates(["id", "bands"]), "heads")
    rows = _bucket_rows(heads)
    buckets = common.stage(rows.groupBy("band").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    stars = common.stage(rows.join(buckets, "band").where("id <> head").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct(), "stars")
    # a table, whose size the planner knows: while its ids are few they go to the texts, and not the texts to them
    wanted = common.stage(stars.select(F.col("a").alias(key)).unionAll(stars.select(F.col("b").alias(key))).distinct(), "wanted")
    of = common.stage(sets(docs.select(F.col(key).cast("bigint").alias(key), F.col(text)).join(wanted, key).dropDuplicates([key]), key, text), "sets")
    sure = verified(stars, of, threshold)
    links = sure.select("a", "b")
    joined = components(links)
    more = _within(rows, buckets, joined, of, threshold)
    labels = components(links.unionAll(more))
    common.release(first, heads, buckets, stars, wanted, of, sure, joined, more)
    # copies have their head's component
    found = classed.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    alone = base.where("id is null or bands is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    kind = docs.schema[key].dataType
    return found.unionAll(alone).select(F.col("id").cast(kind).alias(key), "class_id", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
