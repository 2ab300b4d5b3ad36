"""Near-duplicate vectors of equal label by cosine: cover trees and dual traversal give every pair over the threshold.

On vectors of length 1 a cosine is a distance. The vectors of a label are dealt to the nearest of some of their own, far from one another,
and those of each such cell again, until a cell is a block of bounded size. Within a block a cover tree nests levels of halving radii; it is built once
and stored. A pair of nodes, of the cells' tree as of the blocks' trees, is dropped if their centres are further apart than the threshold and both covering
radii, and counts whole if even the furthest members are near enough; else their children are paired. In the cells' tree a round
of joins takes all pairs of nodes a level further down; pairs of blocks that are left over are traversed by a task each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors
from ..operators.graph import components

THRESHOLD = 0.93
#: Members of a block, and of a leaf of its tree, at most; cells that a cell is cut into at most, and members that they are chosen from, about.
BLOCK, LEAF, FAN, SAMPLE = 4096, 24, 64, 512
#: Centres that are tried together, and rows of a product of matrices.
TRIED, ROWS = 64, 512
#: Distances are compared with this much room for rounding; what lies inside is decided by the cosine itself.
ROOM = 1e-7


class Tree:
    """Nodes as arrays over the members x in the tree's order: members start:end, centre (a member), covering radius, children first:last (none in a leaf)."""

    FIELDS = (("start", "<i4"), ("end", "<i4"), ("center", "<i4"), ("radius", "<f8"), ("first", "<i4"), ("last", "<i4"))

    def __init__(self, x: np.ndarray, **fields: np.ndarray):
        self.x = x
        for name, _ in self.FIELDS:
            setattr(self, name, fields[name])

    @classmethod
    def grown(cls, x: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of vectors of length 1, and the order of its members."""
        order = np.arange(len(x))
        start, end, center, radius, first, last = [0], [len(x)], [0], [_far(x, 0, order)], [0], [0]
        level, at = 2.0, 0
        while at < len(start) and level > 1e-7:
            to, level = len(start), level / 2
            for node in range(at, to):
                a, b = start[node], end[node]
                if b - a <= LEAF or radius[node] == 0:
                    continue
                first[node] = len(start)
                for c, part in _cover(x, order[a:b], center[node], level):
                    order[a : a + len(part)] = part
                    start.append(a)
                    end.append(a + len(part))
                    center.append(c)
                    radius.append(_far(x, c, part))
                    first.append(0)
                    last.append(0)
                    a += len(part)
                last[node] = len(start)
            at = to
        place = np.empty(len(x), np.int64)
        place[order] = np.arange(len(x))
        made = dict(zip((n for n, _ in cls.FIELDS), (start, end, place[center] if len(x) else [0], radius, first, last), strict=True))
        return cls(x[order], **{n: np.array(made[n], t) for n, t in cls.FIELDS}), order

    def stored(self) -> bytes:
        return b"".join(getattr(self, n).astype(t).tobytes() for n, t in self.FIELDS)

    @classmethod
    def read(cls, x: np.ndarray, data: bytes) -> Tree:
        n, at, fields = len(data) // 28, 0, {}
        for name, t in cls.FIELDS:
            fields[name] = np.frombuffer(data, t, n, at)
            at += fields[name].nbytes
        return cls(x, **fields)


def _distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def _far(x: np.ndarray, center: int, members: np.ndarray) -> float:
    return float(_distance((x[members] @ x[center]).min())) if len(members) > 1 else 0.0


def _cover(x: np.ndarray, members: np.ndarray, center: int, radius: float) -> list[tuple[int, np.ndarray]]:
    """(centre, members) of parts around members more than `radius` apart, the given one first; each member goes to the first centre that is near enough."""
    left = np.concatenate([[center], members[members != center]])
    parts = []
    while len(left):
        near = _distance(x[left] @ x[left[:TRIED]].T) <= radius
        tried = near.shape[1]
        near[np.arange(tried), np.arange(tried)] = True
        picks, covered = [], np.zeros(tried, bool)
        for k in range(tried):
            if not covered[k]:
                picks.append(k)
                covered |= near[:tried, k]
        chosen = near[:, picks]
        owner = np.where(chosen.any(1), chosen.argmax(1), len(picks))
        sort = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[sort], np.arange(len(picks) + 1))
        parts += [(int(left[p]), left[sort[a:b]]) for p, a, b in zip(picks, cut[:-1], cut[1:], strict=True)]
        left = left[sort[cut[-1] :]]
    return parts


def _near(one: np.ndarray, two: np.ndarray, radius_1: np.ndarray, radius_2: np.ndarray, most: float, own: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, column, whole) of the pairs of centres that are not too far apart, some rows at a time; with `own`, those above the diagonal and on it."""
    for at in range(0, len(one), ROWS):
        apart = _distance(one[at : at + ROWS] @ two.T)
        reach = radius_1[at : at + ROWS, None] + radius_2[None]
        maybe = apart <= most + reach + ROOM
        if own:
            maybe &= np.arange(len(two))[None] >= np.arange(at, at + len(apart))[:, None]
        i, j = np.nonzero(maybe)
        yield i + at, j, apart[i, j] + reach[i, j] <= most - ROOM


def pairs(one: Tree, two: Tree, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(members of one, members of two, all): all pairs between them, or the pairs position by position, are links.

    If both are one tree, each unordered pair comes once; if then both sides of `all` are the same members, these are linked with one another.
    """
    most, same = float(np.sqrt(2 - 2 * cosine)), one is two
    todo = [(0, 0)] if len(one.x) and len(two.x) else []
    while todo:
        a, b = todo.pop()
        apart = 0.0 if same and a == b else float(_distance(one.x[one.center[a]] @ two.x[two.center[b]]))
        if apart + one.radius[a] + two.radius[b] <= most - ROOM:
            yield np.arange(one.start[a], one.end[a]), np.arange(two.start[b], two.end[b]), True
            continue
        if not one.last[a] and not two.last[b]:
            link = one.x[one.start[a] : one.end[a]] @ two.x[two.start[b] : two.end[b]].T >= cosine
            if same and a == b:
                link = np.triu(link, 1)
            i, j = np.nonzero(link)
            if len(i):
                yield i + one.start[a], j + two.start[b], False
            continue
        first = np.arange(one.first[a], one.last[a]) if one.last[a] else np.array([a])
        second = np.arange(two.first[b], two.last[b]) if two.last[b] else np.array([b])
        for i, j, _ in _near(one.x[one.center[first]], two.x[two.center[second]], one.radius[first], two.radius[second], most, same and a == b):
            todo += zip(first[i].tolist(), second[j].tolist(), strict=True)


def links(one: Tree, two: Tree, weights: tuple[np.ndarray, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Weight that each member is linked with, in either tree, and links (positions, those of the second tree after the first's) that span them."""
    n, same = len(one.x), one is two
    counts = np.zeros(n), np.zeros(len(two.x))
    if same:
        counts = counts[0], counts[0]
    up = np.arange(n if same else n + len(two.x))
    shift = 0 if same else n
    spanning = []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            up[max(a, b)] = min(a, b)
            spanning.append((x, y))

    for i, j, every in pairs(one, two, cosine):
        if every and same and i[0] == j[0]:
            counts[0][i] += weights[0][i].sum() - weights[0][i]
            for x in i[1:].tolist():
                join(int(i[0]), x)
        elif every:
            counts[0][i] += weights[1][j].sum()
            counts[1][j] += weights[0][i].sum()
            for y in j.tolist():
                join(int(i[0]), y + shift)
            for x in i[1:].tolist():
                join(x, int(j[0]) + shift)
        else:
            np.add.at(counts[0], i, weights[1][j])
            np.add.at(counts[1], j, weights[0][i])
            for x, y in zip(i.tolist(), j.tolist(), strict=True):
                join(x, y + shift)
    return *counts, spanning


def pivots(x: np.ndarray, many: int) -> np.ndarray:
    """Vectors far from one another: each the furthest from those before; fewer than `many` if the others are equal to them."""
    chosen, far = [0], _distance(x @ x[0])
    while len(chosen) < min(many, len(x)) and far.max() > 1e-7:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(x @ x[chosen[-1]]))
    return x[chosen]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


PACKED = "node string, n bigint, ids binary, weights binary, body binary"


class Cells:
    """The cells of all labels as tables: blocks (label, node, n, ids, weights, body), and nodes (label, node, and of each child name, centre, radius, weight, least id, whether it is a block)."""

    def __init__(self, heads: DataFrame, size: int, form: str):
        self.size, self.form, self.kind = size, form, heads.schema["label"].dataType.simpleString()
        totals = heads.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
        dealt = heads.join(totals, "label").withColumn("part", F.pmod(F.xxhash64("head"), F.col("parts")))

        def packed(group: pa.Table) -> pa.Table:
            order = np.argsort(group["head"].to_numpy(), kind="stable")
            v = vectors.matrix(group["v"].combine_chunks(), size)[order]
            ids, weights = (group[c].to_numpy()[order].astype("<i8").tobytes() for c in ("head", "n"))
            return pa.table({"label": group["label"][:1], "node": [""], "n": [len(v)], "ids": pa.array([ids], pa.binary()), "weights": pa.array([weights], pa.binary()), "body": pa.array([v.astype(form).tobytes()], pa.binary())})

        open_ = common.stage(dealt.groupBy("label", "part").applyInArrow(packed, f"label {self.kind}, {PACKED}"), "cells")
        blocks, nodes, self.tables = [], [], [open_]
        while True:
            total = open_.groupBy("label", "node").agg(F.sum("n").alias("total"))
            blocks.append(open_.join(total.where(F.col("total") <= BLOCK), ["label", "node"], "left_semi"))
            large = common.stage(total.where(F.col("total") > BLOCK), "large")
            self.tables.append(large)
            if large.isEmpty():
                break
            open_, children = self._cut(open_.join(large, ["label", "node"]))
            nodes.append(children)
        self.blocks = common.stage(_union(blocks), "blocks")
        leaf = self.blocks.select("label", "node")
        child = F.struct("child", "center", "radius", "weight", "rep", F.col("node_").isNotNull().alias("block"))
        self.nodes = None
        if nodes:
            told = _union(nodes).join(leaf.select("label", F.col("node").alias("child"), F.col("node").alias("node_")), ["label", "child"], "left")
            self.nodes = common.stage(told.groupBy("label", "node").agg(F.sort_array(F.collect_list(child)).alias("children")), "nodes")

    def _cut(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(packed rows of the children of these nodes; label, node, child, center, radius, weight, rep of each child)."""
        size, form, depth = self.size, self.form, len(self.tables)

        def body(row: dict) -> np.ndarray:
            return np.frombuffer(row["body"], form).astype(float).reshape(-1, size)

        def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = batch.to_pylist()
                some = []
                for row in rows:
                    hashed = common.mix(np.frombuffer(row["ids"], "<u8") + np.uint64(depth))
                    some.append(body(row)[hashed <= np.uint64(min(1.0, SAMPLE / row["total"]) * float((1 << 64) - 1025))].astype("<f8").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("node"), batch.column("total"), pa.array(some, pa.binary())], names=["label", "node", "total", "some"])

        def chosen(group: pa.Table) -> pa.Table:
            total = group["total"][0].as_py()
            x = np.frombuffer(b"".join(sorted(group["some"].to_pylist())), "<f8").reshape(-1, size)
            many = int(np.clip(-(-total // (BLOCK // 2)), 2, FAN))
            found = pivots(_unit(x), many) if len(x) else x
            return pa.table({"label": group["label"][:1], "node": group["node"][:1], "pivots": pa.array([found.astype("<f8").tobytes()], pa.binary())})

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["label", "node", "child", "n", "ids", "weights", "body", "center", "radius", "weight", "rep"]
            for batch in batches:
                for k, row in enumerate(batch.drop_columns(["label"]).to_pylist()):
                    x, p = body(row), np.frombuffer(row["pivots"], "<f8").reshape(-1, size)
                    ids, weights = (np.frombuffer(row[c], "<i8") for c in ("ids", "weights"))
                    u = _unit(x)
                    if len(p) > 1:
                        cosine = u @ p.T
                        own = cosine.argmax(1)
                        center, mark = p, ""
                    else:  # vectors of one direction: dealt at random
                        many = -(-row["total"] // BLOCK) + 1
                        own = (common.mix(ids.astype(np.uint64) + np.uint64(77 + depth)) % np.uint64(many)).astype(np.int64)
                        center, mark = np.repeat(p if len(p) else np.eye(1, size), many, axis=0), "#"
                        cosine = u @ center.T
                    apart = _distance(cosine[np.arange(len(u)), own])
                    out = []
                    for c in np.unique(own).tolist():
                        m = np.flatnonzero(own == c)
                        out.append((row["node"], f"{row['node']}/{mark}{c}", len(m), ids[m].tobytes(), weights[m].tobytes(), x[m].astype(form).tobytes(), center[c].tobytes(), float(apart[m].max()) + ROOM, int(weights[m].sum()), int(ids[m].min())))
                    kinds = (pa.string(), pa.string(), pa.int64(), *[pa.binary()] * 4, pa.float64(), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("label")[k].as_py()] * len(out), batch.column("label").type)] + [pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

        def joined(group: pa.Table) -> pa.Table:
            made = {c: pa.array([b"".join(group[c].to_pylist())], pa.binary()) for c in ("ids", "weights", "body")}
            return pa.table({"label": group["label"][:1], "node": group["child"][:1], "n": [sum(group["n"].to_pylist())]} | made)

        key = f"label {self.kind}, node string"
        found = rows.mapInArrow(sampled, f"{key}, total bigint, some binary").groupBy("label", "node").applyInArrow(chosen, f"{key}, pivots binary")
        parts = common.stage(rows.join(found, ["label", "node"]).mapInArrow(split, f"{key}, child string, n bigint, ids binary, weights binary, body binary, center binary, radius double, weight bigint, rep bigint").withColumn("piece", F.monotonically_increasing_id()), "parts")
        child = common.stage(parts.groupBy("label", "node", "child").agg(F.first("center").alias("center"), F.max("radius").alias("radius"), F.sum("weight").alias("weight"), F.min("rep").alias("rep"), F.sum("n").alias("n")), "children")
        dealt = parts.join(child.select("label", "child", F.ceil(F.col("n") / BLOCK).alias("many")), ["label", "child"]).withColumn("part", F.pmod(F.xxhash64("piece"), F.col("many")))
        open_ = common.stage(dealt.select("label", "child", "part", "n", "ids", "weights", "body").groupBy("label", "child", "part").applyInArrow(joined, f"label {self.kind}, {PACKED}"), "cells")
        self.tables += [parts, child, open_]
        return open_, child.drop("n")

    def near(self, cosine: float) -> tuple[DataFrame, DataFrame | None]:
        """(pairs of blocks to traverse: label, a, b; pairs of nodes that are links as a whole: label, a, b, weight and least id of each)."""
        size, most = self.size, float(np.sqrt(2 - 2 * cosine))
        roots = self.blocks.where("node = ''").select("label", F.lit("").alias("a"), F.lit("").alias("b"))
        if self.nodes is None:
            return roots, None
        alone = F.struct(F.col("child"), "center", "radius", "weight", "rep", F.lit(True).alias("block"))
        # a block is its own only child
        single = self.nodes.select("label", F.explode("children").alias("c")).where("c.block").select("label", "c.*").select("label", F.col("child").alias("node"), F.array(alone).alias("children"))
        below = common.stage(self.nodes.unionByName(single), "below")
        self.tables.append(below)
        schema = f"label {self.kind}, a string, b string, weight_a bigint, weight_b bigint, rep_a bigint, rep_b bigint, kind int"

        def expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for label, row in zip(batch.column("label").to_pylist(), batch.drop_columns(["label"]).to_pylist(), strict=True):
                    one, two = row["one"], row["two"]
                    x, y = (np.frombuffer(b"".join(c["center"] for c in side), "<f8").reshape(-1, size) for side in (one, two))
                    r, s = (np.array([c["radius"] for c in side]) for side in (one, two))
                    for i, j, whole in _near(x, y, r, s, most, row["a"] == row["b"]):
                        for p, q, w in zip(i.tolist(), j.tolist(), whole.tolist(), strict=True):
                            c, d = one[p], two[q]
                            out.append((label, c["child"], d["child"], c["weight"], d["weight"], c["rep"], d["rep"], 2 if w else int(c["block"] and d["block"])))
                kinds = (batch.column("label").type, pa.string(), pa.string(), *[pa.int64()] * 4, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["label", "a", "b", "weight_a", "weight_b", "rep_a", "rep_b", "kind"])

        front = self.nodes.where("node = ''").select("label", F.lit("").alias("a"), F.lit("").alias("b"))
        found = []
        while True:
            sides = [below.select("label", F.col("node").alias(end), F.col("children").alias(name)) for end, name in (("a", "one"), ("b", "two"))]
            told = common.stage(front.join(sides[0], ["label", "a"]).join(sides[1], ["label", "b"]).mapInArrow(expanded, schema), "node-pairs")
            found.append(told)
            front = told.where("kind = 0").select("label", "a", "b")
            if front.isEmpty():
                break
        self.tables += found
        every = _union(found)
        return roots.unionByName(every.where("kind = 1").select("label", "a", "b")), every.where("kind = 2").drop("kind")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


FOUND = "a bigint, b bigint, n bigint"


def _told(ids: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Weights that members are linked with (b is null), and links."""
    none = np.zeros(len(a), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids, a])), pa.array(np.concatenate([np.zeros(len(ids), np.int64), b]), mask=np.concatenate([np.ones(len(ids), bool), none.astype(bool)])), pa.array(np.concatenate([n.astype(np.int64), none]))], names=["a", "b", "n"])


def _traversed(cells: Cells, near: DataFrame, cosine: float) -> DataFrame:
    """What is found inside the pairs of blocks: trees are built once for each block, and each pair is a group of its two ends."""
    size, form = cells.size, cells.form

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                x = np.frombuffer(row.column("body")[0].as_py(), form).reshape(-1, size)
                tree, order = Tree.grown(_unit(x.astype(float)))
                made = [pa.array([np.frombuffer(row.column(c)[0].as_py(), "<i8")[order].tobytes()], pa.binary()) for c in ("ids", "weights")]
                yield pa.RecordBatch.from_arrays([row.column("label"), row.column("node"), *made, pa.array([x[order].tobytes()], pa.binary()), pa.array([tree.stored()], pa.binary())], names=["label", "node", "ids", "weights", "body", "tree"])

    trees = common.stage(cells.blocks.select("label", "node", "ids", "weights", "body").mapInArrow(grown, f"label {cells.kind}, node string, ids binary, weights binary, body binary, tree binary"), "trees")
    cells.tables.append(trees)
    ends = near.select("label", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("node"))

    def traversed(group: pa.Table) -> pa.Table:
        sides = {}
        for row in group.drop_columns(["label"]).to_pylist():
            ids, weights = (np.frombuffer(row[c], "<i8") for c in ("ids", "weights"))
            sides[row["node"]] = (ids, weights.astype(float), Tree.read(_unit(np.frombuffer(row["body"], form).astype(float).reshape(len(ids), size)), row["tree"]))
        (ids, w, one), (ids_2, w_2, two) = (sides[group[end][0].as_py()] for end in ("a", "b"))
        counts, counts_2, spanning = links(one, two, (w, w_2), cosine)
        every = ids if one is two else np.concatenate([ids, ids_2])
        n = counts if one is two else np.concatenate([counts, counts_2])
        some = np.flatnonzero(n)
        a, b = (every[[s[k] for s in spanning]] if spanning else np.zeros(0, np.int64) for k in (0, 1))
        return pa.Table.from_batches([_told(every[some], n[some], a, b)])

    return ends.join(trees, ["label", "node"]).groupBy("label", "a", "b").applyInArrow(traversed, FOUND)


def _whole(cells: Cells, whole: DataFrame) -> DataFrame:
    """What pairs of nodes that are links as a whole mean for their members: a weight for each, a link of each to one of its partners, and links between the nodes' least ids."""
    both = whole.select("label", F.col("a").alias("up"), F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("weight_b")).alias("add"), F.when(F.col("a") == F.col("b"), F.col("weight_a")).otherwise(0).alias("own"), F.col("rep_b").alias("rep"))
    both = both.unionByName(whole.where("a <> b").select("label", F.col("b").alias("up"), F.col("weight_a").alias("add"), F.lit(0).alias("own"), F.col("rep_a").alias("rep")))
    node = both.groupBy("label", "up").agg(F.sum("add").alias("add"), F.sum("own").alias("own"), F.min("rep").alias("rep"))
    parts = F.split("node", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    leaf = cells.blocks.select("label", "node", F.explode(above).alias("up")).join(node, ["label", "up"])
    leaf = leaf.groupBy("label", "node").agg(F.sum("add").alias("add"), F.sum(F.col("own")).alias("own"), F.count_if(F.col("own") > 0).alias("selves"), F.collect_set("rep").alias("reps"))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, weights = (np.frombuffer(row[c], "<i8") for c in ("ids", "weights"))
                reps = np.array(row["reps"], np.int64)
                yield _told(ids, row["add"] + row["own"] - row["selves"] * weights, np.repeat(ids, len(reps)), np.tile(reps, len(ids)))

    members = cells.blocks.select("label", "node", "ids", "weights").join(leaf, ["label", "node"]).drop("label").mapInArrow(told, FOUND)
    return members.unionByName(whole.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), F.lit(0).cast("bigint").alias("n")))


def groups(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = THRESHOLD) -> DataFrame:
    """One row per row of df: key, n_links, component_id, kept, over links of cosine >= `cosine` between rows of equal label.

    A row with a null label or key, or a vector that is null, zero, not finite or of another length than that of the smallest key, has no
    link and is its own component. Equal vectors are linked; they are compared as one. Keys are unique integers. An empty table gives none, and other columns
    of df are not carried, whatever their names.
    """
    size, form = vectors.dimension(df, key, vector), vectors.packing(df, vector)
    rows = common.stage(vectors.prepared(df, key, vector, max(size, 1), F.col(label).alias("label")).where("label is not null"), "vectors")
    heads = common.stage(rows.groupBy("label", "v").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    cells = Cells(heads, max(size, 1), form)
    near, whole = cells.near(cosine)
    every = _traversed(cells, near, cosine)
    if whole is not None:
        every = every.unionByName(_whole(cells, whole))
    found = common.stage(every, "found")
    common.release(*cells.tables, cells.blocks, cells.nodes)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("others")).withColumnRenamed("a", "head")
    labels = components(found.where("b is not null").select("a", "b"))
    told = heads.join(counts, "head", "left").join(labels.withColumnRenamed("id", "head"), "head", "left")
    told = told.select("label", "v", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    linked = rows.join(told, ["label", "v"]).select("id", "n_links", "component_id")
    used = F.coalesce(vectors.usable(vector) & (F.size(vector) == max(size, 1)) & F.col(key).isNotNull() & F.col(label).isNotNull(), F.lit(False))
    alone = df.where(~used).select(F.col(key).cast("bigint").alias("id"), F.lit(0).cast("bigint").alias("n_links"), F.col(key).cast("bigint").alias("component_id"))
    every = linked.unionAll(alone)
    return every.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
