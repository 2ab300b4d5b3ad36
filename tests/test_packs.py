"""The last row of each key by packed rows against the plain rule."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from seismopair.operators import packs, pairs
from seismopair.plans import registry


def plain(stored, new, keys, order):
    both = stored.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    last = Window.partitionBy(*keys).orderBy(F.desc("_batch"), F.desc(order))
    return both.withColumn("_rank", F.row_number().over(last)).where("_rank = 1").drop("_rank", "_batch")


def told(df):
    return sorted((tuple(str(v) if v != v else v for v in r) for r in df.collect()), key=str)


KINDS = {"seq int": int, "seq bigint": lambda v: int(v) << 40, "seq double": lambda v: float("nan") if v == 49 else v / 7, "seq string": lambda v: f"{v:03}", "seq timestamp": lambda v: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=int(v)), "seq date": lambda v: datetime.date(2024, 1, 1) + datetime.timedelta(days=int(v))}


@pytest.mark.parametrize("kind", KINDS)
def test_upsert_by_packs(spark, monkeypatch, kind):
    """Repeated, null and many keys, null orders, values of each kind, and more than one pack and bucket."""
    monkeypatch.setattr(packs, "HELD", 97)
    monkeypatch.setattr(packs, "BUCKET", 60)
    rng, sides = np.random.default_rng(9), []
    for n in (400, 300):
        rows = []
        for i, (a, b, t) in enumerate(rng.integers(0, [9, 40, 3], (n, 3)).tolist()):
            # an order and a key have one value, so that no tie is left open
            v = int(rng.integers(0, 50))
            rows.append((f"e{a}" if a else None, b if b else None, f"t{t}", None if v == 3 else KINDS[kind](v), None if v == 9 else (v + b) * 70000, [v / 2] if v % 2 else None))
        sides.append(spark.createDataFrame(rows, f"evid1 string, evid2 bigint, trace_id string, {kind}, cc_x100 int, more array<double>"))
    want = told(plain(*sides, ("evid1", "evid2", "trace_id"), "seq"))
    found = pairs.upserted(*sides)
    assert 400 < len(want) < 650 and told(found) == want and found.dtypes == sides[0].dtypes
    assert told(pairs.upserted(*sides, keys=("evid2",)).select("evid2")) == told(plain(*sides, ("evid2",), "seq").select("evid2"))
    none = sides[0].limit(0)
    assert told(pairs.upserted(none, sides[1])) == told(plain(none, sides[1], ("evid1", "evid2", "trace_id"), "seq")) and not told(pairs.upserted(none, none))


def test_a_repeated_key_leaves_a_task_once(spark, monkeypatch):
    packed, frame = [], type(spark.range(0))
    monkeypatch.setattr(frame, "groupBy", lambda self, *c, real=frame.groupBy: (packed.append(self), real(self, *c))[1])
    rows = spark.range(0, 40000, 1, 2).selectExpr("'a' AS evid1", "'b' AS evid2", "'t' AS trace_id", "id AS seq")
    assert told(pairs.upserted(rows, rows.where("id < 7"))) == [("a", "b", "t", 6)]
    assert [r.n for r in packed[-1].selectExpr("length(_blob) AS n").collect() if r.n > 4000] == []


def test_upsert_query_sends_no_row_for_a_pair(spark, sf):
    """Exchanges move blobs, or traces: none has a pair's names, as the sort of all stored pairs had."""
    plan = registry.QUERIES["pair_upsert_last_wins"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert moved and all("evid" not in line for line in moved)
