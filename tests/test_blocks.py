"""Pairs by blocks against plain ones; queries on pairs that make no row for each pair on the way."""

import numpy as np
import pytest

from seismopair.functions import signal
from seismopair.operators import blocks, graph, pairs
from seismopair.plans import registry


def waves(spark, n=60, seed=3):
    """Traces of two stations and two lengths, with copies, silence, a null one, an empty one, and an evid on both stations and twice on one."""
    rng = np.random.default_rng(seed)
    rows = [(f"e{i:03}", "AB"[i % 2], rng.normal(size=32 if i % 5 else 24).tolist()) for i in range(n)]
    rows[8] = ("e008", "A", rows[6][2])
    rows[10] = ("e010", "A", [1.0] * 32)
    rows += [("null", "A", None), ("none", "B", []), ("e000", "B", rows[3][2]), ("e004", "A", rows[2][2]), (None, "A", rows[2][2]), ("lost", None, rows[2][2])]
    return spark.createDataFrame(rows, "evid string, trace_id string, data array<double>")


def plain(w, lags, negative=False, mad=False):
    one, two = (w.selectExpr(f"evid AS evid{k}", "trace_id", f"data AS data{k}") for k in (1, 2))
    return signal.correlated(one.join(two, "trace_id").where("evid1 < evid2"), "data1", "data2", lags, negative, mad)


def rows_of(df, *more):
    return sorted(((r.evid1, r.evid2, r.trace_id, r.lag_samples, *(None if r[c] is None else round(r[c], 9) for c in ("cc", *more))) for r in df.collect()), key=str)


@pytest.mark.parametrize("lags, negative", [(3, False), (20, True), (70, False)])
def test_correlations_by_blocks(spark, monkeypatch, lags, negative):
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "HELD", 200)
    w = waves(spark)
    want = rows_of(plain(w, lags, negative, True), "cc_mad")
    assert len(want) > 900 and rows_of(blocks.correlated(w, lags, negative, True), "cc_mad") == want
    some = blocks.correlated(w, lags, negative, keep=lambda cc, _: cc > 0.3)
    assert rows_of(some) == [r[:5] for r in want if r[4] is not None and r[4] > 0.3]


def test_status_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 7)
    w = waves(spark).selectExpr("*", "IF(evid = 'e012', 50D, 100D) AS sampling_rate")
    have = w.where("evid <> 'e016'").dropDuplicates(["evid", "trace_id"])
    events = w.dropDuplicates(["evid", "trace_id"])
    one, two = (events.selectExpr(f"evid AS evid{k}", "trace_id") for k in (1, 2))
    told = lambda df: sorted(tuple(r) for r in df.select("evid1", "evid2", "trace_id", "status").collect())
    found = told(pairs.waveform_status(events, have))
    assert found == told(pairs.with_waveforms(one.join(two, "trace_id").where("evid1 < evid2"), have))
    assert {r[3] for r in found} == {"ok", "no_waveform", "dt_mismatch"}


def test_status_query_looks_up_no_waveform_for_a_pair(spark, sf, monkeypatch):
    monkeypatch.delattr(pairs, "with_waveforms")
    assert registry.QUERIES["pair_missing_waveform_status"](spark, sf).count() > 1000


def test_greedy_looks_at_no_family_but_the_first_that_it_overlaps(spark):
    """Against the rule as it is written, on a dense random graph."""
    rng = np.random.default_rng(5)
    names = [f"e{i:03}" for i in range(80)]
    links = sorted({(names[min(i, j)], names[max(i, j)]) for i, j in rng.integers(0, 80, (110, 2)) if i != j})
    ev = spark.createDataFrame([(e, i * 37 % 80) for i, e in enumerate(names)], "evid string, t long").selectExpr("evid", "timestamp_seconds(t) AS orig_time")
    near = {e: {e} | {b for a, b in links if a == e} | {a for a, b in links if b == e} for e in names}
    want = []
    for e in sorted((e for e in names if len(near[e]) > 1), key=lambda e: (names.index(e) * 37 % 80, e)):
        home = next((f for f in want if f & near[e]), None)
        if home is None:
            want.append(home := set())
        home |= near[e]
    found = {}
    for r in graph.greedy(spark.createDataFrame(links, "evid1 string, evid2 string"), ev).collect():
        found.setdefault(r.cluster, set()).add(r.evid)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want))


@pytest.mark.parametrize("name", ["family_summary", "family_selection", "family_distance_stats", "family_global_stats", "family_color_scale", "family_cumulative", "family_flag_update"])
def test_family_queries_store_links_only(spark, sf, monkeypatch, name):
    stored = []
    monkeypatch.setattr(registry, "stage", lambda df, name, real=registry.stage: stored.append(real(df, name)) or stored[-1])
    assert registry.QUERIES[name](spark, sf).count()
    assert stored[0].where("cc_x100 >= 38").count() == registry.correlated(spark, sf).where("bround(cc * 100) >= 38").count()
    assert stored[0].where("cc_x100 < 36").count() == 0


@pytest.mark.parametrize("name", ["pair_mad_ratio", "pair_crosscorr_abs", "pair_crosscorr_100hz"])
def test_correlation_queries_make_no_pair_row_with_samples(spark, sf, monkeypatch, name):
    monkeypatch.delattr(signal, "correlated")
    assert registry.QUERIES[name](spark, sf).columns[:2] == ["evid1", "evid2"]
