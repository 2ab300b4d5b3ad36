"""Average linkage of components whose pairs travel many to a row."""

from fractions import Fraction

import numpy as np
import pytest

from seismopair.operators import blocks, graph
from seismopair.plans import registry


def plain(d, cut):
    """By exact fractions; ties go to the pair that stands first."""
    groups = {i: [i] for i in range(len(d))}
    while True:
        means = [(sum(Fraction(int(d[x][y])) for x in groups[i] for y in groups[j]) / (len(groups[i]) * len(groups[j])), i, j) for i in groups for j in groups if i < j]
        if not means or min(means)[0] > cut:
            return [next(i for i, g in groups.items() if x in g) for x in range(len(d))]
        _, i, j = min(means)
        groups[i] += groups.pop(j)


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("dtype", [np.int32, float])
def test_average_linkage_against_fractions(seed, dtype):
    rng = np.random.default_rng(seed)
    d = rng.integers(0, 12 if seed % 2 else 200, (24, 24))
    d = np.minimum(d, d.T)
    for cut in (2, 60, 300):
        assert graph.average_linkage(d[np.triu_indices(24, 1)].astype(dtype), 24, cut).tolist() == plain(d, cut)


def test_average_linkage_of_a_few_thousand_ends():
    """Each merge used to look at all distances anew."""
    n = 3000
    d = np.random.default_rng(1).integers(0, 200, n * (n - 1) // 2).astype(np.int32)
    assert len(np.unique(graph.average_linkage(d, n, 1))) < n


def clusters(rows):
    found = {}
    for r in rows.collect():
        found.setdefault(r.cluster, set()).add(r.evid)
    return {k: sorted(v) for k, v in found.items()}


def test_packed_pairs_give_what_rows_give(spark, sf, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS", 50)
    monkeypatch.setattr(graph, "HELD", 500)
    rows = registry.correlated(spark, sf).selectExpr("evid1", "evid2", "bround(cc * 100) / 100 AS cc").cache()
    want = clusters(graph.upgma(rows, 0.3))
    w = registry.fx.waveforms(spark, sf)
    some = rows.where(f"cc >= 0.3 OR cc = {rows.selectExpr('min(cc)').first()[0]}")
    assert clusters(graph.upgma(some, 0.3, lambda part: blocks.packed(w, part, 3))) == want and len(want) > 5
    assert all(k == v[0] for k, v in want.items())
    # the same, where cc are no hundredths
    assert clusters(graph.upgma(rows.selectExpr("evid1", "evid2", "cc + 1e-5 AS cc"), 0.30001)) == want


def test_family_query_stores_links_and_the_least(spark, sf, monkeypatch):
    stored = []
    monkeypatch.setattr(registry, "stage", lambda df, name, real=registry.stage: stored.append(real(df, name)) or stored[-1])
    assert registry.QUERIES["families_upgma"](spark, sf).count()
    every = registry.correlated(spark, sf).selectExpr("bround(cc * 100) AS c")
    assert stored[0].where("cc_x100 >= 38").count() == every.where("c >= 38").count()
    assert stored[0].selectExpr("min(cc_x100)").first()[0] == every.selectExpr("min(c)").first()[0] and stored[0].count() < every.count() / 4
