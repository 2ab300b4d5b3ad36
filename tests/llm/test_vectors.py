import numpy as np
import pytest

from seismopair.llm import ann, covertree

SCHEMA = "vec_id long, embedding array<float>, label int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y) for i, v, y in rows], SCHEMA)


def odd_rows():
    return [(9001, None, 0), (9002, [0.0] * 8, 0), (9003, [float("nan")] + [1.0] * 7, 0), (9004, [None] + [1.0] * 7, 0), (9005, [1.0] * 3, 0), (9006, [float("inf")] * 8, 0), (9007, [], 0), (9020, [0.0] * 8, 0)]


def test_search_of_a_small_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "RECALL", 1.0)  # the sample is the table, so the probes that it asks for find all
    monkeypatch.setattr(ann, "DEVIATIONS", 50.0)
    r = np.random.default_rng(0)
    x = r.standard_normal((60, 8)).astype(np.float32)
    x[7] = x[3]
    df = table(spark, [(i, v, 0) for i, v in enumerate(x)] + odd_rows())
    found = ann.search(df, df.where("vec_id % 20 = 0"), k=5)
    rows: dict[int, list] = {}
    for q in found.orderBy("query_id", "rank").collect():
        rows.setdefault(q.query_id, []).append((q.rank, q.vec_id, q.score))
    assert set(rows) == {0, 20, 40}
    for q, got in rows.items():
        score = x.astype(float) @ x[q].astype(float)
        want = sorted((i for i in range(60) if i != q), key=lambda i: (-score[i], i))[:5]
        assert [v for _, v, _ in got] == want and [k for k, *_ in got] == [1, 2, 3, 4, 5]
        assert all(s == pytest.approx(score[v], abs=1e-12) for _, v, s in got)
    few = ann.search(df.where("vec_id < 3"), df.where("vec_id = 0"), k=5)
    assert few.count() == 2
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("sample", [16_384, 800])
def test_search_recalls_nine_of_ten(spark, monkeypatch, sample):
    monkeypatch.setattr(ann, "SAMPLE", sample)  # fitted on all rows, and on a fifth
    monkeypatch.setattr(ann, "FLOOR", sample // 2)
    r = np.random.default_rng(1)
    x = r.standard_normal((4000, 16)) * r.uniform(0.5, 2, (4000, 1))
    x[1000:2200] = x[1000]
    df = table(spark, [(i, v, 0) for i, v in enumerate(x)])
    x = x.astype(np.float32).astype(float)
    found = ann.search(df, df.where("vec_id % 20 = 0"), k=20).collect()
    got: dict[int, set] = {}
    for q in found:
        got.setdefault(q.query_id, set()).add(q.vec_id)
    hits = 0
    for q in range(0, 4000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[q] & set(sorted(range(4000), key=lambda i: (-score[i], i))[:20]))
    assert all(len(v) == 20 for v in got.values()) and hits / (200 * 20) >= 0.9


def components(x, label, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= cosine) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    name = np.arange(len(x))
    while True:
        new = np.minimum(name, np.where(link, name[None], len(x)).min(1))
        if (new == name).all():
            return link.sum(1), name
        name = new


@pytest.mark.parametrize("block", [1024, 40])
def test_links_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    r = np.random.default_rng(2)
    centers = r.standard_normal((40, 8))
    x = (centers[r.integers(0, 40, 400)] + 0.22 * r.standard_normal((400, 8))).astype(np.float32)
    x[50:90] = x[50]
    label = r.integers(0, 3, 400)
    label[50:90] = 1
    rows = [(i, v, int(y)) for i, (v, y) in enumerate(zip(x, label))] + odd_rows() + [(9100, x[0], None), (9101, x[0], None)]
    found = {q.vec_id: q for q in covertree.groups(table(spark, rows)).collect()}
    n, name = components(x.astype(float), label, 0.93)
    assert len(found) == len(rows)
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (n[i], name[i], i == name[i]) for i in range(400))
    assert all(found[i].n_links == 0 and found[i].component_id == i and found[i].kept for i, *_ in rows[400:])


def test_no_links_in_an_empty_table(spark):
    assert covertree.groups(table(spark, [])).count() == 0
    assert covertree.groups(table(spark, odd_rows()[:1])).collect()[0].kept


def test_a_hot_label_is_cut_into_cells_and_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 64)
    monkeypatch.setattr(covertree, "SAMPLE", 40)
    r = np.random.default_rng(4)
    x = r.standard_normal((1500, 8))
    x[200:700] = x[200] + 0.01 * r.standard_normal((500, 8))  # a tight cluster of many blocks
    x[700:900] = x[700] * r.integers(1, 50, (200, 1))  # one direction
    x = x.astype(np.float32)
    label = np.where(np.arange(1500) < 1200, 0, 1)
    found = {q.vec_id: q for q in covertree.groups(table(spark, [(i, v, int(y)) for i, (v, y) in enumerate(zip(x, label))])).collect()}
    n, name = components(x.astype(float), label, 0.93)
    assert all((found[i].n_links, found[i].component_id) == (n[i], name[i]) for i in range(1500))


def test_columns_with_names_of_its_own(spark):
    df = table(spark, [(i, [1.0, 0.1 * i, 0.0, 0.0], 0) for i in range(6)]).selectExpr("*", "1 as id", "2 as node", "'x' as v", "3 as n_links", "4 as list")
    assert {r.vec_id for r in covertree.groups(df).collect()} == set(range(6))
    assert ann.search(df, df.where("vec_id = 0"), k=3).count() == 3


def test_tree_covers_and_nests():
    r = np.random.default_rng(3)
    x = covertree._unit(r.standard_normal((200, 5)))
    tree, order = covertree.Tree.grown(x)
    assert sorted(order) == list(range(200)) and (tree.x == x[order]).all()
    again = covertree.Tree.read(tree.x, tree.stored())
    for k in range(len(tree.start)):
        inside = np.arange(again.start[k], again.end[k])
        assert np.linalg.norm(again.x[inside] - again.x[again.center[k]], axis=1).max() <= again.radius[k] + 1e-7
        if again.last[k]:
            kids = range(again.first[k], again.last[k])
            assert sorted(np.concatenate([np.arange(again.start[c], again.end[c]) for c in kids])) == sorted(inside)
            assert again.center[again.first[k]] == again.center[k]
            apart = np.linalg.norm(again.x[again.center[kids]][:, None] - again.x[again.center[kids]][None], axis=2)
            level = 2.0 ** -np.floor(np.log2(1 / max(again.radius[c] for c in kids))) if any(again.radius[c] for c in kids) else 0
            assert apart[np.triu_indices(len(kids), 1)].min(initial=9) >= level / 2 - 1e-7
