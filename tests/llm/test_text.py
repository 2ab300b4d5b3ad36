import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seismopair.llm import bwt, common, langid, minhash, quality, suffix, toxicity

rng = np.random.default_rng(0)
WORDS = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(300)]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(r.choice(WORDS, n))


def edited(text, every, seed):
    r, parts = np.random.default_rng(seed), text.split(" ")
    for k in range(0, len(parts), every):
        parts[k] = str(r.choice(WORDS))
    return " ".join(parts)


# ---- near duplicates ----------------------------------------------------------


def shingled(text):
    import re

    w = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(u, v):
    every = u.keys() | v.keys()
    return sum(1 / sum(max(u.get(y, 0) / u[x], v.get(y, 0) / v[x]) for y in every) for x in u.keys() & v.keys())


def test_similarity_and_its_estimate():
    for k in range(6):
        a = prose(300, k) + " " + prose(40, 90) * (k % 3)
        b = edited(a, [300, 60, 25, 12, 8, 3][k], k)
        row, element, count = minhash.weighted(pa.array([a, b, "", None, "one two"]))
        sets = [minhash.unpack(x) for x in minhash.pack(row, element, count, 5)]
        exact = minhash.similarity(sets[0], sets[1])
        assert exact == pytest.approx(jaccard(shingled(a), shingled(b)))
        signature = minhash.signatures(row, element, count, 5, 4000)
        assert (signature[0] == signature[1]).mean() == pytest.approx(exact, abs=0.04)
        assert not signature[2].any() and len(sets[4][0]) == 1


def test_groups_are_the_components_of_all_links(spark):
    base = [prose(200, 1000 + k) for k in range(3)]
    texts = [base[k % 3] for k in range(12)]
    texts += [edited(base[k % 3], 150 - k, k) for k in range(90)] + [edited(base[0], 25, k) for k in range(60)]
    texts += [prose(150, k) for k in range(40)] + ["", None, "!!", "one two three", "One, two three", "one two", "rep " * 500, "rep " * 501]
    sets = [shingled(t) for t in texts]
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            shared = sum((sets[i] & sets[j]).values())
            if root(i) != root(j) and shared > 0.3 * min(sum(sets[i].values()), sum(sets[j].values())) and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, id int")
    found = {r.doc_id: r for r in minhash.groups(df).collect()}
    assert len(found) == len(texts)
    assert {i: found[i].component_id for i in found} == {i: root(i) for i in range(len(texts))}
    assert all(found[i].class_id == min(j for j, t in enumerate(texts) if t == texts[i]) for i in range(12))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.values())


def test_blocks_compare_all_pairs():
    texts = [edited(prose(100, 1), 90, k) for k in range(20)] + [prose(100, 50 + k) for k in range(5)]
    sets = minhash.pack(*minhash.weighted(pa.array(texts)), len(texts))
    members = [(i, i, s) for i, s in enumerate(sets)]
    assert len(minhash.compare(members, None, 0.8)) == 19
    assert len(minhash.compare(members[:10], members[10:], 0.8)) == 19  # a spanning tree across
    assert minhash.compare([(1, 1, b"")], None, 0.8) == []


def test_buckets_of_large_components_and_strays(spark, monkeypatch):
    """Blocks of one component are left out, and no link between components is lost."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    base = [prose(60, 2000 + k) for k in range(2)]
    shared = prose(60, 77)
    texts = [shared + " " + edited(base[k % 2], 59 - k % 7, k) for k in range(60)] + [shared + " " + prose(20, k) for k in range(12)]
    sets = [shingled(t) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in minhash.groups(df).collect()}
    row, element, count = minhash.weighted(pa.array(texts))
    keys = minhash.band_keys(minhash.signatures(row, element, count, len(texts)))
    assert max(Counter(keys[:, 0].tolist()).values()) > 12
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if root(i) != root(j) and (keys[i] == keys[j]).any() and jaccard(sets[i], sets[j]) >= 0.8:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert found == {i: root(i) for i in range(len(texts))}


def test_similarity_of_many_pairs():
    texts = [edited(prose(80, 1), 9 + k, k) for k in range(30)] + ["rep " * 50 + prose(9, k) for k in range(4)] + [""]
    packed = minhash.pack(*minhash.weighted(pa.array(texts)), len(texts))
    left, right = zip(*((a, b) for a in packed for b in packed))
    told = minhash.similar(list(left), list(right))
    assert told == pytest.approx([minhash.similarity(minhash.unpack(a), minhash.unpack(b)) for a, b in zip(left, right)])


def test_groups_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert minhash.groups(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, None), (4, "")]
    found = minhash.groups(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0, r.kept) for r in found) == [(False, 1, 1, True), (False, 1, 1, True), (False, 2, 1, False), (False, 3, 3, True), (False, 4, 4, True), (True, 0, 0, True)]


def test_large_counts_are_whole(spark):
    A, B, U, V = (np.uint64(k) for k in (1, 2, 3, 4))
    cases = [({A: 600_000, U: 60_000}, {A: 600_000, V: 60_000}), ({A: 65_535, B: 65_535}, {A: 65_535, B: 400_000}), ({A: 65_534, B: 3 << 32}, {A: 65_536, B: 3 << 32}), ({A: 20_000_001, U: 2}, {A: 20_000_001, V: 1})]
    for case in cases:
        row = np.repeat([0, 1], 2)
        packed = minhash.pack(row, np.array([x for s in case for x in s], np.uint64), np.array([n for s in case for n in s.values()]), 3)
        sets = [minhash.unpack(x) for x in packed]
        assert [dict(zip(*map(np.ndarray.tolist, s))) for s in sets] == [*case, {}]
        exact = jaccard(*case)
        assert minhash.similarity(sets[0], sets[1]) == pytest.approx(exact)
        assert len(minhash.compare([(0, 0, packed[0]), (1, 1, packed[1])], None, 0.8)) == (exact >= 0.8)
    texts = ["a " * 600_000 + x * 60_000 for x in ("u ", "v ")]
    found = minhash.groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.component_id for r in found} == {0}


# ---- repeated substrings --------------------------------------------------------


@pytest.mark.parametrize("rows", [1 << 22, 5])
def test_transform_and_prefixes(monkeypatch, rows):
    monkeypatch.setattr(bwt, "ROWS", rows)
    r = np.random.default_rng(4)
    for trial in range(40):
        strings = [bytes(r.choice(list(b"ab\x00" if trial % 2 else b"abcdefgh"), r.integers(0, 12)).astype(np.uint8)) for _ in range(r.integers(1, 8))]
        symbol, prefix, string, length = bwt.build(np.frombuffer(b"".join(strings), np.uint8), np.cumsum([0, *map(len, strings)]), 10)
        suffixes = [strings[s][len(strings[s]) - int(k) :] for s, k in zip(string, length)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(len(s) + 1 for s in strings)
        for k in range(1, len(suffixes)):
            a, b = suffixes[k - 1], suffixes[k]
            common_ = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
            assert prefix[k] == min(common_, 10)
        assert all(y == (0 if k == len(strings[s]) else strings[s][len(strings[s]) - 1 - int(k)] + 1) for y, s, k in zip(symbol, string, length))


def removed(rows):
    first: dict[bytes, int] = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - 49):
            x = data[i : i + 50]
            first[x] = min(first.get(x, 1 << 62), 1 << 62 if key is None else key)
    out = []
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 49):
            if key is not None and first[data[i : i + 50]] < key:
                gone[i : i + 50] = True
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((key, len(data), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_long_texts_are_gone_through_in_pieces(monkeypatch):
    import zstandard

    texts = [prose(900, 1).encode(), b"", b"short", ("é" * 500).encode(), prose(300, 1).encode(), b"ab" * 700]
    packed = (np.arange(6).astype("<i8").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), zstandard.compress(b"".join(texts)))

    def strings(block):
        found = {}
        for b, n, h, d in zip(block.begin, block.count, block.hash, block.doc):
            for at in range(b, b + n):
                assert at not in found and block.starts[d] <= at and at + 50 <= block.starts[d + 1]
                found[at] = int(h)
        return found

    whole = suffix.Block(*packed)
    every = strings(whole)
    assert len(every) == sum(max(0, len(t) - 49) for t in texts)
    monkeypatch.setattr(suffix, "PIECE", 777)
    pieces = suffix.Block(*packed)
    assert strings(pieces) == every and len(pieces.begin) > len(whole.begin)
    single = pieces.alone(np.array(sorted(every)))
    body = b"".join(texts)
    names = {}
    assert all(names.setdefault(body[at : at + 50], h) == h for at, h in zip(sorted(every), single.tolist())) and len(set(names.values())) == len(names)


def test_counts_of_hot_hashes_are_whole():
    def row(block, count):
        return {"block": block, "part": 0, "hashes": b"hash1", "many": bytes([min(count, suffix.ESCAPE) * 2]), "more": np.array([count] * (count >= suffix.ESCAPE), "<u4").tobytes()}

    for counts, hot in (((126, 127, 70_000), True), ((126, 5000, 14_000), False), ((19_999, 1), False), ((20_000, 1), True)):
        group = pa.Table.from_pylist([row(i, n) for i, n in enumerate(counts)])
        told = suffix._repeated(20_000)(group)
        assert told["again"].to_pylist() == [b"\x80"] * len(counts) and told["hot"].to_pylist() == [b"\x80" if hot else b"\0"] * len(counts)


@pytest.mark.parametrize("hot", [20_000, 2])
def test_removal_is_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    monkeypatch.setattr(suffix, "HASHES", 400)
    monkeypatch.setattr(suffix, "SEGMENTS", 200)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", 3000)
    passage, other = prose(14, 7), "é" * 40
    rows = [(50 - k, prose(40, k) + " " + passage[: 60 + k] + prose(9, 100 + k)) for k in range(40)]
    rows += [(100, prose(30, 3)), (101, prose(30, 3)), (102, "a" * 400), (103, "a" * 300 + "b"), (104, other * 2), (105, other + "x" + other), (106, None), (107, ""), (108, passage[:49]), (None, passage), (60, passage), (60, passage), (61, passage + passage)]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, kept string")
    found = suffix.remove(df, with_text=False).collect()
    assert sorted((tuple(r) for r in found), key=str) == removed(rows)


def test_cleaned_texts(spark):
    a, b = "é" * 30, prose(12, 5)
    df = spark.createDataFrame([(1, b, "x", 3), (2, "start " + b + " end", "y", None), (3, "ab" + a, None, 1), (4, "xb" + a[:-2] + "q", "z", 2), (5, None, "n", 5)], "doc_id long, text string, lang string, n_bytes long")
    found = {r.doc_id: r for r in suffix.clean(df).collect()}
    assert {k: r.n_bytes for k, r in found.items()} == {1: 3, 2: None, 3: 1, 4: 2, 5: 5}
    assert found[2].text == "start  end" and found[2].lang == "y" and found[1].text == b and found[5].text == ""
    assert found[4].text == "xq" and found[3].lang is None
    assert suffix.remove(df).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "lang"]
    assert suffix.remove(df.limit(0)).count() == 0


# ---- classifiers -----------------------------------------------------------------


def labelled(spark, good, bad, n=120):
    rows = [(i, good(i) if i % 2 else bad(i), i % 2) for i in range(n)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(n, None), (n + 1, ""), (n + 2, "x" * 50_000)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, y, 1 - y) for i, _, y in rows] + [(n, None, 1), (n + 9, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality(spark):
    docs, labels = labelled(spark, lambda i: prose(60, i), lambda i: prose(60, i).replace(" ", "### ").upper())
    found = {r.doc_id: r for r in quality.classify(docs.selectExpr("*", "1 as score"), quality.train(docs, labels)).collect()}
    assert len(found) == 123 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in found.values())
    assert np.mean([found[i].predicted == i % 2 for i in range(120)]) > 0.97
    again = {r.doc_id: r.score for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    assert again == {k: r.score for k, r in found.items()}


def test_dual_descent_solves_the_primal():
    r = np.random.default_rng(1)
    rows = [np.sort(r.choice(30, 8, replace=False)) for _ in range(60)]
    y = np.array([int(x.sum() > 110) for x in rows])
    values = [np.full(8, 8**-0.5) for _ in rows]
    w = quality.descend(rows, values, y)

    def loss(w):
        share = np.clip(y.mean(), 0.05, 0.95)
        cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
        return w @ w / 2 + sum(c * max(0, 1 - (1 if t else -1) * (w[x] @ v + w[-1])) for x, v, t, c in zip(rows, values, y, cost))

    assert all(loss(w + d) > loss(w) - 0.05 for d in r.standard_normal((20, len(w))) * 0.05 * np.isin(np.arange(len(w)), range(30)))


def test_toxicity(spark):
    bad = ["grumblefish", "snortwhack", "plonkhead"]
    docs, labels = labelled(spark, lambda i: prose(80, i), lambda i: prose(30, i) + " " + " ".join(bad) + " " + prose(30, 500 + i) + " " + bad[i % 3], 400)
    found = {r.doc_id: r for r in toxicity.classify(docs, toxicity.train(docs, labels)).collect()}
    assert all(0 <= r.score <= 1 for r in found.values()) and found[400].predicted == 0
    assert np.mean([found[i].predicted == 1 - i % 2 for i in range(400)]) > 0.95


def test_the_bound_of_windows_is_a_constant(monkeypatch):
    taken = []
    monkeypatch.setattr(toxicity, "dictionary", lambda samples, size, piece: taken.append((size, len(samples))) or b"")
    texts = [prose(400, i) for i in range(30)]
    every = sum(len(list(toxicity.windows(t))) for i, t in enumerate(texts) if i % 3 != 2 and i % 2)
    for bound in (10 * every, every // 4):
        monkeypatch.setattr(toxicity, "WINDOWS", bound)
        taken.clear()
        toxicity.fit(texts, [1 - i % 2 for i in range(30)], 0.5)
        assert taken[0] == (toxicity.ORDINARY_BYTES, min(every, bound))


def test_toxic_scores_by_hand():
    """Window by window with a compressor made anew for each, and the logistic of the three figures."""
    bad = ["grumblefish", "snortwhack", "plonkhead"]
    texts = [prose(60, i) + (" " + bad[i // 2 % 3] + " " + prose(20, 900 + i) + " " + bad[(i // 2 + 1) % 3]) * (i % 2) for i in range(240)]
    model = toxicity.fit(texts, [i % 2 for i in range(240)], 0.5)
    some = [*texts[:12], "", None, "x", "é" * 300, prose(4000, 5)]
    found = model.score(pa.array(some))
    for text, score in zip(some, found):
        data, saved = (text or "").lower().encode(), []
        while data:
            cut = data[:128]
            if len(data) > 128 and b" " in cut[1:]:
                cut = cut[: cut.rindex(b" ") + 1]
            saved.append(len(toxicity.compressor(model.ordinary)(cut)) - len(toxicity.compressor(model.toxic + b" " + model.ordinary)(cut)))
            data = data[len(cut) :]
        three = [sum(saved) / len(saved), sum(sorted(saved)[-3:]) / len(saved[-3:]) / 10, sum(s >= 3 for s in saved) / len(saved)] if saved else [0, 0, 0]
        assert score == pytest.approx(1 / (1 + np.exp(-(np.dot(three, model.weights[:3]) + model.weights[3]))))
    assert np.mean([s >= 0.5 for s in model.score(pa.array(texts[1::2]))]) > 0.6 and np.mean(model.score(pa.array(texts[::2])) >= 0.5) < 0.1


def test_quality_scores_by_hand():
    """Ratios, margins and scores from dictionaries of n-grams."""
    texts = [prose(30, i) if i % 2 else prose(30, i).upper() + "##" for i in range(60)]
    row, bucket = quality.features(pa.array(texts))
    rows = [bucket[row == i] for i in range(60)]
    grams = []
    for t in texts:
        data = t.encode()
        own = set()
        for n in (2, 3, 4):
            for i in range(len(data) - n + 1):
                value = np.array([int.from_bytes(data[i : i + n], "little") + (n << 40)], np.uint64)
                own.add(int(common.mix(value)[0] >> np.uint64(64 - quality.BITS)))
        grams.append(own)
    assert [set(r.tolist()) for r in rows] == grams
    y = np.arange(60) % 2
    counts = [Counter(g for own, label in zip(grams, y) if label == k for g in own) for k in (0, 1)]
    totals = [sum(c.values()) + (1 << quality.BITS) for c in counts]
    ratio = quality.ratios(rows, y)
    for g in list(counts[0])[:200] + list(counts[1])[:200]:
        assert ratio[g] == pytest.approx(np.log((counts[1][g] + 1) / totals[1]) - np.log((counts[0][g] + 1) / totals[0]))
    model = quality.fit(rows, y, 0.5)
    for text, score in zip([*texts[:6], "", None], model.score(pa.array([*texts[:6], "", None]))):
        own = grams[texts.index(text)] if text else set()
        length = sum(model.ratio[g] ** 2 for g in own) ** 0.5
        margin = sum(model.ratio[g] * model.weight[g] for g in own) / max(length, 1e-12) + model.weight[-1]
        assert score == pytest.approx(1 / (1 + np.exp(-(model.line[0] * margin + model.line[1]))))


def test_columns_of_the_caller_stay(spark):
    docs, labels = labelled(spark, lambda i: prose(60, i), lambda i: prose(60, i).replace(" ", "### ").upper())
    own = docs.selectExpr("*", "0.123D as score", "9 as predicted", "'k' as _label", "1 as _text", "2 as lang_pred")
    kept = quality.good_rows(own, quality.train(own, labels)).collect()
    assert 50 < len(kept) < 70 and {(r.score, r.predicted, r._label, r._text, r.lang_pred) for r in kept} == {(0.123, 9, "k", 1, 2)}
    left = toxicity.ordinary_rows(own, toxicity.Model(b"", b"", None, 0.2))
    assert left.columns == own.columns and left.count() == 123 and toxicity.ordinary_rows(own, toxicity.Model(b"", b"", None, 0.9)).count() == 0
    assert langid.identify(own, langid.Model(["xx"], np.ones((1, langid.DIMENSION)))).columns == ["doc_id", "text", "predicted", "_label", "_text", "lang_pred", "score"]
    mine = docs.selectExpr("*", "-7 as n_bytes", "'mine' as kept", "1 as _text", "2 as _key", "3 as c0", "4 as block")
    assert {tuple(r)[2:] for r in suffix.clean(mine).collect()} == {(-7, "mine", 1, 2, 3, 4)} and suffix.clean(mine).columns == mine.columns


def test_labels_out_of_reach_give_a_warning(spark):
    docs = spark.createDataFrame([(i, "x" * 40_000) for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(6)], "doc_id long, quality int, toxic int")
    for operator in (quality, toxicity):
        with pytest.warns(UserWarning, match="no labelled text"):
            model = operator.train(docs, labels)
        assert len({r.score for r in operator.classify(docs, model).collect()}) == 1


def test_classifiers_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.classify(docs, quality.train(docs, labels)).collect()} == {0.5}
    assert {r.score for r in toxicity.classify(docs, toxicity.train(docs, labels)).collect()} == {0.5}
    assert toxicity.classify(docs.limit(0), toxicity.Model(b"", b"")).count() == 0


def test_held_out_fold(spark):
    import zlib

    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long").select("doc_id", common.held_out().alias("h"))
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in df.collect())


# ---- languages -------------------------------------------------------------------


def test_languages(spark):
    kinds = {"xx": list("abcde"), "yy": list("vwxyz"), "zz": list("äöüßé")}
    r = np.random.default_rng(0)
    rows = [(i, " ".join("".join(r.choice(kinds[k], 4)) for _ in range(20)), k if i % 7 else None) for i, k in enumerate(list(kinds) * 60)]
    rows += [(900, None, "xx"), (901, "12 !!", "xx"), (902, "", None), (903, "漢字", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in langid.identify(df, langid.train(df)).collect()}
    assert np.mean([found[i].lang_pred == list(kinds)[i % 3] for i in range(180)]) > 0.98
    assert [found[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and found[903].lang_pred in kinds
    assert all(0 <= r.score <= 1 for r in found.values())
    none = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.identify(df, none).collect()} == {"und"}


def test_prototypes_and_cosines_by_hand(spark):
    texts = ["Abc abd, bca!", "bad cab", "xyz zyx xyx", "zzy yx x", "abc xyz", "É日本 a"]
    names = ["p", "p", "q", "q", None, "q"]
    df = spark.createDataFrame(list(zip(range(1, 7), texts, names)), "doc_id long, text string, lang string").where("doc_id not in (2)")
    item = langid.letters().astype(float)

    def bundle(text):
        symbols, total = [0, *(int(langid.symbol_table()[ord(c)]) for c in text.lower()), 0], np.zeros(langid.DIMENSION)
        for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
            if b:
                total += np.roll(item[a], 2) * np.roll(item[b], 1) * item[c]
        return total

    learnt = [r for r in df.select("*", common.held_out().alias("h")).collect() if r.lang and not r.h]
    prototypes = {n: sum(bundle(r.text) for r in learnt if r.lang == n) for n in sorted({r.lang for r in learnt})}
    model = langid.train(df)
    assert model.langs == list(prototypes)
    for r in langid.identify(df, model).collect():
        own = bundle(r.text)
        cosine = {n: own @ p / np.linalg.norm(own) / np.linalg.norm(p) for n, p in prototypes.items()}
        assert r.lang_pred == max(cosine, key=cosine.get) and r.score == pytest.approx(max(0, max(cosine.values())), abs=1e-5)


def test_letters_of_all_planes():
    table = langid.symbol_table()
    assert all((table[c] > 0) == chr(c).isalpha() for c in range(128, 0x110000)) and table[0x30000] and table[0x31350]
    model = langid.Model(["xx"], np.ones((1, langid.DIMENSION)))
    assert model.predict(["\U00030000\U00031350", "12"], langid.letters())[0] == ["xx", "und"]


def test_binding_keeps_order():
    item = langid.letters()
    code = lambda s: (langid.SYMBOLS * (langid.SYMBOLS * s[0] + s[1])) + s[2]
    v = langid.vectors(np.array([code((1, 2, 3)), code((3, 2, 1)), code((1, 2, 3))]), item)
    assert (v[0] == v[2]).all() and abs(v[0] @ v[1]) < 0.2 * langid.DIMENSION
