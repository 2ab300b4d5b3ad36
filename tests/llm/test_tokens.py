import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from seismopair.llm import bpe, packing
from seismopair.llm.queries import tokenizer_file

RANKS = tokenizer_file("byte_bpe_multi_50k.tiktoken")
TEXTS = ["The cat's hat, 12 times!", "", None, "  \n\n ", "Größe über été   ", "漢字かな😀", "a" * 3000, "x1y2 " * 400, "don't  we'll\tgo"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_tree_encoding_is_the_library_s(library):
    codec = bpe.Codec(bpe.read_ranks(RANKS))
    rng = random.Random(3)
    for _ in range(600):
        letters = rng.choice(["ab", "a", "etaoin shr", "éèß漢", "0123456789", "\x00\xff"])
        data = "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 9, 40, 300]))).replace(" ", "n").encode()
        assert codec.encode(data) == library._core_bpe.encode_single_piece(data)
        assert codec.decode(codec.encode(data)) == data
        cut = rng.randint(0, len(data))
        a, b = codec.merge(data[:cut]) if cut else [], codec.merge(data[cut:]) if cut < len(data) else []
        assert codec.join(a, b) == codec.merge(data)


def test_encode_and_decode_tables(spark, library):
    df = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    found = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    rows = {r.doc_id: r.ids for r in found.collect()}
    assert all(rows[i] == library.encode_ordinary(t or "") for i, t in enumerate(TEXTS))
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(found, RANKS).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(TEXTS))
    assert bpe.digests(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0})


def test_memory_is_bounded():
    seen = bpe.Memo(lambda x: x * 2, limit=10)
    assert [seen[i] for i in range(100)] == [2 * i for i in range(100)] and len(seen) <= 10


def test_best_fit():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == ([0, 1, 0, 1, 1], [0, 0, 6, 5, 8])
    rng = random.Random(5)
    lengths = sorted((rng.randint(1, 60) for _ in range(500)), reverse=True)
    sequence, offset = packing.best_fit(lengths, 64)
    rooms: dict[int, int] = {}
    for n, w, at in zip(lengths, sequence, offset):
        fits = [r for r in rooms.values() if r >= n]
        assert rooms.get(w, 64) == min(fits, default=64) and at == 64 - rooms.get(w, 64)
        rooms[w] = rooms.get(w, 64) - n


@pytest.mark.parametrize("extra", [[], [(0, "The cat"), (None, "null key"), (0, "The cat")]])
def test_packing_loses_and_repeats_nothing(spark, extra):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "word " * i) for i in range(60)] + extra
    df = spark.createDataFrame(rows, "doc_id long, text string")
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json").decode())
    pieces = packing.tokenize(df, tokenizer_file("word_bpe_49k.json"), 2, window=64, with_ids=True)
    found = packing.pack(pieces, 70, window=64, group=16).collect()
    got: dict[tuple, int] = {}
    for r in found:
        got[(r.doc_id, r.doc_tokens)] = got.get((r.doc_id, r.doc_tokens), 0) + r.length
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 64
    want: dict[tuple, int] = {}
    for key, text in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids) + 1
        want[(key, n)] = want.get((key, n), 0) + n
    assert got == want
    places: dict[int, list] = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(packing.tokenize(df.limit(0), tokenizer_file("word_bpe_49k.json"), 2), 0).count() == 0


def test_ids_are_the_tokenizer_s():
    library = Tokenizer.from_str(tokenizer_file("word_bpe_49k.json").decode())
    own = packing.Words(tokenizer_file("word_bpe_49k.json"))
    assert own.known and own.find_plain is not None
    texts = ["It's THE end&&& of### x1y2, <|endoftext|> don't!!", "Größe ÜBER\tété x  y", "İstanbul ΣΑΣ ǅ", "'S 'll'", "a\x1cb - \x1f", "e\u0301 \u0301", "½²٣ ª º × ÷", "", "long" * 5000]
    signs = [*"aA zZ'sRdßẞİıŁŸÿΣςſ1²½٣é\u0301\t\n\x0b\x1c\x85\xa0\u2028日🙂_-—!?ǅȺ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "'ll", "'LL"]
    draw = random.Random(3)
    texts += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(2000)]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_other_files_are_left_to_the_library():
    content = tokenizer_file("byte_bpe_50k.json")
    own, library = packing.Words(content), Tokenizer.from_str(content.decode())
    assert not own.known
    for t in ["It's THE end", " é <|endoftext|> x"]:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_memory_is_bounded_by_entries_and_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_BYTES", 1000)
    asked = []
    memo = bpe.Memo(lambda k: asked.append(k) or k.upper(), limit=50)
    for k in range(2000):
        assert memo[f"{k:020d}"] == f"{k:020d}"
    assert len(memo) <= 50 and len(memo.before) <= 50 and sum(map(len, [*memo, *memo.before])) <= 2000
    long = "x" * 5000
    assert memo[long] == long.upper() == memo[long] and long not in memo and asked.count(long) == 2


def test_repeated_rows_are_dealt_to_many_groups(spark):
    df = spark.range(400).selectExpr("7 as doc_id", "'same words here' as text")
    pieces = packing.tokenize(df, tokenizer_file("word_bpe_49k.json"), 2, window=64)
    found = packing.pack(pieces, 400, window=64, group=40).selectExpr("sequence_id >> 32 as g").groupBy("g").count().collect()
    assert len(found) > 5 and max(r["count"] for r in found) < 100


def test_special_tokens_are_the_library_s(spark):
    content = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_str(content.decode())
    texts = ["foo <|endoftext|> bar", "a<|endoftext|>B", "X<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>x <|endoftext|>", "É<|endoftext|>é", "<|endoftext |> <|endof\ntext|>", "<|endoftext|>"]
    assert library.encode(texts[0], add_special_tokens=False).ids == [23435, 49407, 2411]
    rows = packing.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), content, 2, with_ids=True).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
