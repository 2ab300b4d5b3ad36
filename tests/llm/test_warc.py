import gzip

import pytest
from pyspark.sql import functions as F

from seismopair.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def told(spark, rows, path, **more):
    warc.write(spark.createDataFrame(rows, SCHEMA), path, **more)
    return {r.record_id: r for r in warc.read(spark, path, split_bytes=700).collect()}


def test_round_trip_with_revisits(spark):
    rows = [(3, "http://a/3", "same"), (1, "http://a/1", "same"), (2, None, None), (5, "http://a/ü?x y", ""), (4, "u", "é" * 5000)]
    found = told(spark, rows, common.shared_path(spark, "w"))
    assert len(found) == 5
    assert (found["urn:page:1"].record_type, found["urn:page:3"].record_type, found["urn:page:3"].refers_to) == ("response", "revisit", "urn:page:1")
    assert (found["urn:page:2"].record_type, found["urn:page:5"].record_type) == ("response", "revisit")
    for key, _, html in rows:
        r, body = found[f"urn:page:{key}"], (html or "").encode()
        assert r.payload_bytes == len(body) and r.payload_digest == warc.digest(body) and r.digest_ok
        assert r.payload == (None if r.record_type == "revisit" else body)


def test_least_size_of_a_revisit(spark):
    found = told(spark, [(1, "u", "ab"), (2, "u", "ab")], common.shared_path(spark, "w"), min_bytes=3)
    assert {r.record_type for r in found.values()} == {"response"}


def test_repeated_rows_and_null_keys(spark):
    path = common.shared_path(spark, "w")
    warc.write(spark.createDataFrame([(1, "u", "x"), (1, "u", "x"), (None, "u", "x")], SCHEMA), path)
    assert sorted(r.record_type for r in warc.read(spark, path).collect()) == ["response", "response", "revisit"]


def test_empty_table(spark):
    path = common.shared_path(spark, "w")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1000, 10**6])
def test_every_split_size_reads_each_record_once(tmp_path, size):
    inner = gzip.compress(b"no warc") + b"\x1f\x8b\x08 nonsense"
    file = tmp_path / "a.warc.gz"
    members = [gzip.compress(warc.record("response", f"urn:page:{i}", "u", "2020-01-01T00:00:00Z", bytes([i]) * i + inner), compresslevel=i % 2 * 9) for i in range(30)]
    file.write_bytes(b"junk".join(members) + b"\x1f\x8b\x08cut")
    found = []
    for start in range(0, file.stat().st_size, size):
        with warc._Bytes(str(file)) as source:
            found += [h["warc-record-id"] for data in warc.members(source, start, start + size) for h, _ in warc.parse(data)]
    assert found == [f"<urn:page:{i}>" for i in range(30)]


def test_a_member_of_16_mb(spark):
    path = common.shared_path(spark, "w")
    df = spark.range(1).select(F.lit(1).cast("long").alias("page_id"), F.lit("u").alias("url"), F.repeat(F.lit("x"), 17 << 20).alias("html"))
    warc.write(df, path)
    (row,) = warc.read(spark, path).collect()
    assert row.payload_bytes == 17 << 20 and row.digest_ok


def test_a_member_that_breaks_off(tmp_path):
    whole = [gzip.compress(warc.record("response", f"urn:page:{i}", "u", "2020-01-01T00:00:00Z", bytes(range(256)) * 20)) for i in range(2)]
    file = tmp_path / "a.warc.gz"
    file.write_bytes(whole[0] + whole[1][:-200])
    with warc._Bytes(str(file)) as source:
        assert len(list(warc.members(source, 0, 1 << 20))) == 1
        with pytest.raises(ValueError, match="damaged"):
            list(warc.members(source, 0, 1 << 20, strict=True))
    file.write_bytes(whole[0] + b"\x1f\x8b\x08 nonsense")
    with warc._Bytes(str(file)) as source:
        assert len(list(warc.members(source, 0, 1 << 20, strict=True))) == 1
