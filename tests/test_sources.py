import threading
from datetime import datetime
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from seismopair.operators import cache, stations
from seismopair.sources import sac
from seismopair.sources.webservice import EventService


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            year = q.get("starttime", "2020")[:4]
            body = f"#EventID|Time\nev{year}|{year}-05-01T00:00:00Z|10.0|20.0|5.0|A|B|C|D|Mw|{q.get('minmagnitude', 1)}|E|P\nnonsense|line\nlow|{year}-05-01T00:00:00|1|2|3|A|B|C|D|Mw|0.5|E|P\n"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/query", asked
    server.shutdown()


def test_event_service_is_sent_the_bounds(spark, service):
    url, asked = service
    spark.dataSource.register(EventService)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    rows = spark.read.format("event_service").option("url", url).option("intervals", "2021-01-01/2022-01-01,2023-01-01/").load().where("mag >= 2.5").collect()
    assert sorted(r.evid for r in rows) == ["ev2021", "ev2023"] and {r.mag for r in rows} == {2.5}
    assert all(q["minmagnitude"] == "2.5" and q["format"] == "text" for q in asked)
    gone = spark.read.format("event_service").option("url", "http://127.0.0.1:9/none").load()
    assert gone.count() == 0


def test_sac_round_trip():
    data, start = np.arange(7, dtype=float), datetime(2024, 2, 29, 1, 2, 3, 456000)
    content = sac.encode(data, 0.01, start, "XX.STA.00.BHZ", evla=1.5, a=2.0)
    back = sac.decode(content)
    assert back["trace_id"] == "XX.STA.00.BHZ" and back["start"] == start and (back["data"] == data).all()
    assert back["evla"] == 1.5 and back["a"] == 2.0 and "evlo" not in back
    for cut in (content[:100], content[:-1]):
        with pytest.raises(ValueError):
            sac.decode(cut)


def test_travel_table(spark):
    t = lambda d, z: stations.table_seconds(F.lit(float(d)), F.lit(float(z)), [0, 10, 30], [0, 10], [[0, 2, 6], [1, 3, 9]])
    assert list(spark.range(1).select(t(0, 0), t(5, 0), t(20, 5), t(99, 99), t(-1, 0)).first()) == [0, 1, 5, 9, 0]


def test_download_decisions(spark):
    day = lambda h: datetime(2020, 1, 1, h)
    wanted = spark.createDataFrame([(e, "t", day(1), day(2)) for e in "abc"], "evid string, trace_id string, req_start timestamp, req_end timestamp")
    stored = spark.createDataFrame([("a", "t", day(0), day(3))], "evid string, trace_id string, start_ts timestamp, end_ts timestamp")
    tries = spark.createDataFrame([("b", "t", day(5)), ("c", "t", day(1))], "evid string, trace_id string, ts timestamp")
    found = cache.decided(wanted, stored, cache.failures(tries, 3600.0, 5), F.lit(day(5)).cast("timestamp"))
    assert {r.evid: r.status for r in found.collect()} == {"a": "fetched", "b": "unavailable", "c": "pending"}
