"""Event web services that answer in bar-separated text, as a Spark data source that sends range filters along with the request.

    spark.dataSource.register(EventService)
    spark.read.format("event_service").option("url", "http://.../event/1/query").option("intervals", "2024-01-01/2024-02-01,2024-02-01/").load()
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from urllib.error import URLError
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "evid string, orig_time timestamp, lat double, lon double, depth_km double, author string, catalog string, contributor string, contributor_id string, mag_type string, mag double, mag_author string, location_name string"
#: Request parameters for the least and largest value of a column.
PARAMETERS = {"lat": ("minlatitude", "maxlatitude"), "lon": ("minlongitude", "maxlongitude"), "depth_km": ("mindepth", "maxdepth"), "mag": ("minmagnitude", "maxmagnitude"), "orig_time": ("starttime", "endtime")}


def parse(line: str) -> tuple | None:
    """The fields of a line; None if it is no event."""
    parts = [p.strip() for p in line.split("|")]
    if line.startswith("#") or len(parts) < 13:
        return None
    number = lambda x: float(x) if x not in ("", "None") else None
    text = lambda x: x if x not in ("", "None") else None
    try:
        time = datetime.fromisoformat(parts[1].rstrip("Z"))
        return (parts[0], time, number(parts[2]), number(parts[3]), number(parts[4]), *map(text, parts[5:10]), number(parts[10]), text(parts[11]), text(parts[12]))
    except ValueError:
        return None


class Request(InputPartition):
    def __init__(self, url: str):
        self.url = url


class Reader(DataSourceReader):
    """One request for each interval start/end, or start/end/url where it has a service of its own. A bound that the service applies is applied by Spark too, since services differ on open ends."""

    def __init__(self, options: dict):
        self.options, self.sent = options, {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") else None
            if column in PARAMETERS and isinstance(f, (GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                name = PARAMETERS[column][isinstance(f, (LessThan, LessThanOrEqual))]
                value = f.value.strftime("%Y-%m-%dT%H:%M:%S.%f") if isinstance(f.value, datetime) else f.value
                self.sent.setdefault(name, value)
            yield f

    def partitions(self) -> list[Request]:
        if "url" not in self.options:
            raise ValueError("the option url is missing")
        found = []
        for interval in self.options.get("intervals", "/").split(","):
            start, end, url = (*interval.split("/", 2), "", "")[:3]
            own = {k: v for k, v in (("starttime", start), ("endtime", end)) if v}
            found.append(Request((url or self.options["url"]) + "?" + urlencode({"format": "text", **self.sent, **own})))
        return found

    def read(self, partition: Request) -> Iterator[tuple]:
        try:
            with urlopen(partition.url, timeout=float(self.options.get("timeout", 60))) as answer:
                for line in answer:
                    row = parse(line.decode("utf-8", "replace").strip())
                    if row is not None:
                        yield row
        except URLError:
            if self.options.get("strict", "false") == "true":
                raise


class EventService(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_service"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)
