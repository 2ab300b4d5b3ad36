"""Catalog readers: bar-separated text, delimited files with guessed columns, QuakeML, and stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import evid_from_uri, fdsn_line, generate_evid
from ..schemas import CATALOG

TEXT_FIELDS = ("evid", "orig_time", "lat", "lon", "depth_km", "author", "catalog", "contributor", "contributor_id", "mag_type", "mag", "mag_author", "location_name")
#: The spellings of column names that are accepted for each logical field. A space may stand for an underscore.
GUESSES = {
    "evid": ("evid", "event_id", "eventid", "id", "evidid"),
    "orig_time": ("time", "orig_time", "origin_time", "origin_time_utc", "origin_time_iso"),
    "year": ("year", "yr", "yyyy"),
    "month": ("month", "mon", "mo", "mm"),
    "day": ("day", "dy", "dd"),
    "hour": ("hour", "hr", "h", "hh"),
    "minute": ("minute", "min"),
    "seconds": ("seconds", "second", "sec", "s", "ss"),
    "lat": ("lat", "latitude"),
    "lon": ("lon", "longitude"),
    "depth_km": ("depth", "depth_km"),
    "mag": ("mag", "magnitude"),
    "mag_type": ("mag_type", "magnitude_type"),
}


def match_score(field: str, guesses: tuple[str, ...]) -> int:
    """999 for a guess itself, else the length of the longest guess that the field contains."""
    name = field.lower().strip()
    spelled = {v for g in guesses for v in (g, g.replace("_", " "))}
    return 999 if name in spelled else max((len(g) for g in spelled if g in name), default=0)


def guess_fields(header: list[str], guesses: dict[str, tuple[str, ...]] | None = None) -> dict[str, str]:
    """Logical field to header name: a field takes the header that matches it best (the first of equals), and a header that several fields take stays with the one it matches best."""
    scores = {f: [(match_score(name, g), name) for name in header] for f, g in (guesses or GUESSES).items()}
    best = {f: max(s, key=lambda x: x[0], default=(0, "")) for f, s in scores.items()}
    claims = [(score, name, f) for f, (score, name) in best.items() if score]
    return {f: name for score, name, f in claims if score == max(s for s, n, _ in claims if n == name)}


def _number(c: Column, kind: str = "double") -> Column:
    return c.try_cast(kind)


def read_text(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Events of bar-separated lines of 13 fields; lines that begin with # and blank ones are skipped.

    A line that doesn't parse is an error, or is left out if not `strict`.
    """
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.transform(F.split("value", r"\|"), lambda x: F.trim(x))
    rows = lines.select("value", parts.alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    text = lambda i: F.when(at(i).isin("", "None"), None).otherwise(at(i))
    made = {"evid": at(0), "orig_time": at(1).try_cast("timestamp"), "lat": _number(at(2)), "lon": _number(at(3)), "depth_km": _number(at(4)), "author": text(5), "catalog": text(6), "contributor": text(7), "contributor_id": text(8), "mag_type": text(9), "mag": _number(at(10)), "mag_author": text(11), "location_name": text(12)}
    rows = rows.withColumns(made)
    bad = (F.size("p") < 13) | F.col("orig_time").isNull() | F.col("evid").isNull()
    if strict:
        rows = rows.withColumn("evid", F.when(bad, F.raise_error(F.concat(F.lit("not a catalog line: "), "value"))).otherwise(F.col("evid")))
    else:
        rows = rows.where(~bad)
    return rows.select(*TEXT_FIELDS, F.lit(None).cast("string").alias("trace_id"))


def write_text(catalog: DataFrame, path: str) -> None:
    catalog.select(fdsn_line(**{n: F.col(n) for n in TEXT_FIELDS}).alias("value")).write.mode("overwrite").text(path)


def sniff(lines: list[str]) -> str:
    """The delimiter of a file's first five lines: a comma if there are five, else a semicolon if there are five, else a space."""
    head = "\n".join(lines[:5])
    return next((c for c in ",;" if head.count(c) >= 5), " ")


def read_delimited(spark: SparkSession, path: str, depth_in_m: bool = False) -> DataFrame:
    """Events of a delimited file with a header whose columns are guessed; rows without a time are left out, a missing evid is generated."""
    encoding = "UTF-8"
    head = [r[0] for r in spark.read.text(path).limit(5).collect()]  # five lines
    if any("\x00" in x or "�" in x for x in head):
        encoding = "UTF-16"
        head = [c for r in spark.read.option("encoding", encoding).csv(path, sep="\u0001").limit(5).collect() for c in r if c]
    rows = spark.read.options(header=True, sep=sniff(head), encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True).csv(path)
    found = guess_fields(rows.columns)
    if "orig_time" not in found and not {"year", "month", "day", "hour", "minute", "seconds"} <= set(found):
        raise ValueError(f"no time among the columns {rows.columns}")
    col = lambda f: F.col(f"`{found[f]}`") if f in found else F.lit(None).cast("string")
    if "orig_time" in found:
        time = F.coalesce(col("orig_time").try_cast("timestamp"), F.try_to_timestamp(F.rpad(F.translate(col("orig_time"), ".", ""), 14, "0"), F.lit("yyyyMMddHHmmss")))
    else:
        whole = lambda f, d: F.coalesce(_number(col(f), "int"), F.lit(d))
        time = F.try_make_timestamp(whole("year", None), whole("month", 1), whole("day", 1), whole("hour", 0), whole("minute", 0), F.coalesce(_number(col("seconds"), "decimal(8,6)"), F.lit(0).cast("decimal(8,6)")))
    kind = F.when(F.lower(col("mag_type")) == "nan", "M").otherwise(col("mag_type"))
    depth = _number(col("depth_km")) / (1000.0 if depth_in_m else 1.0)
    made = rows.select(col("evid").alias("evid"), time.alias("orig_time"), _number(col("lat")).alias("lat"), _number(col("lon")).alias("lon"), depth.alias("depth_km"), _number(col("mag")).alias("mag"), kind.alias("mag_type")).where("orig_time is not null")
    made = made.withColumn("evid", F.coalesce(F.when(F.col("evid") != "", F.col("evid")), generate_evid(F.col("orig_time"))))
    return conformed(made)


def conformed(rows: DataFrame) -> DataFrame:
    """The columns of the catalog, with nulls for those that are missing."""
    wanted = [x.strip().split(" ") for x in CATALOG.split(",")]
    return rows.select(*((F.col(n).cast(t) if n in rows.columns else F.lit(None).cast(t)).alias(n) for n, t in wanted))


def read_quakeml(spark: SparkSession, path: str) -> DataFrame:
    """Events of QuakeML: the preferred origin and magnitude, or the first; metres become kilometres; an event without an origin is left out."""
    value = "struct<value:string>"
    schema = f"_publicID string, preferredOriginID string, preferredMagnitudeID string, origin array<struct<_publicID:string,time:{value},latitude:{value},longitude:{value},depth:{value},creationInfo:struct<author:string>>>, magnitude array<struct<_publicID:string,mag:{value},type:string,creationInfo:struct<author:string>>>"
    rows = spark.read.format("xml").option("rowTag", "event").schema(schema).load(path)
    pick = lambda many, wanted: F.coalesce(F.get(F.filter(many, lambda o: o["_publicID"] == F.col(wanted)), F.lit(0)), F.get(many, F.lit(0)))
    rows = rows.withColumns({"o": pick("origin", "preferredOriginID"), "m": pick("magnitude", "preferredMagnitudeID")}).where("o is not null")
    made = rows.select(evid_from_uri(F.col("_publicID")).alias("evid"), F.col("o.time.value").try_cast("timestamp").alias("orig_time"), _number(F.col("o.latitude.value")).alias("lat"), _number(F.col("o.longitude.value")).alias("lon"), (_number(F.col("o.depth.value")) / 1000).alias("depth_km"), F.col("o.creationInfo.author").alias("author"), F.col("m.type").alias("mag_type"), _number(F.col("m.mag.value")).alias("mag"), F.col("m.creationInfo.author").alias("mag_author"))
    return conformed(made.where("orig_time is not null"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """A catalog file in the first format that it can be read in: QuakeML, bar-separated text without a bad line, a delimited file with a header."""
    head = [r[0].strip() for r in spark.read.text(path).limit(5).collect()]  # five lines
    if not any(head):
        raise ValueError(f"{path} is empty")
    if any(x.lstrip("\ufeff").startswith("<") for x in head):
        found = read_quakeml(spark, path)
        if not found.isEmpty():
            return found
    first = next((x for x in head if x and not x.startswith("#")), "")
    if first.count("|") >= 12 and _bad_lines(spark, path).isEmpty():
        return conformed(read_text(spark, path))
    try:
        return read_delimited(spark, path)
    except ValueError as e:
        raise ValueError(f"{path} is in no format that is read: {e}") from e


def _bad_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split("value", r"\|")
    return lines.where((F.size(parts) < 13) | (F.trim(F.get(parts, F.lit(0))) == "") | F.trim(F.get(parts, F.lit(1))).try_cast("timestamp").isNull())


def union(*catalogs: DataFrame) -> DataFrame:
    """Rows of all, with the catalog's columns."""
    out = conformed(catalogs[0])
    for c in catalogs[1:]:
        out = out.unionByName(conformed(c))
    return out


def write_stored(catalog: DataFrame, path: str) -> None:
    conformed(catalog).write.mode("overwrite").parquet(path)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored catalog in time order; an empty one is an error."""
    rows = spark.read.schema(CATALOG).parquet(path)
    if rows.isEmpty():
        raise ValueError("the stored catalog is empty")
    return rows.orderBy("orig_time", "evid")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """evid of each line; those that begin with # and blank ones are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("evid")).where("evid <> '' and not startswith(evid, '#')").distinct()
