"""A folder of stored tables and the verbs on them: what a command does, as a method that returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .config import Config
from .operators import cache, catalog, families, keys, pairs, plotdata, templates
from .plans import pipelines
from .shared import stage
from .sources import catalogs
from .sources import waveforms as waveform_files

TABLES = {"catalog": schemas.CATALOG, "pairs": schemas.PAIRS, "families": schemas.FAMILIES, "detections": schemas.DETECTIONS, "trace_metadata": schemas.TRACE_METADATA, "waveforms": schemas.WAVEFORMS, "failures": schemas.FAILURES, "templates": "family_number int, trace_id string, n long, lat double, lon double, depth_km double, p_offset_s double, s_offset_s double, travel_s double, distance_km double, distance_deg double, data array<double>", "values": "key string, value string"}
#: Version of the tables' columns; a workspace of another one isn't opened.
SCHEMA_VERSION = "2"


class Workspace:
    """Tables live under `root` on any file system that Spark reads. A write goes to a new version, and a pointer moves to it last."""

    def __init__(self, spark: SparkSession, root: str, cfg: Config | None = None):
        self.spark, self.root, self.cfg = spark, root.rstrip("/"), cfg or Config()
        found = self.value("schema_version")
        if found is not None and found != SCHEMA_VERSION:
            raise RuntimeError(f"{root} has tables of version {found}, not {SCHEMA_VERSION}")

    # ---- tables ---------------------------------------------------------------

    def _versions(self, name: str) -> list[int]:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def table(self, name: str) -> DataFrame:
        """The latest whole version of a table; without one, no rows."""
        versions = self._versions(name)
        if not versions:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{versions[-1]}")

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write a new version with the table's columns; readers of the old one aren't disturbed."""
        wanted = self.spark.createDataFrame([], TABLES[name]).schema
        rows = df.select(*((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted))
        if name != "values" and self.value("schema_version") is None:
            self.set_value("schema_version", SCHEMA_VERSION)
        n = max(self._versions(name), default=0) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{n}")
        return self.table(name)

    def value(self, key: str) -> str | None:
        """A stored value."""
        row = self.table("values").where(F.col("key") == key).first()
        return None if row is None else row["value"]

    def set_value(self, key: str, value: str) -> None:
        self.put("values", keys.put_values(self.table("values"), self.spark.createDataFrame([(key, value)], TABLES["values"])))

    # ---- verbs ------------------------------------------------------------------

    def read_catalog(self, path: str, append: bool = False) -> DataFrame:
        new = catalogs.read(self.spark, path)
        rows = catalog.appended(self.table("catalog") if append else self.table("catalog").limit(0), catalog.range_filter(new, self.cfg))
        return self.put("catalog", catalog.range_filter(rows, self.cfg))

    def print_catalog(self) -> DataFrame:
        return catalog.time_sorted(self.table("catalog")).select("evid", "orig_time", "lat", "lon", "depth_km", "mag_type", "mag")

    def scan_catalog(self, mode: str = "overwrite", stations: DataFrame | None = None) -> DataFrame:
        """`mode` is overwrite, continue to correlate only pairs that aren't stored, or abort if there are stored ones. With stations a pair is looked up on the nearest trace that both events have.

        Failed downloads show as rows of no_waveform, for both of whose events a wide window is added to the failures that aren't stored yet.
        """
        if mode not in ("overwrite", "continue", "abort"):
            raise ValueError("mode is overwrite, continue or abort")
        stored = self.table("pairs")
        if mode == "abort" and not stored.isEmpty():
            raise RuntimeError("there are stored pairs")
        done = stored if mode == "continue" else None
        found = pipelines.scan_catalog(self.table("catalog"), self.table("waveforms"), self.cfg, done, stations)
        return self.put("pairs", found if done is None else done.unionByName(found))

    def print_pairs(self, cc_min: float | None = None, cc_max: float | None = None, order_by: str | None = None, ascending: bool = True, offset: int = 0, limit: int | None = None) -> DataFrame:
        """All pairs, or those of a page, with both events and the trace's metadata."""
        from .functions.units import cc_between

        rows = self.table("pairs")
        if cc_min is not None or cc_max is not None:
            rows = rows.where(cc_between(F.col("cc_x100"), cc_min, cc_max))
        return pairs.page(pairs.view(rows, self.table("catalog"), self.table("trace_metadata")), limit, offset, order_by, ascending)

    def plot_pair(self, evid1: str, evid2: str) -> DataFrame:
        """Both traces of a stored pair, the second moved by the lag."""
        one = self.table("pairs").where(((F.col("evid1") == evid1) & (F.col("evid2") == evid2)) | ((F.col("evid1") == evid2) & (F.col("evid2") == evid1)))
        return plotdata.pair_traces(pairs.with_waveforms(one.drop("status", "sampling_rate_hz"), self.table("waveforms")))

    def build_families(self) -> DataFrame:
        return self.put("families", pipelines.build_families(self.table("pairs"), self.table("catalog"), self.cfg))

    def print_families(self, numbers: str = "all", stats: bool = False, detailed: bool = False) -> DataFrame:
        members = self.table("families")
        chosen = families.selected(families.summary(members, self.cfg), numbers, self.cfg)
        if stats:
            return families.global_stats(chosen)
        if detailed:
            return families.details(members.join(chosen.select("family_number"), "family_number", "left_semi"))
        return families.table(chosen, families.distance_stats(members))

    def flag_family(self, number: int, valid: bool | str) -> DataFrame:
        return self.put("families", families.flagged(self.table("families"), number, valid))

    def _members(self, numbers: str) -> DataFrame:
        members = self.table("families")
        chosen = families.selected(families.summary(members, self.cfg), numbers, self.cfg)
        return members.join(chosen.select("family_number"), "family_number", "left_semi")

    def members_of(self, source: str = "catalog") -> DataFrame:
        """Families from the catalog scan, or from detections of templates."""
        if source == "catalog":
            return self.table("families")
        if source != "templates":
            raise ValueError("source is catalog or templates")
        return self.table("detections").select("evid", "trace_id", "orig_time", "lon", "lat", "depth_km", F.lit(None).cast("string").alias("mag_type"), F.lit(None).cast("double").alias("mag"), "family_number", F.lit(True).alias("valid"))

    def build_templates(self, numbers: str = "all", lags: int | None = None, stations: DataFrame | None = None) -> DataFrame:
        return self.put("templates", pipelines.build_templates(self._members(numbers), self.table("waveforms"), lags, self.cfg, stations))

    def scan_templates(self, samples: DataFrame, step_s: float, mode: str = "replace", conditioned: bool = True) -> DataFrame:
        """Detections in samples (trace_id, ts, value). `mode` is replace, append (same event and template: the new one stays), or abort if there are stored ones.

        Chunks and templates are passed through the settings' band unless `conditioned` is false.
        """
        if mode not in ("replace", "append", "abort"):
            raise ValueError("mode is replace, append or abort")
        stored = self.table("detections")
        if mode == "abort" and not stored.isEmpty():
            raise RuntimeError("there are stored detections")
        rows = templates.series(samples, self.cfg.time_chunk_s, self.cfg.time_chunk_overlap_s, step_s)
        known = self.table("templates")
        told = templates.scanned(rows, known, step_s, self.cfg.min_cc_mad_ratio, int(self.cfg.time_chunk_s / step_s), self.cfg if conditioned else None)
        found = told.join(known.select("family_number", "lat", "lon", "depth_km"), "family_number", "left").drop("mad_ratio").withColumn("cc_max", F.round("cc_max", 2))
        kept = stored.limit(0) if mode != "append" else stored.join(found, ["family_number", "trace_id", "evid"], "left_anti")
        return self.put("detections", kept.unionByName(found))

    def clear_detections(self) -> DataFrame:
        return self.put("detections", self.table("detections").limit(0))

    def plot(self, what: str, numbers: str = "all", **options) -> DataFrame:
        """The data of a figure: cumulative, timespans, map or traces."""
        members = self._members(numbers)
        summaries = families.summary(members, self.cfg)
        if what == "cumulative":
            return plotdata.cumulative(members, options.get("quantity", "slip"), self.cfg)
        if what == "timespans":
            return plotdata.timespans(members, summaries, options.get("sort_by", "depth"), options.get("origin"))
        if what == "map":
            return plotdata.map_points(summaries)
        if what == "traces":
            rows = plotdata.first_families(members).join(self.table("waveforms").select("evid", "trace_id", "sampling_rate", "data"), ["evid", "trace_id"])
            return plotdata.family_traces(templates.aligned(rows, None, cfg=self.cfg))
        raise ValueError("what is cumulative, timespans, map or traces")

    def wfcache(self, verb: str, **options) -> DataFrame:
        """print, summary, top, inspect, prefetch, download, extract, or reset-failures.

        prefetch tells the windows to download; download asks `fetch` for those that are neither stored nor blocked, and stores what comes and what failed. reset-failures
        tells what it removes, and removes it unless dry_run.
        """
        stored = self.table("waveforms")
        if verb == "print":
            return cache.listing(stored.drop("data"), **options)
        if verb == "summary":
            return cache.summary(stored)
        if verb == "top":
            return cache.top_traces(stored)
        if verb == "inspect":
            failed = cache.failure_summary(self.table("failures"), options.get("now", F.current_timestamp()))
            return cache.summary(stored).crossJoin(failed).crossJoin(cache.readable(stored)[1])  # one row each
        if verb == "prefetch":
            return pipelines.prefetch_plan(self.table("catalog"), options.pop("stations"), self.cfg, **options)
        if verb == "download":
            return self._download(options.pop("stations"), options.pop("fetch"), **options)
        if verb == "extract":
            return waveform_files.extract(cache.listing(stored, **{k: options.pop(k) for k in ("evids", "trace_ids", "start", "end", "limit") if k in options}), **options)
        if verb in ("reset", "reset-failures"):
            dry = options.pop("dry_run", False)
            kept, gone = cache.reset(self.table("failures"), **options)
            if not dry:
                gone = stage(gone, "gone")
                self.put("failures", kept)
            return gone
        raise ValueError("verb is print, summary, top, inspect, prefetch, download, extract or reset-failures")

    def _download(self, stations: DataFrame, fetch, now=None, **options) -> DataFrame:
        """One row for each status (fetched, unavailable, ok, no_waveform) with its number."""
        now = F.current_timestamp() if now is None else now
        plan = pipelines.prefetch_plan(self.table("catalog"), stations, self.cfg, **options)
        state = self.table("failures")
        wanted = plan.select("evid", "trace_id", F.col("start_ts").alias("req_start"), F.col("end_ts").alias("req_end"))
        told = stage(cache.decided(wanted, self.table("waveforms"), state, now, self.cfg.cover_tolerance_s), "decided")
        todo = told.where("status = 'pending'").select("evid", "trace_id", F.col("req_start").alias("start_ts"), F.col("req_end").alias("end_ts"))
        got = stage(waveform_files.download(plan.join(todo, ["evid", "trace_id", "start_ts", "end_ts"], "left_semi"), fetch), "downloaded")
        new = got.where("status = 'ok'").select("evid", "trace_id", F.col("req_start").alias("start_ts"), F.col("req_end").alias("end_ts"), "sampling_rate", "npts", "data")
        self.put("waveforms", cache.inserted(self.table("waveforms"), new))
        bad = got.where("status <> 'ok'").select("evid", "trace_id", F.col("req_start").alias("start_ts"), F.col("req_end").alias("end_ts"), F.col("error").alias("last_error"))
        self.put("failures", cache.failed_again(state, bad, got.where("status = 'ok'"), now, self.cfg.retry_base_s, self.cfg.max_retries))
        return told.where("status <> 'pending'").select("status").unionAll(got.select("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
