"""python -m seismopair ROOT VERB ...: the verbs of a workspace from the command line."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from .config import Config, duration_seconds, migrate
from .printing import FORMATS, show
from .sources import catalogs, stations, waveforms
from .workspace import Workspace


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="seismopair", description=__doc__)
    p.add_argument("root", help="folder of the stored tables")
    p.add_argument("-c", "--config", help="settings as JSON")
    p.add_argument("--freq-band", nargs=2, type=float, metavar=("LOW", "HIGH"), help="band in Hz, in place of the settings'")
    p.add_argument("-f", "--format", choices=FORMATS, default="simple")
    verbs = p.add_subparsers(dest="verb", required=True)
    verbs.add_parser("sample_config")
    verbs.add_parser("update_config", help="write the settings of --config anew, with present names and all defaults; the old file stays as FILE.bak")
    v = verbs.add_parser("read_catalog")
    v.add_argument("file")
    v.add_argument("-a", "--append", action="store_true")
    verbs.add_parser("print_catalog")
    v = verbs.add_parser("scan_catalog")
    v.add_argument("--mode", choices=("overwrite", "continue", "abort"), default="overwrite")
    v.add_argument("--continue", dest="mode", action="store_const", const="continue")
    v.add_argument("--stations", help="delimited station file: pairs are looked up on the nearest trace that both events have")
    v = verbs.add_parser("print_pairs")
    v.add_argument("--cc-min", type=float)
    v.add_argument("--cc-max", type=float)
    v.add_argument("--order-by")
    v.add_argument("--descending", action="store_true")
    v.add_argument("--offset", type=int, default=0)
    v.add_argument("--limit", type=int)
    verbs.add_parser("build_families")
    v = verbs.add_parser("print_families")
    v.add_argument("numbers", nargs="?", default="all")
    v.add_argument("-S", "--stats", action="store_true")
    v.add_argument("-d", "--detailed", action="store_true")
    v = verbs.add_parser("flag_family")
    v.add_argument("number", type=int)
    v.add_argument("valid")
    v = verbs.add_parser("build_templates")
    v.add_argument("numbers", nargs="?", default="all")
    v.add_argument("--stations", help="delimited station file, for P and S times")
    v = verbs.add_parser("scan_templates")
    v.add_argument("samples", help="Parquet table of trace_id, ts, value")
    v.add_argument("--step", type=float, required=True, help="seconds between samples")
    v.add_argument("--mode", choices=("replace", "append", "abort"), default="replace")
    v = verbs.add_parser("plot")
    v.add_argument("what", choices=("cumulative", "timespans", "map", "traces"))
    v.add_argument("numbers", nargs="?", default="all")
    v = verbs.add_parser("plot_pair")
    v.add_argument("evid1")
    v.add_argument("evid2")
    v = verbs.add_parser("wfcache")
    v.add_argument("what", choices=("print", "summary", "top", "inspect", "prefetch", "download", "extract", "reset-failures"))
    v.add_argument("--evid", action="append", help="event (repeatable)")
    v.add_argument("--evid-file", help="file with an event a line")
    v.add_argument("--traceid", action="append", help="trace (repeatable)")
    v.add_argument("--start")
    v.add_argument("--end")
    v.add_argument("--limit", type=int)
    v.add_argument("--stations", help="delimited station file, for prefetch and download")
    v.add_argument("--url", help="waveform web service, for download")
    v.add_argument("--max-events", type=int)
    v.add_argument("--group-window", default="1h", help="longest span of a request")
    v.add_argument("--folder", help="where extract writes")
    v.add_argument("--form", choices=("MSEED", "SAC"), default="MSEED")
    v.add_argument("--all", action="store_true", help="reset all failures")
    v.add_argument("--older-than", help="reset failures older than a duration such as 6h or 7d")
    v.add_argument("--dry-run", action="store_true")
    return p


def cached(w: Workspace, a: argparse.Namespace):
    """The frame of a wfcache verb."""
    named = list(a.evid or [])
    if a.evid_file:
        named += [r["evid"] for r in catalogs.read_ids(w.spark, a.evid_file).collect()]  # a list made by hand
    if a.what in ("print", "extract"):
        rows = {"evids": named or None, "trace_ids": a.traceid, "start": a.start, "end": a.end, "limit": a.limit}
        return w.wfcache(a.what, **rows) if a.what == "print" else w.wfcache("extract", folder=a.folder or f"{w.root}/extracted", form=a.form, **rows)
    if a.what in ("prefetch", "download"):
        more = {"stations": stations.read_delimited(w.spark, a.stations), "max_span_s": duration_seconds(a.group_window), "max_events": a.max_events, "evids": w.spark.createDataFrame([(e,) for e in named], "evid string") if named else None}
        return w.wfcache(a.what, **more, **({"fetch": waveforms.service_fetch(a.url)} if a.what == "download" else {}))
    if a.what == "reset-failures":
        return w.wfcache(a.what, evids=named or None, older_than_s=duration_seconds(a.older_than) if a.older_than else None, everything=a.all, dry_run=a.dry_run)
    return w.wfcache(a.what)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    cfg = Config()
    if a.config:
        with open(a.config) as f:
            cfg, unknown = migrate(json.load(f))
        for name in unknown:
            print(f"no such setting: {name}")
    if a.freq_band:
        cfg = cfg.with_(cc_freq_min=a.freq_band[0], cc_freq_max=a.freq_band[1])
    if a.verb == "update_config" and a.config:
        os.replace(a.config, f"{a.config}.bak")
        with open(a.config, "w") as f:
            json.dump(cfg.as_dict(), f, indent=2)
        return
    if a.verb in ("sample_config", "update_config"):
        print(json.dumps(cfg.as_dict(), indent=2))
        return
    spark = SparkSession.builder.appName("seismopair").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    w = Workspace(spark, a.root, cfg)
    rows = {
        "read_catalog": lambda: w.read_catalog(a.file, a.append),
        "print_catalog": w.print_catalog,
        "scan_catalog": lambda: w.scan_catalog(a.mode, stations.read_delimited(spark, a.stations) if a.stations else None),
        "print_pairs": lambda: w.print_pairs(a.cc_min, a.cc_max, a.order_by, not a.descending, a.offset, a.limit),
        "build_families": w.build_families,
        "print_families": lambda: w.print_families(a.numbers, a.stats, a.detailed),
        "flag_family": lambda: w.flag_family(a.number, a.valid),
        "build_templates": lambda: w.build_templates(a.numbers, stations=stations.read_delimited(spark, a.stations) if a.stations else None),
        "scan_templates": lambda: w.scan_templates(spark.read.parquet(a.samples), a.step, a.mode),
        "plot": lambda: w.plot(a.what, a.numbers),
        "plot_pair": lambda: w.plot_pair(a.evid1, a.evid2),
        "wfcache": lambda: cached(w, a),
    }[a.verb]()
    show(rows, a.format)


if __name__ == "__main__":
    main()
