"""Operators on stored waveforms, failed downloads, and the plan of downloads."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import small


def _seconds(t: Column) -> Column:
    return F.unix_micros(t) / 1e6


def covering(requests: DataFrame, cache: DataFrame, tolerance_s: float = 10.0) -> DataFrame:
    """Requests (evid, trace_id, req_start, req_end) with the stored window that serves each: the same one, or else the narrowest that covers it within the tolerance.

    Columns hit_start and hit_end are null for a miss. A request's windows meet by evid and trace.
    """
    stored = cache.select("evid", "trace_id", F.col("start_ts").alias("s"), F.col("end_ts").alias("e"))
    t = F.expr(f"interval {int(tolerance_s * 1e6)} microseconds")
    near = (F.col("c.s") <= F.col("r.req_start") + t) & (F.col("c.e") + t >= F.col("r.req_end"))
    joined = requests.alias("r").join(stored.alias("c"), (F.col("r.evid") == F.col("c.evid")) & (F.col("r.trace_id") == F.col("c.trace_id")) & near, "left")
    same = (F.col("c.s") == F.col("r.req_start")) & (F.col("c.e") == F.col("r.req_end"))
    order = F.struct((~same).alias("other"), (_seconds(F.col("c.e")) - _seconds(F.col("c.s"))).alias("width"), F.col("c.s"), F.col("c.e"))
    keys = ["evid", "trace_id", "req_start", "req_end"]
    best = joined.groupBy(*(F.col(f"r.{k}") for k in keys)).agg(F.min(F.when(F.col("c.s").isNotNull(), order)).alias("hit"))
    return best.select(*keys, F.col("hit.s").alias("hit_start"), F.col("hit.e").alias("hit_end"))


def inserted(cache: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("evid", "trace_id", "start_ts", "end_ts")) -> DataFrame:
    """Stored rows and those new ones whose key isn't stored; of repeated new ones any one."""
    return cache.unionByName(new.dropDuplicates(list(keys)).join(cache.select(*keys), list(keys), "left_anti"))


def failures(attempts: DataFrame, base_s: float = 60.0, max_retries: int = 5, keys: tuple[str, ...] = ("evid", "trace_id")) -> DataFrame:
    """State after failed attempts (keys, ts): retry_count, first and last failure, and when the next try is due, the wait doubling each time."""
    found = attempts.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("retry_count"), F.min("ts").alias("first_failure_ts"), F.max("ts").alias("last_failure_ts"))
    wait = F.lit(base_s) * F.pow(F.lit(2.0), F.col("retry_count") - 1)
    due = F.timestamp_micros(F.unix_micros("last_failure_ts") + F.least(wait * 1e6, F.lit(9e17)).cast("bigint"))
    return found.withColumns({"max_retries": F.lit(max_retries), "next_retry_after_ts": due})


def failed_again(state: DataFrame, bad: DataFrame, good: DataFrame, now: Column, base_s: float = 60.0, max_retries: int = 5) -> DataFrame:
    """State after one round of downloads: a failed key counts up and waits twice as long as before, one that worked is cleared, others stay.

    A key is evid, trace_id and the window; `bad` has last_error, `good` evid and trace_id, with the window as req_start and req_end.
    """
    window = ["evid", "trace_id", "start_ts", "end_ts"]
    old = state.join(good.select("evid", "trace_id", F.col("req_start").alias("start_ts"), F.col("req_end").alias("end_ts")), window, "left_anti")
    new = bad.groupBy(*window).agg(F.max("last_error").alias("_error")).withColumn("_new", F.lit(1))
    both = old.join(new, window, "full")
    count = F.coalesce("retry_count", F.lit(0)) + F.coalesce("_new", F.lit(0))
    wait = F.least(F.lit(base_s) * F.pow(F.lit(2.0), count - 1) * 1e6, F.lit(9e17)).cast("bigint")
    fresh = F.col("_new").isNotNull()
    return both.select(
        *window, count.cast("int").alias("retry_count"), F.when(fresh, F.lit(max_retries)).otherwise(F.col("max_retries")).cast("int").alias("max_retries"), F.coalesce("_error", "last_error").alias("last_error"),
        F.coalesce("first_failure_ts", F.when(fresh, now)).alias("first_failure_ts"), F.when(fresh, now).otherwise(F.col("last_failure_ts")).alias("last_failure_ts"), F.when(fresh, F.timestamp_micros(F.unix_micros(now) + wait)).otherwise(F.col("next_retry_after_ts")).alias("next_retry_after_ts"),
    )


def skip_reason(now: Column) -> Column:
    """Why a download isn't tried: exhausted (until reset), backoff (until due), or null."""
    return F.when(F.col("retry_count") >= F.col("max_retries"), "exhausted").when(now < F.col("next_retry_after_ts"), "backoff")


def exhausted(state: DataFrame, now: Column, max_retries: int) -> DataFrame:
    """Keys that reached the stored or the present limit and aren't due (or never will be)."""
    limit = F.least("max_retries", F.lit(max_retries))
    return state.where((F.col("retry_count") >= limit) & (F.col("next_retry_after_ts").isNull() | (now < F.col("next_retry_after_ts"))))


def reset(state: DataFrame, evids: list[str] | None = None, older_than_s: float | None = None, now: Column | None = None, everything: bool = False) -> tuple[DataFrame, DataFrame]:
    """(what stays, what a reset removes); without a filter only `everything` removes, and it takes no heed of filters."""
    if everything:
        gone = F.lit(True)
    elif evids is None and older_than_s is None:
        raise ValueError("a reset needs a filter, or everything=True")
    else:
        gone = F.lit(True)
        if evids is not None:
            gone &= F.col("evid").isin(evids)
        if older_than_s is not None:
            gone &= _seconds(F.col("last_failure_ts")) <= _seconds(now if now is not None else F.current_timestamp()) - older_than_s
    return state.where(~F.coalesce(gone, F.lit(False))), state.where(gone)


def summary(cache: DataFrame) -> DataFrame:
    """One row: entries, first start, last end."""
    return cache.agg(F.count(F.lit(1)).alias("entries"), F.min("start_ts").alias("first_start"), F.max("end_ts").alias("last_end"))


def failure_summary(state: DataFrame, now: Column) -> DataFrame:
    """One row: failures, exhausted ones, and those waiting."""
    return state.agg(F.count(F.lit(1)).alias("failures"), F.count_if(F.col("retry_count") >= F.col("max_retries")).alias("exhausted"), F.count_if((F.col("retry_count") < F.col("max_retries")) & (now < F.col("next_retry_after_ts"))).alias("pending"))


def top_traces(cache: DataFrame, n: int = 10) -> DataFrame:
    """The traces with the most entries; ties go by trace_id."""
    return cache.groupBy("trace_id").agg(F.count(F.lit(1)).alias("entries")).orderBy(F.desc("entries"), "trace_id").limit(n)


def listing(cache: DataFrame, evids: list[str] | None = None, trace_ids: list[str] | None = None, start: str | None = None, end: str | None = None, limit: int | None = None) -> DataFrame:
    """Entries of these events and traces that reach into the time span, by start, event and trace."""
    rows = cache
    if evids:
        rows = rows.where(F.col("evid").isin(evids))
    if trace_ids:
        rows = rows.where(F.col("trace_id").isin(trace_ids))
    if start is not None:
        rows = rows.where(F.col("end_ts") >= F.lit(start).cast("timestamp"))
    if end is not None:
        rows = rows.where(F.col("start_ts") <= F.lit(end).cast("timestamp"))
    rows = rows.orderBy("start_ts", "evid", "trace_id")
    return rows if limit is None else rows.limit(limit)


def requests(events: DataFrame, offsets: DataFrame, pre_s: float, length_s: float) -> DataFrame:
    """Windows to download for each event and trace: from `pre_s` before the earliest P to `length_s` after the latest."""
    rows = events.select("evid", "orig_time").crossJoin(small(offsets))
    at = lambda s: F.timestamp_micros(F.unix_micros("orig_time") + F.round(s * 1e6).cast("bigint"))
    return rows.select("evid", "trace_id", at(F.col("p_min_s") - pre_s).alias("start_ts"), at(F.col("p_max_s") + length_s).alias("end_ts"))


def event_windows(arrivals: DataFrame, pre_s: float, length_s: float) -> DataFrame:
    """Windows around each event's own P time (evid, trace_id, p_time): from `pre_s` before it, `length_s` long; a row without a P time has none."""
    at = lambda s: F.timestamp_micros(F.unix_micros("p_time") + F.lit(round(s * 1e6)))
    return arrivals.where("p_time is not null").select("evid", "trace_id", at(-pre_s).alias("start_ts"), at(length_s - pre_s).alias("end_ts"))


#: A trace's history is cut into stretches of so many spans, or a day, if that is longer.
SPANS = 24


def _openers(starts: list[int], ends: list[int], span: int) -> list[int]:
    """For each window, in start order, the window that opens the next group if this one opens one; their number if none does."""
    n, out, at = len(starts), [], 0
    for i, first in enumerate(starts):
        at = max(at, i + 1)
        if ends[i] - first <= span:  # a window longer than the span is a group by itself
            while at < n and ends[at] - first <= span:
                at += 1
            out.append(at)
        else:
            out.append(i + 1)
    return out


def _limits(starts: list[int], ends: list[int], span: int) -> list[int]:
    """The end up to which a group that a window opens takes others in; -2^62 if it takes none."""
    return [s + span if e - s <= span else -(1 << 62) for s, e in zip(starts, ends, strict=True)]


def grouped(windows: DataFrame, max_span_s: float, slot_s: float | None = None) -> DataFrame:
    """trace_id, evid, start_ts, end_ts, group_start, group_end: in start order, a window joins its trace's group while the group, from its first start, spans `max_span_s` at most.

    A group depends on the one before, and so runs through a trace in order. A trace is cut into stretches of time (`slot_s` seconds, or SPANS spans),
    a task each. What a stretch does to the group that is open when it begins is a step function of that group's limit, since chains of
    groups that start close to one another soon run together: each task makes the function, these few numbers of a trace are composed in order, and
    then each stretch is told its open group. Windows without a trace or a start are left out.
    """
    span = round(max_span_s * 1e6)
    slot = max(1, round(slot_s * 1e6) if slot_s is not None else max(SPANS * span, 86_400_000_000))
    rows = windows.where("trace_id is not null and start_ts is not null").select("trace_id", "evid", F.unix_micros("start_ts").alias("s"), F.unix_micros(F.greatest("start_ts", F.coalesce("end_ts", "start_ts"))).alias("e"))
    rows = rows.withColumn("slot", F.floor(F.col("s") / F.lit(slot)).cast("bigint"))
    keys = ("trace_id", "slot")

    def ordered(table: pa.Table) -> tuple[pa.Table, list[int], list[int]]:
        table = table.sort_by([("s", "ascending"), ("e", "ascending"), ("evid", "ascending")])
        return table, table["s"].to_pylist(), table["e"].to_pylist()

    def stepped(table: pa.Table) -> pa.Table:
        _, starts, ends = ordered(table)
        following, limits = _openers(starts, ends, span), _limits(starts, ends, span)
        last = [0] * len(starts)
        for i in reversed(range(len(starts))):
            last[i] = last[following[i]] if following[i] < len(starts) else i
        breaks, exits, top = [], [], None
        for i, e in enumerate(ends):  # below the largest end so far, a window before this one opens the first group
            if top is None or e > top:
                if not exits or exits[-1] != limits[last[i]]:
                    breaks.append(e)
                    exits.append(limits[last[i]])
                else:
                    breaks[-1] = e
                top = e
        return pa.table({"trace_id": table["trace_id"][:1], "slot": table["slot"][:1], "breaks": pa.array([breaks], pa.list_(pa.int64())), "exits": pa.array([exits], pa.list_(pa.int64()))})

    def composed(table: pa.Table) -> pa.Table:
        table = table.sort_by("slot")
        limit, entries = -(1 << 62), []
        for breaks, exits in zip(table["breaks"].to_pylist(), table["exits"].to_pylist(), strict=True):
            entries.append(limit)
            at = bisect.bisect_right(breaks, limit)
            limit = exits[at] if at < len(breaks) else limit
        return pa.table({"trace_id": table["trace_id"], "slot": table["slot"], "entry": pa.array(entries, pa.int64())})

    def told(table: pa.Table, entry: pa.Table) -> pa.Table:
        table, starts, ends = ordered(table)
        limit = entry["entry"][0].as_py()
        group = limit - span
        firsts = []
        for s, e in zip(starts, ends, strict=True):
            if e > limit:
                group, limit = s, s + span if e - s <= span else -(1 << 62)
            firsts.append(group)
        return pa.table({"trace_id": table["trace_id"], "evid": table["evid"], "s": table["s"], "e": table["e"], "g": pa.array(firsts, pa.int64())})

    steps = rows.groupBy(*keys).applyInArrow(stepped, "trace_id string, slot bigint, breaks array<bigint>, exits array<bigint>")
    entries = steps.groupBy("trace_id").applyInArrow(composed, "trace_id string, slot bigint, entry bigint")
    found = rows.groupBy(*keys).cogroup(entries.groupBy(*keys)).applyInArrow(told, "trace_id string, evid string, s bigint, e bigint, g bigint")
    end = F.max("e").over(Window.partitionBy("trace_id", "g"))
    return found.select("trace_id", "evid", F.timestamp_micros("s").alias("start_ts"), F.timestamp_micros("e").alias("end_ts"), F.timestamp_micros("g").alias("group_start"), F.timestamp_micros(end).alias("group_end"))


def slow_tasks(tasks: DataFrame, key: str, seconds: str, order: list[str], window: int = 256, least: int = 16, times: float = 10.0) -> DataFrame:
    """Adds median_s over the last `window` tasks before each, and slow: over `times` that, once there are `least`."""
    before = Window.partitionBy(key).orderBy(*order).rowsBetween(-window, -1)
    seen = F.sort_array(F.collect_list(seconds).over(before))
    rows = tasks.withColumns({"_seen": seen, "_n": F.count(F.lit(1)).over(before)})
    at = lambda k: F.try_element_at("_seen", k.cast("int"))
    half = F.size("_seen") / 2
    rows = rows.withColumn("median_s", (at(F.floor(half + 0.5)) + at(F.floor(half) + 1)) / 2).drop("_seen")
    return rows.withColumn("slow", (F.col("_n") >= least) & (F.col(seconds) > times * F.col("median_s"))).drop("_n")


def decided(wanted: DataFrame, stored: DataFrame, state: DataFrame, now: Column, tolerance_s: float = 10.0) -> DataFrame:
    """Requests with status: fetched if a stored window covers one, unavailable if a failure whose window covers it still blocks it, else pending.

    A failure's window covers a request by the same rule as a stored one's; a failure without a window blocks its event's trace.
    """
    found = covering(wanted, stored, tolerance_s)
    t = F.expr(f"interval {int(tolerance_s * 1e6)} microseconds")
    bad = state.where(skip_reason(now).isNotNull()).select(F.col("evid").alias("_e"), F.col("trace_id").alias("_t"), F.col("start_ts").alias("_s") if "start_ts" in state.columns else F.lit(None).cast("timestamp").alias("_s"), F.col("end_ts").alias("_z") if "end_ts" in state.columns else F.lit(None).cast("timestamp").alias("_z"))
    near = F.col("_s").isNull() | ((F.col("_s") <= F.col("req_start") + t) & (F.col("_z") + t >= F.col("req_end")))
    blocked = found.join(bad, (F.col("evid") == F.col("_e")) & (F.col("trace_id") == F.col("_t")) & near, "left_semi").select("evid", "trace_id", "req_start", "req_end", F.lit(True).alias("_blocked"))
    rows = found.join(blocked, ["evid", "trace_id", "req_start", "req_end"], "left")
    return rows.withColumn("status", F.when(F.col("hit_start").isNotNull(), "fetched").when(F.col("_blocked"), "unavailable").otherwise("pending")).drop("_blocked")


def pair_failures(pairs: DataFrame, catalog: DataFrame, status: str = "no_waveform", margin_s: float = 3600.0) -> DataFrame:
    """Failure rows (evid, trace_id, start_ts, end_ts, last_error) for both events of pairs of that status: a window of `margin_s` on either side of the origin time, since the pair doesn't tell which one."""
    bad = pairs.where(F.col("status") == status)
    ends = bad.select(F.col("evid1").alias("evid"), "trace_id").unionAll(bad.select(F.col("evid2").alias("evid"), "trace_id")).distinct()
    at = lambda s: F.timestamp_micros(F.unix_micros("orig_time") + F.lit(int(s * 1e6)))
    return ends.join(catalog.select("evid", "orig_time"), "evid").select("evid", "trace_id", at(-margin_s).alias("start_ts"), at(margin_s).alias("end_ts"), F.lit(status).alias("last_error"))


def readable(cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose trace can be read, one row with the numbers of these and of the others): a row without data, of another number of samples than told, or without a rate is a miss, not an error."""
    good = F.coalesce((F.size("data") > 0) & (F.col("npts").isNull() | (F.size("data") == F.col("npts"))) & (F.col("sampling_rate") > 0), F.lit(False))
    return cache.where(good), cache.agg(F.count_if(good).alias("hits"), F.count_if(~good).alias("read_errors"))
