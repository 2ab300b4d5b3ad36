"""Schemas of the stored tables."""

from __future__ import annotations

CATALOG = "evid string, orig_time timestamp, lat double, lon double, depth_km double, mag_type string, mag double, mag_author string, author string, catalog string, contributor string, contributor_id string, location_name string, trace_id string"
TRACE_METADATA = "trace_id string, valid_from timestamp, valid_to timestamp, sampling_rate_hz double, trace_lon double, trace_lat double, elevation double, local_depth double, updated_at timestamp"
PAIRS = "evid1 string, evid2 string, trace_id string, lag_samples int, cc_x100 int, sampling_rate_hz double, status string"
FAMILIES = "evid string, trace_id string, orig_time timestamp, lon double, lat double, depth_km double, mag_type string, mag double, family_number int, valid boolean"
DETECTIONS = "family_number int, trace_id string, evid string, orig_time timestamp, lon double, lat double, depth_km double, cc_max double"
WAVEFORMS = "evid string, trace_id string, start_ts timestamp, end_ts timestamp, sampling_rate double, npts int, data array<double>"
FAILURES = "evid string, trace_id string, start_ts timestamp, end_ts timestamp, retry_count int, max_retries int, last_error string, first_failure_ts timestamp, last_failure_ts timestamp, next_retry_after_ts timestamp"
