"""Queries against their SQL on a small scale."""

import os

import pytest

from spanflow import catalogue

DATA = "/root/testdata/sf0.001"


NAMES = (
    "event_runs", "transition_priors", "flatten_orders", "overlay_flags", "labels_at_orders", "turn_at_offset", "confusion_by_source", "subsample_runs",
    "overlap_chunks", "merge_posteriors", "calls_read", "mpeg7_read", "eaf_round_trip", "viterbi_states", "batch_plan", "labels_at_repeated_points", "runs_streamed",
    "logmel_events", "stereo_context_batches", "mixed_annotations", "wav_files_read", "resumed_pass", "overlap_by_combination", "turn_at_border",
)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    done = con.execute(catalogue.ORACLES[name])
    cols = [c[0] for c in done.description]
    want = done.fetchall()
    df = catalogue.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    plain = lambda v: round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else v
    assert sorted((str([plain(r[c]) for c in cols]) for r in df.collect())) == sorted(str([plain(v) for v in r]) for r in want)
