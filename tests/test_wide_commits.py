"""temporal_jaccard on commits of more files than the co-change cut."""

import datetime
import itertools

import pytest

import __spark_entry__ as entry


def test_temporal_jaccard_keeps_wide_commits(spark, tmp_path):
    commits = {(1, 1): range(25), (2, 1): range(2), (2, 2): range(3)}
    rows = [(u, datetime.datetime(2024, 1, d, 1, 0, k), f'{{"k": {k}}}') for (u, d), files in commits.items() for k in files]
    events = [(i, ts, u, "click", 1.0, props) for i, (u, ts, props) in enumerate(rows)]
    spark.createDataFrame(events, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    at = {k: {c for c, files in commits.items() if k in files} for k in range(25)}
    name = lambda k: f"src/m{str(k)[0]}/f{k}.py"
    expect = {(name(a), name(b)): pytest.approx(len(at[a] & at[b]) / len(at[a] | at[b]), abs=1e-6) for a, b in itertools.permutations(range(25), 2)}
    got = entry.queries()["temporal_jaccard"](spark, str(tmp_path)).collect()
    assert len(got) == 600 and {(r.file, r.mate): r.jaccard for r in got} == expect
