"""Streams over several batches: state carries over, late rows stay."""

import random

from colonnade.codecs.events import CODECS
from colonnade.streaming import late as L


def test_late_rows_and_recency_over_batches(spark, tmp_path):
    rng, src = random.Random(1), str(tmp_path / "in")
    rows = [(i, i, rng.randrange(3), 1000 + rng.randrange(40)) for i in range(60)]
    schema = "rn long, pos long, repo_id long, epoch_s long"
    stream = lambda: L.parquet_stream(spark, src, schema, files=1)
    done = {"late": [], "lag": []}
    for k in range(3):  # each run takes up where the one before ended
        spark.createDataFrame(rows[20 * k : 20 * k + 20], schema).coalesce(1).write.mode("append").parquet(src)
        done["late"] = L.marked_late(stream(), str(tmp_path / "late")).collect()
        done["lag"] = L.run_available(L.two_lag_deltas(stream()), str(tmp_path / "lag")).collect()
    late, lag, seen, top = {}, {}, {}, 0
    for _, pos, key, t in rows:
        before = seen.setdefault(key, [])
        late[pos], top = t < top, max(top, t)
        lag[pos] = t - (max(before[-2:]) if before else 0)
        before.append(t)
    assert {r.pos: r.late for r in done["late"]} == late
    assert {r.pos: r.d for r in done["lag"]} == lag


def test_micro_batches_and_tumbling_counts(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(str(i), "PushEvent", i % 5, "o", f"r{i % 5}", f"o/r{i % 5}", 3600 * (i // 10) + i, i) for i in range(50)]
    schema = "id string, event_type string, repo_id long, owner string, suffix string, repo_name string, epoch_s long, pos long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(src)
    back = L.encoded_batches(L.parquet_stream(spark, src, schema, files=1), CODECS["row_varints"], str(tmp_path / "enc")).collect()
    assert sorted((r.id, r.repo_name, r.epoch_s) for r in back) == sorted((r[0], r[5], r[6]) for r in rows)
    counts = L.run_available(L.tumbling_counts(L.parquet_stream(spark, src, schema), "1 hour"), str(tmp_path / "tumble"), complete=True).collect()
    assert {r.start: r.n for r in counts} == {3600 * k: 10 for k in range(5)}
    assert len({r.batch for r in back}) == 4
