"""The streaming sticky alert equals a brute-force replay of the same rule."""

import pandas as pd

from ohmflow.plans import QUERIES

SF = "/root/testdata/sf0.001"


def brute_force_alerts(spark):
    ev = spark.read.parquet(f"{SF}/events.parquet").toPandas()
    m, sd = ev["value"].mean(), max(ev["value"].std(ddof=1), 1e-6)
    ev["z"] = (ev["value"] - m) / sd
    ev = ev.sort_values(["user_id", "ts", "event_id"])
    wmark = ev["ts"].max() - pd.Timedelta(minutes=1)
    out = []
    for uid, g in ev.groupby("user_id"):
        expiry = None
        for r in g.itertuples():
            if abs(r.z) < 1.5:
                continue
            if expiry is not None and r.ts > expiry[0]:
                out.append((uid, expiry[0], "clear", expiry[1]))
            msg = f"Reading is {'too high' if r.z > 0 else 'too low'} ({round(r.z * 100) / 100:.2f}σ)"
            out.append((uid, r.ts, "raise", msg))
            expiry = (r.ts + pd.Timedelta(seconds=10), msg)
        if expiry is not None and expiry[0] < wmark:
            out.append((uid, expiry[0], "clear", expiry[1]))
    return sorted((int(u), pd.Timestamp(t).floor("ms"), k, s) for u, t, k, s in out)


def test_stream_alerts_match_replay(spark):
    got = QUERIES["stream_alerts"](spark, SF).toPandas()
    got = sorted((int(r.user_id), pd.Timestamp(r.ts).floor("ms"), r.kind, r.message)
                 for r in got.itertuples())
    assert got == brute_force_alerts(spark)


def test_stream_history_over_batches_equals_batch_history(spark, tmp_path):
    """Rows of one minute, mixed over six files: event order decides, not arrival;
    a row that comes after the watermark has passed it is dropped."""
    import os
    import random
    from datetime import datetime, timedelta

    from ohmflow.operators.temporal import recent_history
    from ohmflow.streaming import monitor

    r = random.Random(4)
    start = datetime(2024, 1, 1)
    files = []
    rid = 0
    for batch in range(6):
        rows = []
        for _ in range(150):
            rid += 1
            seconds = batch * 50 + r.choice([r.randint(0, 40), 7])      # ties and rows behind
            rows.append((rid, r.choice([1, 1, 1, 2, None]), start + timedelta(seconds=seconds),
                         r.choice([float(r.randint(0, 9)), None]), float(rid)))
        files.append(rows)
    files[5].append((10_000, 1, start, 5.0, 5.0))                       # long after its time
    names = ["event_id", "user_id", "ts", "value", "z"]
    schema = "event_id long, user_id long, ts timestamp, value double, z double"
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path))
        for f in tmp_path.glob("*.parquet"):
            if os.stat(f).st_mtime > 1e9 + 100:
                os.utime(f, (1e9 + k, 1e9 + k))
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path)))
    out = monitor.run_available(monitor.history_stream(stream, rows=7), "history-test")
    got = {x.event_id: (x.user_id, list(x.value_history), list(x.z_history)) for x in out.collect()}

    full = spark.createDataFrame([x for rows in files for x in rows if x[0] != 10_000], schema)
    mark = full.agg({"ts": "max"}).first()[0] - timedelta(minutes=1)
    pdf = pd.DataFrame([x for rows in files for x in rows], columns=names)
    pdf = pdf[(pdf["event_id"] != 10_000)].sort_values(["ts", "event_id"])
    want = {}
    for uid, g in pdf.groupby("user_id", dropna=False):
        v, z = g["value"].tolist(), g["z"].tolist()
        for k, x in enumerate(g.itertuples()):
            if x.ts < mark:
                want[x.event_id] = (None if pd.isna(uid) else int(uid),
                                    [None if pd.isna(y) else y for y in v[max(0, k - 6):k + 1]],
                                    z[max(0, k - 6):k + 1])
    assert got == want and len(want) > 500
    batch = recent_history(full, ["ts", "event_id"], ["user_id"], "z", rows=7)
    assert {x.event_id: list(x.history) for x in batch.collect() if x.event_id in want} \
        == {k: v[2] for k, v in want.items()}
