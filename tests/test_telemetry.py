import datetime as dt

from vigil.operators import telemetry as tm


def test_format_size_python_rounding(spark):
    def py(size):
        for unit in ["B", "KB", "MB", "GB"]:
            if size < 1024.0:
                return f"{size:.2f} {unit}"
            size /= 1024.0
        return f"{size:.2f} TB"
    vals = [0, 1, 1023, 1024, 1152, 1536, 2.675 * 1024, 1048575, 10 ** 9, 5 * 1024 ** 4, 0.125 * 1024, 128]
    df = spark.createDataFrame([(float(v),) for v in vals], "s double")
    got = [r[0] for r in df.select(tm.format_size("s")).collect()]
    assert got == [py(float(v)) for v in vals]


def test_execution_result_traceback(spark):
    err = "x\nTraceback (most recent call last):\n  File \"a.py\"\nKeyError: 'k'\n\nTraceback (most recent call last):\nB"
    df = spark.createDataFrame([(1, err), (0, "")], "exit_code int, stderr string")
    r = tm.execution_result(df).orderBy("exit_code").collect()
    assert r[0]["status"] == "success" and r[0]["error_traceback"] is None
    assert r[1]["error_message"] == "KeyError: 'k'"
    assert r[1]["error_traceback"] == "Traceback (most recent call last):\n  File \"a.py\"\nKeyError: 'k'\n\n"


def test_sessionize_brute_force(spark):
    import random
    random.seed(3)
    t0 = dt.datetime(2024, 1, 1)
    rows = [(i, "hot" if random.random() < 0.7 else "k2", t0 + dt.timedelta(seconds=random.randint(0, 20000)))
            for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, key string, ts timestamp_ntz")
    got = sorted((r["key"], r["started_at"], r["last_event_at"], r["events"])
                 for r in tm.sessionize(df, "key", "ts", "event_id", 300, bucket_seconds=600).collect())
    exp = []
    for key in ("hot", "k2"):
        evs = sorted((ts, i) for i, k, ts in rows if k == key)
        cur = None
        for ts, _ in evs:
            if cur is None or (ts - cur[1]).total_seconds() > 300:
                if cur:
                    exp.append((key, cur[0], cur[1], cur[2]))
                cur = [ts, ts, 0]
            cur[1] = ts
            cur[2] += 1
        exp.append((key, cur[0], cur[1], cur[2]))
    assert got == sorted(exp)
