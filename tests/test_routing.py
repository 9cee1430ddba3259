from vigil.operators import routing as ro


def test_select_model_reasons(spark):
    rows = [("openrouter", None, "x" * 3600, None), ("openrouter", None, "see CVE-2024-1", None),
            ("openrouter", None, "hello", "Daily_Digest"), ("openrouter", None, "hi", None),
            ("OpenAI", None, "hi", None), ("openrouter", " my/model ", "hi", None), ("none", None, "hi", None)]
    df = spark.createDataFrame(rows, "provider string, model string, message string, use_case string")
    got = [(r["selected_model"], r["selected_by"]) for r in ro.select_model(df).collect()]
    assert got == [(ro.LARGE_MODEL, "policy:long-text"), (ro.LARGE_MODEL, "policy:digest"),
                   (ro.LARGE_MODEL, "policy:digest"), (ro.DEFAULT_MODEL, "policy:default"),
                   (ro.OPENAI_MODEL, "policy:openai-default"), ("my/model", "explicit"), (None, "explicit")]


def test_parse_response_edge_cases(spark):
    rows = [('{"choices":[{"message":{"content":"hi"}}]}', 0, None, None),
            ('{"choices":[]}', 0, None, None),
            ('{"error":{"message":"quota"}}', 429, "x", None),
            ("{}", 0, None, "timeout"),
            ("{}", 503, None, None)]
    df = spark.createDataFrame(rows, "body string, status_code int, http_error string, http_message string")
    got = [(r["router_status"], r["http_status"], r["answer"]) for r in ro.parse_response(df).collect()]
    assert got == [("OK", 200, "hi"), ("ERROR", 200, "HTTP 200 error"), ("ERROR", 429, "quota"),
                   ("ERROR", 0, "timeout"), ("ERROR", 503, "HTTP 503 error")]


def test_prompt_total_length_guard(spark):
    df = spark.createDataFrame([("q", "c" * 20000), ("q", None)], "message string, context_text string")
    r = ro.build_prompt(df).collect()
    assert r[0]["user_prompt"].endswith("...[TRIMMED DUE TO SIZE]")
    assert r[0]["prompt_chars"] == len(ro.SYSTEM_PROMPT) + len(r[0]["user_prompt"])
    assert r[1]["user_prompt"] == "USER MESSAGE:\nq\n\nCONTEXT:\n(none)"


def test_rank_providers_excludes_failing(spark):
    lat = spark.createDataFrame([("kimi", 100.0, 1), ("openai", 900.0, 10)], "provider string, avg_latency double, total long")
    fails = spark.createDataFrame([("kimi", 5)], "provider string, failures long")
    r = {x["provider"]: x for x in ro.rank_providers(lat, fails).collect()}
    assert r["kimi"]["score"] == ro.NO_SCORE and r["openai"]["selected"]
    empty = spark.createDataFrame([], "provider string, avg_latency double, total long")
    r2 = {x["provider"]: x for x in ro.rank_providers(empty, fails.limit(0)).collect()}
    assert r2["kimi"]["avg_latency"] == ro.NO_LATENCY and r2["kimi"]["selected"]


def test_answer_cap(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a" * 20001, t0, t0 + dt.timedelta(milliseconds=1500))],
                               "content string, started_at timestamp_ntz, ended_at timestamp_ntz")
    r = ro.cap_answer(df).first()
    assert r["answer_length"] == 20000 + len("... [truncated]") and r["latency_ms"] == 1500
