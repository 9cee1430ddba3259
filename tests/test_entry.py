import os
import subprocess
import sys

import __spark_entry__ as entry
from vigil.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["request_id", "requested_at", "approved_at", "approval_latency_seconds"]


def test_oracle_keys_are_registered():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs)
    assert set(catalog.QUERIES) <= set(qs)
    assert len(catalog.QUERIES) >= 140


def test_python_jobs_run_from_another_folder(tmp_path):
    """Executors get the package with the job, wherever it was started."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "import __spark_entry__ as e\n"
            "from vigil.session import build_session\n"
            "s = build_session('local[2]', 2)\n"
            "q = e.queries()\n"
            "print('ROWS', q['d10_d11_topk_exact'](s, e.SMOKE_DIR).count(), q['b28_search_response'](s, e.SMOKE_DIR).count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    counts = [line.split()[1:] for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert counts and all(int(n) > 0 for n in counts[0]), done.stderr[-2000:]
