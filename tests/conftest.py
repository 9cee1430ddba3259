import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from paths import SF_SMALL  # noqa: E402



@pytest.fixture(scope="session")
def spark():
    from vigil.session import build_session
    d = tempfile.mkdtemp(prefix="vigil-test-ckpt-")
    s = build_session("local[4]", 4, app_name="vigil-tests", extra={"spark.checkpoint.dir": d})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from vigil.sources.tables import Tables
    return Tables(spark, SF_SMALL)
