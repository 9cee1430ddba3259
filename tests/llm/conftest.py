import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, part int, key string, bucket string, window string, "
        "component string, score string, shard string, length string, text_hash string, digest string")


def passage(n, seed):
    return " ".join(f"w{seed}x{(i * 7 + seed) % 1000}" for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang): nulls, empty and long texts, copies, repeated rows."""
    base = passage(120, 1)
    near = " ".join(w if i % 60 else "changed" for i, w in enumerate(base.split()))
    rows = [
        (1, base, "en"), (2, base, "en"), (3, near, "en"), (4, None, "en"), (5, "", None), (6, "   \n\t ", "fr"),
        (7, "one two", "en"), (8, "ONE\ttwo", "en"), (9, passage(300, 2) + "\n" + passage(40, 9), "de"),
        (10, passage(50, 3) + " " + passage(40, 9) + " tail", "de"), (11, "same " * 200, "fr"), (12, passage(9000, 4), None),
        (13, "Éa   éb 日本語 test", "fr"), (14, "one two", "en"), (15, passage(34, 5), "en"), (16, passage(34, 5), "en"),
        (17, "!!! ??? ...", "en"), (None, passage(60, 6), "en"), (None, None, None), (20, passage(80, 7), "en"), (20, passage(80, 7), "en"),
    ]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    full = [(i, t, la, "src0", len(t) if t is not None else None, 3, "k", "b", "w", "c", "s", "h", "l", "th", "d") for i, t, la in odd_rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
