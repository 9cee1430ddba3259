"""Operators without a statement against plain Python, and plans on either side of a size switch."""

import base64
import math
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from vigil.llm import common, fingerprints, langid, quality

# -- operator 5: the forward pass ------------------------------------------------------


def plain_score(net, text):
    """Filters over chunks of 256 bytes that overlap by half, one window of 8 bytes every 4."""
    raw = (text or "").encode()
    embed, bias = net.embed.astype(float), net.bias.astype(float)
    weights = np.concatenate((net.head, net.tail)).astype(float)
    halves = max(1, -(-(len(raw) + 4) // 128))
    padded = raw + b"\0" * (halves * 128 - len(raw))

    def window(at):
        if at + 8 > len(padded):  # the last window of a text has no second half
            return None
        flat = [x for b in padded[at: at + 8] for x in embed[b]]
        return [max(0.0, sum(f * w for f, w in zip(flat, weights[:, k])) + bias[k]) for k in range(len(bias))]

    def pooled(half):
        rows = [window(half * 128 + 4 * k) or [max(0.0, b) for b in bias] for k in range(32)]
        return [max(r[k] for r in rows) for k in range(len(bias))]

    parts = [pooled(h) for h in range(halves)]
    chunks = [[max(a, b) for a, b in zip(parts[i], parts[i + 1])] for i in range(halves - 1)] or [parts[0]]
    features = [sum(c[k] for c in chunks) / len(chunks) for k in range(len(bias))] + [max(c[k] for c in chunks) for k in range(len(bias))]
    z = sum(f * w for f, w in zip(features, net.last)) + net.offset
    return 1 / (1 + math.exp(-z))


def test_network_equals_a_plain_forward_pass():
    rng = np.random.default_rng(2)
    net = quality.Network(rng.normal(size=(256, quality.EMBED)).astype(np.float32), rng.normal(size=(16, 5)).astype(np.float32),
                          rng.normal(size=(16, 5)).astype(np.float32), rng.normal(size=5).astype(np.float32), rng.normal(size=10) / 8, 0.1)
    kept, quality.FILTERS = quality.FILTERS, 5
    try:
        texts = ["", "a", "short text", "x" * 123, "x" * 124, "x" * 125, "é" * 200, "".join(chr(65 + i % 57) for i in range(700)), "日本語 " * 60]
        data, offs = quality.X.text_buffer(pa.array(texts))
        got = net.score(net.features(data, offs))
    finally:
        quality.FILTERS = kept
    assert got == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


# -- operator 8: fingerprints -----------------------------------------------------------

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


BASE, BASE2, WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F


def plain_word(word):
    return mix((sum(mix((b + 1) * BASE & M) * pow(BASE, i, 1 << 64) for i, b in enumerate(word.encode())) + len(word.encode())) & M)


def plain_sketch(text, k=128):
    words = [plain_word(w) for w in brute.SPACED.findall((text or "").translate(brute.LOWER))]
    if len(words) >= 5:
        grams = {mix(sum(w * pow(WORD, i, 1 << 64) for i, w in enumerate(words[j: j + 5])) & M) for j in range(len(words) - 4)}
    else:
        grams = {mix((sum(w * pow(WORD, i, 1 << 64) for i, w in enumerate(words)) + len(words) * BASE2) & M)} if words else set()
    return sorted({g >> 16 for g in grams})[:k]


def test_fingerprints_equal_plain_sketches(odd_rows):
    texts = [t or "" for _, t, _ in odd_rows]
    for text, made in zip(texts, fingerprints.sketches(texts)):
        want = plain_sketch(text)
        assert made.tolist() == want
        assert base64.b64decode(fingerprints.to_text(made)) == b"".join(x.to_bytes(6, "little") for x in want)
    a, b = plain_sketch(texts[0]), plain_sketch(texts[2])
    both = sorted(set(a) | set(b))[:128]
    assert fingerprints.resemblance(np.array(a, np.uint64), np.array(b, np.uint64)) == sum(x in a and x in b for x in both) / len(both)


# -- operator 10: profiles and distances --------------------------------------------------

def plain_grams(text):
    out, word = Counter(), []
    for c in [*(text or ""), " "]:
        if c.isalpha() and ord(c) < 1 << 18:
            word.append(c.lower() if len(c.lower()) == 1 else c)
            continue
        if word:
            w = "".join(word)
            out.update(w)
            out.update((" " + w + " ")[i: i + 2] for i in range(len(w) + 1))
            out.update((" " + w + " ")[i: i + 3] for i in range(len(w)))
        word = []
    return out


def number(gram):
    n = len(gram) << 60
    for i, c in enumerate(gram):
        n |= (0 if c == " " else ord(c)) << (langid._BITS * (len(gram) - 1 - i))
    return n


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))][:size]


def test_profiles_and_distances_equal_plain_python(spark):
    texts = [(1, "The cat and the dog, the end.", "en"), (2, "Der Hund und die Katze; Ende gut!", "de"), (3, "another one in English here", "en"),
             (4, "noch ein Satz auf Deutsch", "de"), (5, "ÉTÉ à Straße ŉ İx", "fr"), (6, "", "fr"), (7, None, "fr")]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    profiles = langid.learn_profiles(df, size=40)
    plain = {}
    for name in ("en", "de", "fr"):
        counts = Counter()
        for _, t, lang in texts:
            if lang == name:
                counts += plain_grams(t)
        plain[name] = ranked(counts, 40)
        assert profiles[name] == [number(g) for g in plain[name]]
    judge = langid.Judge(profiles, 20)
    for text in ("the end of the dog", "die Katze", "été", "12 !", "x", "cat Hund"):
        top = ranked(plain_grams(text), 20)
        if not top:
            assert judge(text) == ("und", 0.0)
            continue
        distance = {n: sum(min(abs(p.index(g) - i), 40) if g in p else 40 for i, g in enumerate(top)) for n, p in plain.items()}
        order = sorted(distance, key=lambda n: (distance[n], n))
        first, second = distance[order[0]], distance[order[1]]
        assert judge(text) == (order[0], pytest.approx((second - first) / second if second else 0.0))


# -- size switches ------------------------------------------------------------------------

def rows_of(df):
    return sorted(map(str, df.collect()))


def test_plans_without_broadcast_give_the_same_rows(spark, odd, monkeypatch):
    from vigil.llm import decontaminate, neardup, spelling, wrappers
    items = spark.createDataFrame([(1, " ".join(f"w1x{(i * 7 + 1) % 1000}" for i in range(20))), (2, "one two"), (None, "same same same"), (3, None)],
                                  "item_id long, text string")
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.org/{i}", f"<body><nav>n</nav><article><h1>T{i}</h1><p>x{i}</p></article></body>") for i in range(12)],
                                  "page_id long, url string, html string")
    words = spark.createDataFrame([(f"word{'abcdefg'[i % 7]}{i // 7}", 5 + i) for i in range(40)], "word string, n long")
    jobs = {"op1": lambda: decontaminate.decontaminate(odd, items), "op2": lambda: neardup.near_duplicates(odd),
            "op3": lambda: wrappers.extract(pages), "op12": lambda: spelling.near_words(words, shard_rows=15),
            "contaminated": lambda: decontaminate.without_contaminated(odd, items)}
    want = {name: rows_of(job()) for name, job in jobs.items()}

    def plain(df, limit=0):
        return df

    for module in (common, decontaminate, neardup, wrappers, spelling):
        monkeypatch.setattr(module, "maybe_broadcast", plain, raising=False)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, job in jobs.items():
            assert rows_of(job()) == want[name], name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


# -- the pipeline on odd tables --------------------------------------------------------------

@pytest.fixture(scope="module")
def odd_dir(spark, odd_rows, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd-tables"))
    full = [(i, t, la, "src0", len(t) if t is not None else None, "clash", "clash") for i, t, la in odd_rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, part string, key string")
    docs.repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 0, 0), (None, 1, 0), (9, 1, 1), (9, 0, 0), (11, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w9x{(i * 7 + 9) % 1000}" for i in range(12))), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_pipeline_on_odd_tables(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        kept = stage(spark, docs, odd_dir)
        assert kept.columns == docs.columns, name
        if name == "near_duplicates":
            texts = [r["text"] for r in kept.collect() if r["text"] and r["text"].split()]
            assert len(texts) == len(set(texts))  # one row of each group, with or without an id
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    pieces = cp.run(spark, odd_dir)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").distinct().collect()}


def test_pipeline_on_empty_tables(spark, odd_dir, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
    none = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    # documents, but neither labels nor items
    spark.read.parquet(f"{odd_dir}/documents.parquet").write.parquet(f"{tmp_path}/more/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/more/{t}.parquet")
    assert cp.run(spark, f"{tmp_path}/more").agg(F.count("length")).first()[0] > 0
