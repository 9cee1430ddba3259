"""Each operator on odd inputs and against a plain restatement."""

import hashlib
import random
import zlib

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F


def _distinct_rows(odd_rows):
    seen = {}
    for i, t, _ in odd_rows:
        if i is not None:
            seen[i] = t
    return sorted(seen.items())


# ------------------------------------------------------------------ 1
def _items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string, key string, term string")


def test_decontaminate(spark, odd, odd_rows):
    from vigil.llm.decontaminate import decontaminate
    long = dict(_distinct_rows(odd_rows))[12].split()
    rows = [(1, " ".join(long[50:75])), (2, "Two, ONE two!"), (3, ""), (4, None), (5, "one TWO"), (5, "one TWO"), (6, " ".join(long[60:70])), (None, "same same")]
    got = decontaminate(odd, _items(spark, [(*r, "k", "t") for r in rows])).collect()
    assert len(got) == len(odd_rows)
    want = brute.contaminated([(i, t) for i, t, _ in odd_rows], rows)
    expect = sorted((str(r[0]), *w) for r, w in zip(odd_rows, want))
    seen = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items_sha256"], r["n_items"], r["contaminated"]) for r in got)
    assert seen == sorted((i, n, h, hashlib.sha256(s.encode()).hexdigest(), len(s.split(",")) if s else 0, h > 0) for i, n, h, s in expect)
    assert any(r["n_items"] for r in got)


def test_decontaminate_empty(spark, odd, empty, odd_rows):
    from vigil.llm.decontaminate import decontaminate, without_contaminated
    none = _items(spark, [])
    assert decontaminate(empty, none).count() == 0
    assert decontaminate(odd, none).where("contaminated").count() == 0
    kept = without_contaminated(odd, _items(spark, [(1, "one two", "k", "t")]))
    assert kept.columns == odd.columns
    assert kept.count() == len(odd_rows) - 3


def test_proximity(spark):
    from vigil.llm import decontaminate as d
    docs = spark.createDataFrame([(1, "alpha x beta y y gamma"), (2, "gamma Beta alpha"), (3, "alpha " + "z " * 50 + "beta gamma"), (4, None), (2, "gamma Beta alpha")],
                                 "doc_id long, text string")
    phrases = d.stored(spark.createDataFrame([(0, "alpha beta gamma"), (1, "alpha beta nowhere")], "window long, phrase string"), "t")
    terms = d.stored(d.phrase_terms(phrases), "t")
    index = d.build_index(docs, d.stored(terms.select("term", "term_id").distinct(), "t"))
    near = d.near_matches(docs, index, terms, 6).where("n_near > 0")
    assert {(r["doc_id"], r["n_near"]) for r in near.collect()} == {(1, 1), (2, 1)}


def test_proximity_equals_brute_force(spark):
    import random

    from vigil.llm.decontaminate import decontaminate
    rng = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(0, 150)))) for i in range(40)]
    items = [(j, " ".join(rng.choices(words, [1 / (k + 1) for k in range(60)], k=rng.randint(1, 12)))) for j in range(25)] + [(90, "w1 w1 w1"), (91, "unheard w1")]
    got = {r["doc_id"]: r["n_near"] for r in decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), _items(spark, [(*r, "k", "t") for r in items])).collect()}
    assert got == brute.near(docs, items) and len(set(got.values())) > 2


# ------------------------------------------------------------------ 2
def test_near_duplicates_odd(odd, odd_rows):
    from vigil.llm.neardup import near_duplicates
    want = brute.near_duplicates(_distinct_rows(odd_rows))
    got = near_duplicates(odd).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
            assert r["kept"] == (r["doc_id"] == r["component_id"])


def _family(n, length, changes, seed):
    """Texts that differ from one another in several words: chains of links."""
    rnd = random.Random(seed)
    now = [f"b{i}" for i in range(length)]
    out = []
    for k in range(n):
        out.append(" ".join(now))
        for _ in range(changes):
            now[rnd.randrange(length)] = f"n{seed}x{k}x{rnd.random()}"
    return out


def test_near_duplicates_chains_and_near_misses(spark):
    from vigil.llm.neardup import near_duplicates
    texts = _family(60, 90, 1, 1) + _family(60, 90, 2, 2) + _family(40, 60, 3, 3) + _family(30, 20, 1, 4)
    rows = list(enumerate(texts))
    random.Random(5).shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.near_duplicates(rows).items()}


def test_near_duplicates_empty_and_kept(odd, empty, odd_rows):
    from vigil.llm.neardup import near_duplicates, without_near_duplicates
    assert near_duplicates(empty).count() == 0
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    want = [i for i, (_, c) in brute.near_duplicates(_distinct_rows(odd_rows)).items() if i == c]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def test_one_row_of_a_group_stays(spark):
    """Also where rows of a group share an id or have none."""
    from vigil.llm.neardup import without_near_duplicates
    base = [f"w{k}" for k in range(200)]
    near = [" ".join(base[:k] + ["other"] + base[k + 1:]) for k in (0, 50, 100, 199)]
    lone = [" ".join(f"{c}{k}" for k in range(90)) for c in "xyz"]
    rows = [(1, near[0]), (1, near[1]), (1, near[1]), (2, near[2]), (None, near[3]), (None, near[3]), (None, lone[0]), (None, lone[0]), (None, lone[0] + " z"),
            (3, lone[1]), (3, lone[2]), (None, lone[2]), (4, ""), (4, ""), (4, None), (None, ""), (None, "")]
    got = [tuple(r) for r in without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    in_group = [r for r in got if r[1] in near]
    assert len(in_group) == 1 and in_group[0][0] == 1
    assert len([r for r in got if r[1] and r[1].startswith(lone[0])]) == 1
    rest = [r for r in got if r[1] not in near and not (r[1] or "").startswith(lone[0])]
    assert sorted(map(str, rest)) == sorted(map(str, [(3, lone[1]), (3, lone[2]), (4, ""), (4, None), (None, ""), (None, "")]))


def test_estimate_is_unbiased():
    import numpy as np
    from vigil.llm import neardup as n
    rng = np.random.default_rng(3)
    err = []
    for _ in range(60):
        pool = rng.integers(0, 1 << 63, 300).astype(np.uint64)
        a, b = n.packed(n.minima(pool[:240])).view(np.uint64), n.packed(n.minima(pool[60:])).view(np.uint64)
        per = n._LONGS // n.BITS
        differ = sum(int(np.bitwise_count((a[j] ^ b[j]) | (a[j + per] ^ b[j + per]))) for j in range(per))
        err.append((1 - differ / n.PERMUTATIONS - 0.25) / 0.75 - 0.6)
    assert abs(float(np.mean(err))) < 0.03


def test_components_of_long_paths(spark):
    from vigil.llm.components import connected_components
    order = list(range(80))
    random.Random(1).shuffle(order)
    edges = list(zip(order[:50], order[1:50])) + list(zip(order[50:], order[51:])) + [(3, 3), (None, 4)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: min(order[:50]) for x in order[:50]} | {x: min(order[50:]) for x in order[50:]}


# ------------------------------------------------------------------ 3
PAGE = ('<!DOCTYPE html><html><head><title>t &amp; t</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>'
        '<nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div><article><h1>A &lt;b&gt; %s</h1><p>One<br>two&nbsp; three</p>'
        '%s</article><section class="comments"><p>me too</p></section><footer>&copy; x</footer></body></html>')


def test_wrappers(spark):
    from vigil.llm.wrappers import extract
    pages = [(i, f"http://h.example/{i}", PAGE % (i, "".join(f"<p>p{i} {k}</p>" for k in range(i % 4)))) for i in range(12)]
    pages += [(50, None, "<p>no host"), (51, "http://h.example/x", None), (52, "http://h.example/y", ""), (52, "http://h.example/y", ""),
              (53, "nonsense", "<div>a<!-- never closed <p>b</p>"), (None, "http://z.example/", "<p>x</p>" * 2000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("wrapper", F.lit("clash"))
    got = {(r["page_id"], r["url"]): r for r in extract(df).collect()}
    assert extract(df).count() == len(pages)
    for i in range(12):
        r = got[(i, f"http://h.example/{i}")]
        assert r["text"] == "\n\n".join([f"A <b> {i}", "One two three", *[f"p{i} {k}" for k in range(i % 4)]])
        assert r["n_chars"] == len(r["text"])
    assert got[(51, "http://h.example/x")]["text"] == "" and got[(52, "http://h.example/y")]["n_chars"] == 0
    assert got[(50, None)]["text"] == "no host" and got[(53, "nonsense")]["text"] == "a"
    assert got[(None, "http://z.example/")]["text"].count("x") == 2000
    assert extract(df.limit(0)).count() == 0


def test_wrappers_template_text_needs_pages(spark):
    """A text is the template's only if several distinct pages have it at its slot."""
    from vigil.llm.wrappers import extract
    long = "A long paragraph %d that runs on and on, so that it is well over eighty characters in all, and then on."
    one = f"<body><h1>Only heading</h1><p>Short line.</p><p>{long % 0}</p></body>"
    body = "<body><div class='brand'>The Site</div><h1>Title %d</h1><p>" + long + "</p>%s</body>"
    extra = "<h2>Seen once</h2>"
    pages = [(1, "http://one.example/a", one), (2, "http://one.example/b", one), (3, "http://one.example/c", one.replace("<h1>", "<nav>x</nav><h1>"))]
    pages += [(10 + i, f"http://many.example/{i}", body % (i, i, extra if i == 5 else "")) for i in range(8)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in (1, 2, 3):
        assert got[i] == ["Only heading", "Short line.", long % 0]
    for i in range(8):
        assert got[10 + i] == [f"Title {i}", long % i, *(["Seen once"] if i == 5 else [])]


def test_wrappers_text_by_slot(spark):
    """Template text goes by its slot, inside an article too, and only there."""
    from vigil.llm.wrappers import extract
    outro = "Read on tomorrow"
    long = "Thank you for reading this page to its end; it is read by many, and many more are welcome to it."
    inner = f"<article><h1>Title %d</h1><p>Body %d</p>%s<div class='outro'>{outro}</div><div>{long}</div></article>"
    teaser = "<body><article>Our magazine</article><div><h2>Title %d</h2><p>Text %d</p></div></body>"
    pages = [(i, f"http://in.example/{i}", inner % (i, i, f"<p>{outro}</p>" if i == 4 else "")) for i in range(6)]
    pages += [(10 + i, f"http://out.example/{i}", teaser % (i, i)) for i in range(6)]
    got = {r["page_id"]: r["text"].split("\n\n") for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == [f"Title {i}", f"Body {i}", *([outro] if i == 4 else [])]
        assert got[10 + i] == [f"Title {i}", f"Text {i}"]


def test_wrapper_expression():
    from vigil.llm import wrappers as w
    a = w.wrapper_of("<div><p>a</p><p>b</p><ul><li>x</li></ul></div>")
    b = w.wrapper_of("<div><p>c</p><h2>t</h2></div>")
    assert w.as_regex(w.align(a, b)) == "<div>(<p>#</p>)+(<ul><li>'x'</li></ul><h2>'t'</h2>)?</div>"
    assert w.align(a, a) == a


def test_wrapper_alignment_memory():
    """Long irregular pages align as by the full table, without holding one."""
    import tracemalloc
    from vigil.llm import wrappers as w
    rnd = random.Random(4)
    pages = [[["t", f"{'/' if k % 2 else ''}t{rnd.randrange(40)}"] for k in range(1500)] for _ in range(2)]
    below = [0] * 1501
    for x in pages[0]:
        row = [0]
        for j, y in enumerate(pages[1]):
            row.append(below[j] + 1 if x == y else max(row[j], below[j + 1]))
        below = row
    tracemalloc.start()
    out = w.align(*pages)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(len(v) if k == "o" else 1 for k, v in out) == 3000 - below[-1]
    assert peak < 8e6  # the table has 2.25 million cells


# ------------------------------------------------------------------ 4
def test_url_filter(spark):
    from vigil.llm.urlfilter import judge
    link = '<html><head><link rel="canonical" href="%s"></head></html>'
    hop = '<meta http-equiv="refresh" content="0; url=%s">'
    pages = [
        (1, "http://A.Example.NET/en/x?q=1", ""), (2, "https://b.example.net/de/x", None), (3, "http://example.com/de/", ""), (4, "http://badexample.com/de/", ""),
        (5, "http://q.example.com/en/1", link % "http://x.net/1"), (6, "http://q.example.com/en/2", hop % "/en/1"),
        (7, "http://q.example.com/en/3", link % "/en/4"), (8, "http://q.example.com/en/4", link % "http://y.org/fr/1"), (9, "http://q.example.com/en/5", link % "http://x.net/9"),
        (10, "http://q.example.com/en/5", hop % "//y.org/fr/2"), (11, None, link % "http://x.net/"), (12, "no url", "x"), (13, "http://net", ""), (13, "http://net", ""),
        (None, "ftp://h.org/fr/?a", ""), (14, "http://q.example.com/en/6", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("node", F.lit("c")).withColumn("component", F.lit("c"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge(df).collect()}
    assert judge(df).count() == len(pages)
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3][2:] == ("example.com/de/", "block") and got[4][2:] == (None, "allow")
    assert got[5][3] == "block" and got[6][3] == "block"  # blocked through an alias and its alias
    assert got[7][3] == "allow" and got[8][3] == "allow"
    assert got[9][3] == "allow" and got[10][3] == "allow"  # an explicit allow takes precedence
    assert got[11] == ("", "", None, "allow") and got[12] == ("", "", None, "allow") and got[13] == ("net", "", None, "allow")
    assert got[None] == ("h.org", "/fr/", "org/fr/", "allow") and got[14][3] == "allow"
    assert judge(df.limit(0)).count() == 0


def test_url_filter_relative_links(spark):
    """A block reaches aliases by links with dot segments or a query only."""
    from vigil.llm.urlfilter import judge, node
    link = '<link rel="canonical" href="%s">'
    away = link % "http://x.net/1"
    links = {"a": ("../x", "/en/x"), "b": ("./x", "/en/d/x"), "c": ("u/../x", "/en/d/x"), "d": ("?p=2", "/en/d/q?p=2"), "e": ("/u/./../v/..", "/"),
             "f": ("../../../x", "/x"), "g": ("..", "/en/"), "h": ("//h.h.org/a/../x", "/x"), "i": ("http://i.h.org/./x/.", "/x/")}
    pages = [(h, f"http://{h}.h.org/en/d/q?p=1", link % to) for h, (to, _) in links.items()]
    pages += [(h + "2", f"http://{h}.h.org{at}", away) for h, (_, at) in links.items()]
    pages += [("own", "http://k.h.org/a/../b", ""), ("own2", "http://k.h.org/b", away), ("hash", "http://l.h.org/en/d/q", link % "#top"), ("hash2", "http://l.h.org/en/d/", away)]
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    got = {r["page_id"]: r["verdict"] for r in judge(df).collect()}
    assert [h for h in links if got[h] != "block"] == [] and got["own"] == "block" and got["hash"] == "allow"
    urls = ["http://H.org", "http://h.org?a=/../b", "http://h.org/a//../b/...#/../c", "http://h.org/..", None, "x"]
    nodes = spark.createDataFrame([(u,) for u in urls], "url string").select(node(F.col("url"))).collect()
    assert [r[0] for r in nodes] == ["h.org/", "h.org?a=/../b", "h.org/a/b/...", "h.org/", None, None]


# ------------------------------------------------------------------ 5
def test_quality(spark, odd, empty, odd_rows):
    from vigil.llm import quality as q
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    rows = []
    for i in range(400):
        text = " ".join(word() for _ in range(rnd.randint(20, 200)))
        rows.append((i, text if i % 4 else text.upper().replace(" ", "!! ")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), "x") for i in range(400)] + [(3, 1, "x"), (None, 0, "y"), (5, None, "z")], "doc_id long, quality int, score string")
    got = q.judge_quality(docs, labels).collect()
    held = [r for r in got if r["held_out"]]
    assert sorted(r["doc_id"] for r in held) == [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    model = q.train(docs, labels)
    assert q.score(odd, model).count() == len(odd_rows) and q.score(empty, model).count() == 0
    assert q.judge_quality(empty, labels.limit(0)).count() == 0
    kept = q.without_rejected(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == len(odd_rows)


def test_quality_draws_any_chunk():
    """One chunk of each stretch; over many texts each chunk is drawn about as often."""
    from vigil.llm import quality as q
    assert [q.drawn_chunks(n, 5) for n in (1, 3, q.TRAIN_CHUNKS)] == [list(range(n)) for n in (1, 3, q.TRAIN_CHUNKS)]
    n, count = 61, [0] * 61
    for seed in range(6000):
        drawn = q.drawn_chunks(n, seed)
        assert len(drawn) == q.TRAIN_CHUNKS and drawn == sorted(set(drawn))
        for k in drawn:
            count[k] += 1
    assert min(count) > 400 and max(count) < 800


def test_quality_sample_is_bounded_by_rows(spark, monkeypatch):
    """A labelled id on many rows is one text of the sample."""
    from vigil.llm import quality as q
    rows = [(i, f"plain sentence number {i} of a clean text") if i % 2 else (i, "$$ buy now " * 3 + str(i)) for i in range(1, 60)]
    rows += [(1, f"plain sentence, copy {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    seen = []
    fit = q.fit_last
    monkeypatch.setattr(q, "fit_last", lambda x, y, w: (seen.append(len(y)), fit(x, y, w))[1])
    q.train(docs, labels)
    assert seen == [sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(1, 60))]


def test_quality_scores_whole_texts():
    """Features of a text don't depend on its neighbours in the batch."""
    import numpy as np
    import pyarrow as pa
    from vigil.llm import quality as q, textops as x
    rng = np.random.default_rng(1)
    net = q.Network(rng.normal(size=(256, q.EMBED)).astype(np.float32), rng.normal(size=(q._BLOCK, q.FILTERS)).astype(np.float32),
                    rng.normal(size=(q._BLOCK, q.FILTERS)).astype(np.float32), rng.normal(size=q.FILTERS).astype(np.float32), np.zeros(2 * q.FILTERS), 0.0)
    net.embed[0] = 0
    texts = ["", "a", "b" * 124, "c" * 125, "d" * 300, "e f " * 4000, "x" * 128 + "y" * 700]
    together = net.features(*x.text_buffer(pa.array(texts)))
    alone = np.concatenate([net.features(*x.text_buffer(pa.array([t]))) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)
    tail = net.features(*x.text_buffer(pa.array(["x" * 5000, "x" * 5000 + "QZ!"])))
    assert not np.allclose(tail[0], tail[1])


# ------------------------------------------------------------------ 6
@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    from vigil.llm.packing import vocabulary
    return Tokenizer.from_file(vocabulary())


def test_packing(odd, odd_rows, empty, tokenizer):
    import numpy as np
    from vigil.llm.packing import pack_documents, vocabulary
    got = pack_documents(odd, vocabulary()).collect()
    want = []
    for i, t, _ in odd_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(str(i), p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert pack_documents(empty, vocabulary()).count() == 0


def test_encoder_is_the_tokenizer(tokenizer):
    import pyarrow as pa
    from vigil.llm import textops as x
    from vigil.llm.packing import encoder, vocabulary
    texts = ["", " a", "a ", "a  b", "a\n\nb\t c", "a\xa0 \xa0b", "x\xa0", "\xa0b c", "it's he'll '' 's don't", "<|endoftext|> hi", "日本 語。a 1234 ab12!!\nfoo",
             " ", "\n", None, "a\x1cb \x1cc", "a\x85 b", "plain words here.\nAnd there", "é è ç\nü"] * 2
    got = encoder(vocabulary()).encode(*x.text_buffer(pa.array(texts)))
    assert [g.tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_plans_hold_everything_and_beat_plain_best_fit():
    from vigil.llm.packing import best_fit, plan
    rnd = random.Random(4)
    for _ in range(150):
        capacity = rnd.choice([10, 20, 50, 1024])
        counts = {}
        for _ in range(rnd.randint(1, 50)):
            counts[rnd.randint(1, capacity)] = rnd.randint(1, 6)
        made, held = plan(counts, capacity), {}
        for pattern, n in made.items():
            assert sum(pattern) <= capacity
            for s in pattern:
                held[s] = held.get(s, 0) + n
        assert held == counts
        assert sum(made.values()) <= sum(best_fit(counts, capacity).values())


def test_reduction_is_optimal_on_small_instances():
    """What is fixed loses nothing: the optimum of the rest plus the fixed sets
    is the optimum of the whole."""
    from functools import lru_cache
    from vigil.llm.packing import reduce_dominated

    def optimum(items, capacity):
        items = tuple(sorted(items, reverse=True))

        @lru_cache(maxsize=None)
        def go(left):
            if not left:
                return 0
            best = len(left)

            def fill(room, chosen, rest, start):
                nonlocal best
                best = min(best, 1 + go(rest))
                for k in range(start, len(rest)):
                    if rest[k] <= room and (k == start or rest[k] != rest[k - 1]):
                        fill(room - rest[k], chosen + (rest[k],), rest[:k] + rest[k + 1:], k)

            fill(capacity - left[0], (left[0],), left[1:], 0)
            return best
        return go(items)

    rnd = random.Random(8)
    for _ in range(120):
        items = [rnd.randint(1, 12) for _ in range(rnd.randint(1, 8))]
        counts = {s: items.count(s) for s in set(items)}
        fixed, rest = reduce_dominated(counts, 12)
        left = [s for s, n in rest.items() for _ in range(n)]
        assert sum(fixed.values()) + optimum(left, 12) == optimum(items, 12)


# ------------------------------------------------------------------ 7
@pytest.mark.parametrize("width", [35, 40])
def test_repeated_passages(odd, odd_rows, width):
    from vigil.llm.passages import without_repeats
    words, kept = brute.kept_words([(i, t) for i, t, _ in odd_rows], width)
    want = sorted((str(i), len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _, _), w, k in zip(odd_rows, words, kept))
    got = without_repeats(odd, width, carry=["doc_id", "part", "key"], with_text=True).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert all(r["part"] == 3 and r["key"] == "k" for r in got)
    assert all(r["kept_text"] == " ".join(r["kept_text"].split()) or r["n_removed"] == 0 for r in got if r["kept_text"] is not None)


def test_repeated_passages_random_small_alphabet(spark, empty):
    from vigil.llm.passages import without_repeats
    rnd = random.Random(6)
    rows = []
    for i in range(120):
        w = [rnd.choice("ab") if i % 3 == 0 else f"t{rnd.randrange(30)}" for _ in range(rnd.randrange(0, 200))]
        if i % 4 == 0 and rows:
            other = rows[rnd.randrange(len(rows))][1].split()
            cut = rnd.randrange(len(other) + 1)
            w[10:10] = other[cut: cut + rnd.randrange(30, 45)]
        rows.append((i, " ".join(w)))
    words, kept = brute.kept_words(rows)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (len(w), len(w) - len(k), hashlib.sha256(" ".join(k).encode()).hexdigest()) for (i, _), w, k in zip(rows, words, kept)}
    assert without_repeats(empty).count() == 0


def test_repeated_passages_entries_per_part(spark):
    """What a bucket gets of an anchor grows with the parts, not with its copies."""
    from vigil.llm import passages as p
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(3000).select(F.pmod("id", F.lit(4)).cast("int").alias("part"), F.lit(text).alias("text")).repartition(6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    got = p.anchors_by_bucket(rows, p.WIDTH, 8).collect()
    entries = sum(len(r["hashes"]) // 8 for r in got)
    distinct = len({bytes(r["hashes"][k: k + 8]) for r in got for k in range(0, len(r["hashes"]), 8)})
    assert entries == 2 * 4 * distinct > 0
    assert len({(r["bucket"], r["part"]) for r in got}) == len(got)


def test_repeated_passages_white_space():
    from vigil.llm.passages import _framed
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("ab\u00e9 \t\n\v\f\r\u00a0\x1f") for _ in range(rnd.randrange(40))).encode() for _ in range(300)] + [b"", b" " * 9]
    at = np.cumsum([0, *map(len, texts)])
    assert _framed(b"".join(texts), at) == b"\0".join(b" " + " ".join(brute.SPACED.findall(t.decode())).encode() + b" " for t in texts)


def test_repeated_passages_confirmed_by_words():
    """Phrases are confirmed by words: with every anchor taken for recurring, as
    if all their hashes collided, only those that stand twice are stored, and
    the automata built of them find the same words."""
    from vigil.llm import passages as p
    from vigil.llm import textops as X
    rnd = random.Random(9)
    shared = " ".join(f"s{i}" for i in range(50))
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(90)) for _ in range(12)]
    texts = [f"{t} {shared}" if i % 4 == 0 else t for i, t in enumerate(texts)] + ["", " ", "one two"]
    parts = [pa.table({"text": pa.array(texts[k::3])}) for k in range(3)]
    every = [np.concatenate([X.run_hashes(words, p.ANCHOR) for *_, words in p._pieces(t["text"])]) for t in parts]
    found = pa.concat_tables([p._emit_found(p.WIDTH, 1)([pa.scalar(k)], t, pa.table({"hashes": [h.tobytes()]})) for k, (t, h) in enumerate(zip(parts, every))])
    confirmed = p._confirmed(found)
    phrases = {x.decode() for line in confirmed["phrases"].to_pylist() if line for x in line.split(b"\n")}
    assert phrases == {" ".join(f"s{i + j}" for j in range(p.ANCHOR)) for i in range(50 - p.ANCHOR + 1)}
    _, kept = brute.kept_words(list(enumerate(texts)))
    want = {hashlib.sha256(" ".join(k).encode()).hexdigest() for k in kept}
    got = [p._remove(p.WIDTH, [], False, ["n_words", "n_removed", "kept_sha256"])(None, t, confirmed.filter(pc.equal(confirmed["part"], k))) for k, t in enumerate(parts)]
    assert {h for t in got for h in t["kept_sha256"].to_pylist()} == want
    assert sum(sum(t["n_removed"].to_pylist()) for t in got) == 3 * 50


# ------------------------------------------------------------------ 8
def test_fingerprints(spark, odd, odd_rows, empty):
    from vigil.llm import fingerprints as f
    rows = sorted(((i, t or "") for i, t, _ in odd_rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        e = f.edited(t, u)
        a, b, c = f.sketches([t, e, u])
        want.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), f.to_text(a), f.to_text(b), f.resemblance(a, b), f.resemblance(a, c)))
    got = f.with_neighbours(odd).collect()
    assert sorted(tuple(map(str, r)) for r in got) == sorted(tuple(map(str, r)) for r in want)
    assert f.with_neighbours(empty).count() == 0
    one = f.with_neighbours(odd.where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


def test_ranges_of_ids(spark):
    """Every row in the range of its id, each range's first id also ahead in the range before
    it; the plan has the same size for any number of ranges."""
    from vigil.llm import fingerprints as f
    ids = [None, None, *range(3, 3000, 3), 9, 9]
    sizes = []
    for kind, held in (("long", ids), ("string", [None if i is None else f"{i:05d}" for i in ids])):
        df = spark.createDataFrame([(i, "t") for i in held], f"doc_id {kind}, text string")
        for parts in (1, 7, 60):
            ranges = f.in_ranges(df, parts)
            sizes.append(len(ranges._jdf.queryExecution().optimizedPlan().toString()))
            here, ahead = {}, {}
            for r in ranges.collect():
                (ahead if r["ahead"] else here).setdefault(r["part"], []).append(r["doc_id"])
            assert sorted(here) == sorted(ahead) == list(range(len(here))) and len(here) >= parts // 2
            assert [i for p in sorted(here) for i in here[p]] == sorted(held, key=lambda i: (i is not None, i or 0))
            for p in here:
                following = here[(p + 1) % len(here)]
                assert ahead[p] == [i for i in following if i == following[0]]
    assert max(sizes) - min(sizes) < 200


def test_sketches_merge_and_estimate():
    from vigil.llm import fingerprints as f
    import numpy as np
    rng = np.random.default_rng(5)
    pool = rng.permutation(np.unique(rng.integers(0, 1 << 63, 6000).astype(np.uint64) << np.uint64(1)))
    a, b = pool[:4000], pool[2000:]
    a, b = np.sort(a), np.sort(b)
    sa, sb = f.sketch(a), f.sketch(b)
    assert np.array_equal(f.merge(sa, sb), f.sketch(np.union1d(a, b)))
    assert abs(f.resemblance(sa, sb) - len(np.intersect1d(a, b)) / len(np.union1d(a, b))) < 0.15
    assert abs(f.distinct(sa) / len(a) - 1) < 0.35
    assert np.array_equal(f.from_text(f.to_text(sa)), sa)
    assert f.resemblance(f.sketch(a[:50]), f.sketch(a[:50])) == 1.0 and f.containment(f.sketch(a[:20]), f.sketch(a[:40])) == 1.0


# ------------------------------------------------------------------ 9
def test_minimax_shards(spark, odd, odd_rows, empty):
    from vigil.llm.sharding import minimax_shards
    for df, rows, n in ((odd, [(i, t) for i, t, _ in odd_rows], 5), (None, None, 40)):
        if df is None:
            rnd = random.Random(9)
            rows = [(i, "x" * rnd.choice([1, 5, 30, 400, 3000]) + str(rnd.randrange(60))) for i in range(700)]
            df = spark.createDataFrame(rows, "doc_id long, text string")
        got = minimax_shards(df, n).collect()
        assert len(got) == len(rows)
        groups = {}
        for i, t in rows:
            g = groups.setdefault(t or "", [None, 0, False])
            g[0] = i if g[0] is None or (i is not None and i < g[0]) else g[0]
            g[1] += len((t or "").encode()) + 16
        sizes = [g[1] for _, g in sorted(groups.items(), key=lambda x: (x[1][0] is not None, x[1][0] or 0))]
        load, slots, where = {}, {}, {}
        for r in got:
            load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
            slots.setdefault(r["shard"], []).append(r["slot"])
            where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
        assert max(load.values()) == brute.minimax(sizes, n)
        assert set(load) <= set(range(n)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert all(len(s) == 1 for s in where.values())
        assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    assert minimax_shards(empty, 5).count() == 0


# ------------------------------------------------------------------ 10
def test_language_id(spark, odd, odd_rows, empty):
    from vigil.llm.langid import language_id
    words = {"en": "the and of with this that from have".split(), "de": "der und nicht mit auch eine werden über".split(), "fr": "les des pour avec dans une être où".split()}
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(words[la]) for _ in range(rnd.randint(5, 60))), la) for i in range(300) for la in [list(words)[i % 3]]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None)]
    got = {r["doc_id"]: r for r in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i]["lang_pred"] == la for i, _, la in rows[:300] if zlib.crc32(str(i).encode()) % 3 == 1)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and got[900]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id(odd).count() == len(odd_rows) and language_id(empty).count() == 0
    nothing = language_id(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


# ------------------------------------------------------------------ shared kernels
def test_hashes_do_not_depend_on_segments(monkeypatch):
    """A word's and a run's hash is the same however a text is cut, and the
    tables of powers stay as long as a segment."""
    from vigil.llm import textops as X
    rnd = random.Random(4)
    data = np.frombuffer("".join(rnd.choice("ab cé\n") for _ in range(20000)).encode(), np.uint8)
    start, end, _ = X.word_spans(data, np.array([0, len(data)]))
    words = X.word_hashes(data, start, end)
    runs = {(w, second): X.run_hashes(words, w, second) for w in (5, 35) for second in (False, True)}
    monkeypatch.setattr(X, "CHUNK", 64)
    monkeypatch.setattr(X, "RUN_WORDS", 50)
    monkeypatch.setattr(X, "_BYTES", X._Powers(X._BYTES.base))
    assert (X.word_hashes(data, start, end) == words).all()
    assert len(X._BYTES.up) <= 2 * 65
    for (w, second), want in runs.items():
        assert (X.run_hashes(words, w, second) == want).all()
    assert len(X.run_hashes(words[:4], 5)) == 0 == len(X.word_hashes(data, start[:0], end[:0]))
