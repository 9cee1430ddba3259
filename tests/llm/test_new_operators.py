"""Vector packing, spelling variants and the prefix trie against plain restatements."""

import random
import zlib
from collections import defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import prefixtrie, spelling, vectorpack
from vigil.llm.packing import vocabulary

VOCAB = vocabulary("word_bpe_49k.json")


@pytest.fixture(scope="module")
def enc():
    return vectorpack.WordEncoder(VOCAB)


# -- operator 11 ---------------------------------------------------------------------

PIECES = ["a", "T", "̈", "é", "É", "É,", "ç.", "it's,", "x.́", "…,", "×,", "÷.", "İ", "Σς", "1,", "12.", "a1,", "<|endoftext|>",
          "<|ENDOFTEXT|>", "|", " ", "\t", "\n", " ", " ", "ß", "日本", "!", "?!", ",,", "'S", "'s.", "ŉ", "\x00", "\x1c", "ﬁ,", "ÿ;",
          "Àé:", "don't!", "😀,", "à,b", "ª,", "µ."]


def test_words_have_the_tokenizers_ids(enc):
    rng = random.Random(5)
    odd = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(1500)] + [None, "", " \n"]
    for a in range(0, len(odd), 3):
        some = odd[a: a + 3]
        for text, ids in zip(some, enc.encode(pa.array(some, pa.string()))):
            assert ids.tolist() == enc.full.encode(text or "", add_special_tokens=False).ids, text


def test_a_long_text_is_encoded_in_parts(enc, monkeypatch):
    text = " ".join(f"Word{i % 613}, é{i % 97}." for i in range(4000)) + "x" * 9000
    want = enc.full.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(vectorpack, "PART", 1 << 10)
    assert next(enc.encode(pa.array([text]))).tolist() == want


def check_packing(rows, limits, ids_of, cut=True):
    """Each id in one piece; limits kept; sequences gapless."""
    by_key, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_key[r[0]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for key, ids in ids_of.items():
        at = 0
        for r in sorted(by_key[key], key=lambda r: r["start"]):
            part = ids[r["start"]: r["start"] + r["length"]]
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= limits.tokens
        assert sum(r["segments"] for r in pieces) <= limits.segments and sum(r["loss_tokens"] for r in pieces) <= limits.loss
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    if cut:
        assert padding == 0
    return by_sequence


@pytest.mark.parametrize("limits", [vectorpack.Limits(), vectorpack.Limits(64, 3, 64), vectorpack.Limits(64, 64, 17), vectorpack.Limits(1, 1, 1)])
def test_documents_are_packed_whole(spark, enc, limits):
    rng = random.Random(3)
    rows = [(i, " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 1, 2, 5, 30, 400])))) for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ids = {i: enc.full.encode(t or "", add_special_tokens=False).ids + [1] for i, t in rows}
    check_packing(vectorpack.pack_documents(docs, VOCAB, limits).collect(), limits, ids)


def test_odd_and_empty_tables_are_packed(odd, empty, odd_rows, enc):
    rows = vectorpack.pack_documents(odd, VOCAB).collect()
    want = sum(len(enc.full.encode(t or "", add_special_tokens=False).ids) + 1 for _, t, _ in odd_rows)
    assert sum(r["length"] for r in rows) == want
    assert {r["doc_id"] for r in rows} == {i for i, _, _ in odd_rows}
    assert vectorpack.pack_documents(empty, VOCAB).collect() == []


def test_the_dot_product_decides():
    """Products by hand: 1.11 (many turns), 0.74 (loss), 0.40 (one turn), though the last is the longest."""
    def example(name, turns, lossy):
        ends = np.cumsum(turns).tolist()
        return vectorpack.Example(name, np.zeros(ends[-1], np.uint32), ends, lossy)
    packer = vectorpack.Packer(vectorpack.Limits(100, 4, 50), pool=10, cut=False)
    for e in (example("many turns", [10] * 4, [True] * 4), example("one turn", [60], [False]), example("loss", [40], [True])):
        assert list(packer.add(e)) == []
    first, second = list(packer.finish())
    assert [e.key for e in first] == ["many turns"] and [e.key for e in second] == ["loss", "one turn"]


def test_conversations_keep_three_limits(spark, enc):
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant", None]), " ".join(["hello there"] * rng.randint(0, 30)) if rng.random() > .05 else None)
            for c in range(40) for t in range(rng.randint(1, 9))] + [(None, 0, "user", "alone"), (99, None, "assistant", "first"), (99, 0, "user", "second")]
    rows += [(77, t, "assistant", "long " * 60) for t in range(20)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    limits = vectorpack.Limits(256, 12, 128)
    ids = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        ids[c] += enc.full.encode(x or "", add_special_tokens=False).ids + [1]
    made = vectorpack.pack_conversations(turns, VOCAB, limits).collect()
    check_packing(made, limits, ids, cut=False)
    pieces = defaultdict(int)
    for r in made:
        pieces[r["conv_id"]] += 1
    assert all(n == 1 for c, n in pieces.items() if c != 77 and len(ids[c]) <= 100)


# -- operator 12 ---------------------------------------------------------------------

def words_of(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)


def near_by_brute(words):
    def one_edit(a, b):
        if a == b or abs(len(a) - len(b)) > 1:
            return False
        i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1:] == b[i + 1:] if len(a) == len(b) else (a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:])
    out = {}
    for w in words:
        near = [v for v in words if one_edit(w, v)]
        best = min(near, key=lambda v: (-words[v], v), default=None)
        out[w] = (words[w], len(near), best, words.get(best))
    return out


@pytest.mark.parametrize("shard_rows", [100_000, 40])
def test_near_words_equal_brute_force(spark, shard_rows):
    """Runs of equal letters, shared halves, lengths around the least; small shards
    split the halves that many words share."""
    rng = random.Random(2)
    words = {"".join(rng.choice("abé×") for _ in range(rng.randint(6, 9))): rng.randint(5, 500) for _ in range(500)}
    words |= {"ccccccc" + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))): rng.randint(5, 9) for _ in range(200)}
    got = {r["word"]: (r["n"], r["n_near"], r["near"], r["near_n"]) for r in spelling.near_words(words_of(spark, words), shard_rows=shard_rows).collect()}
    assert got == near_by_brute(words)


def test_bidirectional_intervals_agree():
    """An interval grown to the left and to the right counts the same occurrences."""
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(6, 8))) for _ in range(60)})
    bi = spelling.BiIndex(words, "abc")
    text = "|" + "|".join(words) + "|"
    for pattern in ("a", "ab", "bca", "cc", "abcab"):
        for _ in range(4):
            cut = rng.randint(0, len(pattern))
            state = np.array([[0], [0], [bi.n]])
            for c in reversed(pattern[:cut]):
                state = bi._grow(np.array([bi.symbol[c]]), state, True)
            for c in pattern[cut:]:
                state = bi._grow(np.array([bi.symbol[c]]), state, False)
            assert state[2, 0] == sum(text.startswith(pattern, i) for i in range(len(text)))


def test_spelling_forms_equal_brute_force(spark):
    rng = random.Random(6)
    base = ["Wonder", "wander", "wonders", "wonderful", "straße", "Straßen", "élevée", "ÉLEVÉE", "aaaaaa", "aaaaaaa", "aaaaaab", "naïveté", "xx", "tail"]
    weight = [400, 60, 60, 10, 200, 30, 90, 8, 300, 50, 9, 5, 900, 50]
    rows = [(i if i % 17 else None, " ".join(rng.choices(base, weight, k=rng.randint(0, 60))) + rng.choice(["", "-", "1x", "\n"])) for i in range(300)]
    rows += [(9001, None), (9002, ""), (5, rows[5][1]), (5, rows[5][1])]
    docs = spark.createDataFrame([(i, t, "w", 3, "r") for i, t in rows], "doc_id long, text string, word string, n int, root string").repartition(4)
    got = sorted(map(tuple, spelling.spelling_forms(docs, damaged=7).collect()))
    want = brute.spelling(rows, damaged=7)
    assert got == want and any(r[1] for r in want) and any(r[2] != r[1] for r in want if r[1])
    assert sorted(map(tuple, spelling.spelling_forms(docs, damaged=None).collect())) == brute.spelling(rows, damaged=None)


def test_odd_empty_and_very_long_words(spark, odd, empty, odd_rows):
    got = sorted(map(tuple, spelling.spelling_forms(odd).collect()))
    assert got == brute.spelling([(i, t) for i, t, _ in odd_rows])
    assert spelling.spelling_forms(empty).collect() == []
    long = "ab" * 5000
    rows = [(i, f"{long} {long}c short") for i in range(6)]
    made = spelling.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string"), damaged=None).collect()
    assert sorted((len(r["word"]), r["n_near"], r["form"]) for r in made) == [(10000, 1, None), (10001, 1, None)]


def test_runs_are_cut_between_words(monkeypatch):
    text = "abc déf" * 50 + "-" * 20 + "g" * 300
    assert [w for some in spelling._runs(text, 16) for w in some] == spelling.RUN.findall(text)


# -- operator 13 ---------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, depth int, key string, words string, block int"


def trie_of(spark, rows, parts=3, **kw):
    frame = spark.createDataFrame([(*r, 1, "k", "w", 2) for r in rows], TURNS).repartition(parts)
    return sorted(map(tuple, prefixtrie.prefix_trie(frame, **kw).collect()), key=lambda r: r[:2])


def some_turns(seed, convs=60, alphabet=3, longest=14):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), " ".join(["hi"] * rng.randint(0, alphabet - 1)))
            for c in range(convs) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed,size", [(1, 4), (2, 1), (3, 3)])
def test_trie_equals_brute_force(spark, seed, size):
    rows = some_turns(seed)
    assert trie_of(spark, rows, size=size) == brute.trie(rows)


def test_trie_of_copies_long_and_odd_conversations(spark):
    rows = some_turns(9, 30)
    rows += [(c, t, "user", f"same {t % 2}") for c in range(100, 160) for t in range(6)]  # copies
    rows += [(200, t, "user", f"turn {t}") for t in range(600)] + [(201, t, "user", f"turn {t}") for t in range(590)]  # long
    rows += [(300, None, None, None), (300, 0, None, ""), (300, 0, "", None), (300, 0, "user", "a b\tc"), (300, 0, "user", "a b\tc")]  # nulls, ties, repeats
    rows += [(None, 1, "user", "lost"), (-7, 0, "user", "negative"), (-20, 0, "user", "base"), (-20, 1, "user", "more"), (2 ** 40 + 1, 5, "u", "far")]
    assert trie_of(spark, rows, 5) == brute.trie(rows)


def test_long_chains_are_summed_by_stretches(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "STRETCH", 2)
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 3)
    rows = some_turns(12, 50, 2, 40) + [(c, 0, "user", "x") for c in range(400, 430)]
    assert trie_of(spark, rows) == brute.trie(rows)


def test_empty_table_has_no_trie(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 0, "user", "x")]) == []


# -- operator 3 ----------------------------------------------------------------------

def text_of(page, others=()):
    from vigil.llm import wrappers as W
    return W.main_text(page, W.slots(W.fold([W.wrapper_of(p) for p in (page, *others)])))


@pytest.mark.parametrize("page,want", [
    ('<body><nav>menu</nav><article class="legal"><h1>Law</h1><p>Text.</p></article></body>', "Law\n\nText."),
    ('<body><main class="search"><p>Found.</p></main><footer>end</footer></body>', "Found."),
    ('<article><div class="post-header"><h1>Title</h1></div><p>Body.</p><div class="ad">Buy!</div></article>', "Title\n\nBody."),
    ('<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>', "Let x=2 hold."),
    ('<main><p>Story.</p><article class="comment"><p>First!</p></article></main>', "Story."),
    ("<article><p>one<br>two &amp; three</p></article>", "one two & three"),
    ("", ""),
])
def test_main_elements_keep_their_text(page, want):
    assert text_of(page) == want


def test_the_text_comes_from_the_wrappers_slots():
    """Without slots there is no text; what a slot is decides for the texts in it."""
    from vigil.llm import wrappers as W
    pages = [f"<body><div class=nav>Home</div><article><h1>T{i}</h1><p>About {i}.</p><h4>Imprint</h4></article></body>" for i in range(4)]
    wrapper = W.fold([W.wrapper_of(p) for p in pages])
    assert [W.main_text(p, W.slots(wrapper)) for p in pages] == [f"T{i}\n\nAbout {i}." for i in range(4)]  # "Imprint" is constant
    assert [W.main_text(p, []) for p in pages] == [""] * 4
    turned = W.slots([["t", "aside"] if x == ["t", "article"] else ["t", "/aside"] if x == ["t", "/article"] else x for x in wrapper])
    assert "About 1." not in W.main_text(pages[1], turned)


def test_repeated_groups_of_any_length():
    from vigil.llm import wrappers as W
    one = "".join(f"<{t}>a</{t}>" for t in ("h1", "pre", "h2", "section", "h3", "div", "h4", "dl", "h5", "main"))
    w = W.wrapper_of("<body>" + one * 3 + "</body>")
    assert len(w) == 3 and w[1][0] == "r" and len(w[1][1]) > 24
    rng = random.Random(1)
    for n in (40, 900):
        items = [["t", rng.choice("ab")] for _ in range(n)]
        flat = "".join(x[1] for x in items)
        folded = W.fold_repeats(items)

        def spread(xs):
            return "".join(x[1] if x[0] == "t" else f"({spread(x[1])})" for x in xs)
        assert len(folded) <= len(flat) and set(spread(folded)) <= set("ab()")
        import numpy
        ids = numpy.array([ord(c) for c in flat])
        for size in range(1, 30):
            assert W._repeats(ids, flat, size) == any(flat[i: i + size] == flat[i + size: i + 2 * size] for i in range(n - 2 * size + 1))
