"""Operator 3: main-text extraction by inferred page wrappers.

Pages of a host are instances of a template.  Its wrapper is a union-free
regular expression over tags and text: a sequence of tags, text slots, optional
groups and repeated groups.  It is inferred by aligning token streams: what two
streams share stays, a tag that only one has starts an optional group, a
sequence that repeats itself becomes a repeated group, texts that differ become
a variable slot.  Aligning two wrappers gives a wrapper again, so a host's pages
are folded batch by batch, then in three salted rounds; no group holds all pages
of a host.

A page's text comes from the wrapper's slots.  Each slot of a host's wrapper is
judged once (:func:`slots`): by the elements around it in the wrapper, under
navigation, header, footer, sidebar, notice, advert, form or comments it is left
out, in an article (or main, or content) element it is main text.  The page's
items are aligned with the wrapper, and a text is what its slot is; one that falls
in no slot is what the slot before it is.  A slot is constant if SEVERAL distinct
pages have the same text there and no page another: its text is the template's and
left out, also inside an article.  If some main text remains, only that is taken.
Class words don't make an article or main element a left-out one, but for those of
comments and adverts.

Edge cases: null or empty html gives the empty text; null urls and those
without a host share the host ''; broken markup is read as far as it goes (an
open ``p`` ends at the next block, an unclosed comment at the end of the page);
repeated pages each get a row; very long pages are aligned in rows of bits, not in
a full table, and repeated groups may have any length; an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import maybe_broadcast, small_batches, stored
from vigil.llm.urlfilter import host

#: Salts of the folding rounds.
ROUNDS = (4096, 64, 1)
#: A text is the template's if so many distinct pages have it at its slot and no page another.
SEVERAL = 3

_TOKEN = re.compile(r"""<!--(?P<comment>.*?)(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
    |<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*+)(?:>|\Z)""", re.S | re.X)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")

# Elements by their part in a page.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "object", "textarea", "select", "title", "head"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
         "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav",
         "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
ENDED_BY_BLOCK = {"p"}
ENDED_BY_SAME = {"li", "dt", "dd", "tr", "td", "th"}
LEFT_OUT = {"nav", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "header", "address"}
LEFT_OUT_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
                  "consent", "cookie", "cookies", "copyright", "disqus", "footer", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav",
                  "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "promoted", "promotion", "related", "replies", "search",
                  "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar", "widget", "widgets"}
MAIN = {"article", "main"}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story"}
# Class words that make even an article or main element something else.
NOT_MAIN_WORDS = {"ad", "ads", "advert", "advertisement", "adverts", "advertising", "comment", "comments", "promo", "promoted", "promotion", "related",
                  "replies", "sponsor", "sponsored"}


def meaning(tag: str, words: set[str], out: bool, main: bool) -> tuple[bool, bool]:
    """(left out, main text) of what stands in an element, by its tag and class
    words and what the element around it means."""
    if tag in MAIN:
        marked = bool(words & NOT_MAIN_WORDS)
    else:
        marked = bool((words - {"header"} if main else words) & LEFT_OUT_WORDS) and tag not in ("body", "html")
    out = out or marked or (tag in LEFT_OUT and not (tag == "header" and main))
    return out, main or ((tag in MAIN or (tag in ("div", "section", "td") and bool(words & MAIN_WORDS))) and not out)


class Element:
    """An open block element: its label and what it means for the text in it."""

    __slots__ = ("tag", "label", "out", "main")

    def __init__(self, tag: str, attrs: str, above: "Element | None"):
        self.tag, self.label = tag, tag
        words: set[str] = set()
        if attrs and ("=" in attrs):
            found = sorted((k.lower(), a or b or c) for k, a, b, c in _ATTR.findall(attrs))
            named = " ".join(v.lower() for _, v in found)
            words = set(_WORD.findall(named))
            if named:
                self.label = f"{tag}.{'.'.join(sorted(words))}"
        self.out, self.main = meaning(tag, words, above is not None and above.out, above is not None and above.main)


def stream(page: str) -> Iterator[tuple[str, object]]:
    """A page as ("open", element), ("close", element), ("text", text) and
    ("space", None) for a line break inside a block."""
    stack: list[Element] = []
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            yield "text", page[at:]
            break
        if m.start() > at:
            yield "text", page[at: m.start()]
        at = m.end()
        if m["cdata"] is not None:
            yield "text", m["cdata"]
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag = tag.lower()
        closing = bool(m["end"] or m["end2"])
        if tag in RAW:
            if not closing and not (m["attrs"] or m["attrs2"] or "").endswith("/"):
                stop = re.compile(rf"</{tag}\s*>|<body\b", re.I).search(page, at) if tag == "head" else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = (stop.start() if stop.group().lower().startswith("<body") else stop.end()) if stop else n
            continue
        if tag == "br":
            yield "space", None
            continue
        if tag not in BLOCK and tag not in LEFT_OUT:
            continue  # inline markup
        if closing:
            if any(e.tag == tag for e in stack):
                while True:
                    e = stack.pop()
                    yield "close", e
                    if e.tag == tag:
                        break
            else:
                yield "space", None
            continue
        if stack and (stack[-1].tag in ENDED_BY_BLOCK or (tag in ENDED_BY_SAME and stack[-1].tag == tag)):
            yield "close", stack.pop()
        e = Element(tag, m["attrs"] or m["attrs2"] or "", stack[-1] if stack else None)
        yield "open", e
        if tag in VOID:
            yield "close", e
        else:
            stack.append(e)
    while stack:
        yield "close", stack.pop()


def clean(text: str) -> str:
    return _SPACE.sub(" ", entities.unescape(text)).strip()


def key(text: str) -> str:
    """A text as wrappers hold it: long ones as their digest."""
    return text if len(text) <= 80 else "\0" + hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).hexdigest()


# A wrapper is a list of items: ["t", tag], ["x", text or None, pages that agreed, places in the page], ["o", items],
# ["r", items].  Only a page to be matched has places: the numbers of its texts.


def _shape(item) -> object:
    """What two items must share to be aligned; texts always do."""
    return item[1] if item[0] == "t" else "#" if item[0] == "x" else (item[0], tuple(map(_shape, item[1])))


_AGAIN: dict[int, re.Pattern] = {}


def _repeats(ids: np.ndarray, text: str, size: int) -> bool:
    """Whether some ``size`` symbols stand twice in a row."""
    if len(ids) <= 512:
        if size not in _AGAIN:
            _AGAIN[size] = re.compile(rf"(.{{{size}}})\1", re.S)
        return _AGAIN[size].search(text) is not None
    gaps = np.flatnonzero(ids[:-size] != ids[size:])
    return int(np.diff(gaps, prepend=-1, append=len(ids) - size).max()) > size


def fold_repeats(items: list) -> list:
    """Adjacent equal sequences of any length become one repeated group, shortest first."""
    number: dict = {}

    def numbered(shapes: list) -> tuple[np.ndarray, str]:
        ids = [number.setdefault(x, len(number)) for x in shapes]
        return np.array(ids), "".join([chr(i + (i >= 0xD800) * 0x800) for i in ids]) if len(ids) <= 512 else ""

    shapes, size = [_shape(x) for x in items], 1
    ids, text = numbered(shapes)
    while 2 * size <= len(items):
        if not _repeats(ids, text, size):
            size += 1
            continue
        out, kept, i = [], [], 0
        while i < len(items):
            n = 1
            while shapes[i: i + size] == shapes[i + n * size: i + (n + 1) * size] and i + (n + 1) * size <= len(items):
                n += 1
            if n > 1 and not (size == 1 and items[i][0] in "xr"):
                body = items[i: i + size]
                for k in range(1, n):
                    body = _merge_equal(body, items[i + k * size: i + (k + 1) * size])
                out.append(["r", body])
                kept.append(_shape(out[-1]))
                i += n * size
            else:
                out.append(items[i])
                kept.append(shapes[i])
                i += 1
        items, shapes = out, kept
        ids, text = numbered(shapes)
        size += 1
    return items


def _merge_equal(a: list, b: list) -> list:
    """Two sequences of the same shape; texts that differ become variable."""
    out = []
    for x, y in zip(a, b):
        if x[0] == "x":
            same = x[1] is not None and x[1] == y[1]
            out.append(["x", x[1] if same else None, sorted({*x[2], *y[2]})[:SEVERAL] if same else [], x[3] + y[3]])
        elif x[0] == "t":
            out.append(x)
        else:
            out.append([x[0], _merge_equal(x[1], y[1])])
    return out


def _with_groups(items: list, groups: list) -> list:
    """Plain occurrences of known repeated groups rewritten as such groups."""
    for body in groups:
        want = [_shape(x) for x in body]
        shapes, out, i = [_shape(x) for x in items], [], 0
        while i < len(items):
            if shapes[i: i + len(want)] == want:
                group = items[i: i + len(want)]
                i += len(want)
                while shapes[i: i + len(want)] == want:
                    group = _merge_equal(group, items[i: i + len(want)])
                    i += len(want)
                out.append(["r", group])
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def _plain(items: list) -> list:
    """Optional groups as their items, for alignment; each item with its group."""
    return [(x, False) if x[0] != "o" else (y, True) for x in items for y in (x[1] if x[0] == "o" else [x])]


def _placed(flat: list) -> list:
    """The shapes of items; a text's shape has the element around it."""
    out, around = [], [""]
    for item, _ in flat:
        if item[0] == "t" and not item[1].startswith("/"):
            around.append(item[1])
        out.append(("#", around[-1]) if item[0] == "x" else _shape(item))
        if item[0] == "t" and item[1].startswith("/") and len(around) > 1:
            around.pop()
    return out


def _common(sp: list, sq: list) -> Iterator[tuple[int, int]]:
    """A longest common subsequence of two sequences of shapes, as steps (place
    in the one or -1, place in the other or -1).

    A row of its table is an integer: bit k is zero if sq[n - 1 - k:] has one
    more in common with the rest of ``sp`` than the sequence after it.  One row
    in ``step`` is kept and those between are made again when the steps come
    there, so that 2 * sqrt(len(sp)) rows of len(sq) bits are held at most."""
    m, n = len(sp), len(sq)
    holds: dict = {}
    for j, s in enumerate(sq):
        holds.setdefault(s, []).append(n - 1 - j)
    often = {s: _bits(at, n) for s, at in holds.items() if len(at) * 256 >= n}
    full, step = (1 << n) - 1, max(64, math.isqrt(m) + 1)

    def above(row: int, s) -> int:
        both = row & (often[s] if s in often else _bits(holds.get(s, ()), n))
        return ((row + both) | (row - both)) & full

    kept, row = {m: full}, full
    for i in range(m - 1, step - 1, -1):
        row = above(row, sp[i])
        if i % step == 0:
            kept[i] = row
    i = j = 0
    for low in range(0, m, step):
        high = min(low + step, m)
        rows = [kept[high]]
        for k in range(high - 1, low - 1, -1):
            rows.append(above(rows[-1], sp[k]))
        rows.reverse()
        while i < high:
            if j == n:
                yield i, -1
                i += 1
            elif sp[i] == sq[j]:
                yield i, j
                i, j = i + 1, j + 1
            else:
                rest = (1 << (n - j)) - 1
                if not rows[i - low] >> (n - 1 - j) & 1 or (rows[i + 1 - low] & rest).bit_count() == (rows[i - low] & rest).bit_count():
                    yield i, -1  # as much in common without it
                    i += 1
                else:
                    yield -1, j
                    j += 1
    for j in range(j, n):
        yield -1, j


def _bits(at: Sequence[int], n: int) -> int:
    """The integer with these of n bits."""
    out = bytearray(n // 8 + 1)
    for k in at:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


def _in_groups_of_both(a: list, b: list) -> tuple[list, list]:
    """Two wrappers as plain items, repeated groups of one found in the other."""
    groups = [[x[1] for x in w if x[0] == "r"] for w in (a, b)]
    return _plain(_with_groups(a, groups[1])), _plain(_with_groups(b, groups[0]))


def align(a: list, b: list) -> list:
    """The wrapper of all that two wrappers match."""
    p, q = _in_groups_of_both(a, b)
    flat: list[tuple[list, bool]] = []
    for i, j in _common(_placed(p), _placed(q)):
        if i >= 0 and j >= 0:
            flat.append((_merge_equal([p[i][0]], [q[j][0]])[0], p[i][1] or q[j][1]))
        else:
            flat.append((p[i][0] if j < 0 else q[j][0], True))
    out: list = []
    for item, optional in flat:
        if not optional:
            out.append(item)
        elif out and out[-1][0] == "o":
            out[-1][1].append(item)
        else:
            out.append(["o", [item]])
    return fold_repeats(out)


def parsed(page: str) -> tuple[list[str], list]:
    """A page's texts and its items.  Pages are distinct if their texts outside
    left-out elements are: a copy with another advert is no second page."""
    texts: list[str] = []
    own: list[str] = []
    items: list = []
    words: list[str] = []
    above: list[Element] = []

    def flush() -> None:
        text = clean("".join(words))
        words.clear()
        if text:
            items.append(["x", key(text), [], [len(texts)]])
            texts.append(text)
            if not (above and above[-1].out):
                own.append(text)

    for kind, value in stream(page):
        if kind == "text":
            words.append(value)
        elif kind == "space":
            words.append(" ")
        else:
            flush()
            items.append(["t", value.label if kind == "open" else "/" + value.tag])
            if kind == "open":
                above.append(value)
            elif value in above:
                while above.pop() is not value:
                    pass
    flush()
    seen = int.from_bytes(hashlib.blake2b("\0".join(own).encode("utf-8", "replace"), digest_size=6).digest())
    for x in items:
        if x[0] == "x":
            x[2] = [seen]
    return texts, items


def wrapper_of(page: str) -> list:
    """A single page as a wrapper."""
    return fold_repeats([x if x[0] == "t" else [*x[:3], []] for x in parsed(page)[1]])


def fold(wrappers: list[list]) -> list:
    out = wrappers[0]
    for w in wrappers[1:]:
        if w != out:
            out = align(out, w)
    return out


def as_regex(items: list) -> str:
    """A wrapper as text: <tag>, #slot, 'fixed text', (...)? and (...)+."""
    part = {"t": lambda v: f"<{v}>", "x": lambda v: "#" if v is None else repr(v), "o": lambda v: f"({as_regex(v)})?", "r": lambda v: f"({as_regex(v)})+"}
    return "".join(part[k](v) for k, v, *_ in items)


LEFT, OTHER, TEXT = 0, 1, 2


def slots(wrapper: list) -> list:
    """A wrapper whose slots have, instead of places, what they are: LEFT (out),
    OTHER or (main) TEXT."""
    above: list[tuple[str, bool, bool]] = []

    def walk(items: list) -> list:
        out = []
        for x in items:
            if x[0] in "or":
                out.append([x[0], walk(x[1])])
            elif x[0] == "x":
                left, main = above[-1][1:] if above else (False, False)
                out.append([*x[:3], [LEFT if left else TEXT if main else OTHER]])
            else:
                if not x[1].startswith("/"):
                    tag, *words = x[1].split(".")
                    above.append((tag, *meaning(tag, set(words), *(above[-1][1:] if above else (False, False)))))
                elif any(tag == x[1][1:] for tag, _, _ in above):
                    while above.pop()[0] != x[1][1:]:
                        pass
                out.append(x)
        return out

    return walk(wrapper)


def _judged(page: list, wrapper: list) -> Iterator[tuple[int, int]]:
    """(place, what it is) of a page's texts; page and slots have the same shape."""
    for x, y in zip(page, wrapper):
        if x[0] in "or":
            yield from _judged(x[1], y[1])
        elif x[0] == "x":
            constant = y[1] is not None and len(y[2]) >= SEVERAL and x[1] == y[1]
            for place in x[3]:
                yield place, LEFT if constant else max(y[3])


def judged(items: list, wrapper: list) -> dict[int, int]:
    """What the texts of a page are that fall in a slot of ``wrapper`` (:func:`slots`)."""
    p, q = _in_groups_of_both(fold_repeats(items), wrapper)
    steps = [(i, j) for i, j in _common(_placed(p), _placed(q)) if i >= 0 and j >= 0]
    return dict(_judged([p[i][0] for i, _ in steps], [q[j][0] for _, j in steps]))


def main_text(page: str, wrapper: list) -> str:
    """The texts of a page in its host's slots of main text."""
    texts, items = parsed(page)
    known = judged(items, wrapper)
    kinds, last = [], next((known[i] for i in range(len(texts)) if i in known), LEFT)
    for i in range(len(texts)):
        last = known.get(i, last)
        kinds.append(last)
    least = TEXT if TEXT in kinds else OTHER
    return "\n\n".join(text for text, kind in zip(texts, kinds) if kind >= least)


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list] = {}
        for h, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            w = wrapper_of(page or "")
            by[h] = w if h not in by or by[h] == w else align(by[h], w)
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.string()), pa.array([json.dumps(w) for w in by.values()], pa.string())], names=["host", "wrapper"])


def _fold_group(group: pa.Table) -> pa.Table:
    rows = sorted(set(group["wrapper"].to_pylist()))
    return pa.table({"host": pa.array([group["host"][0].as_py()], pa.string()), "wrapper": pa.array([json.dumps(fold([json.loads(r) for r in rows]))], pa.string())})


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper) of every host, stored; ``pages`` has host and html."""
    small_batches(pages.sparkSession)
    found = pages.select("host", "html").mapInArrow(_infer, "host string, wrapper string").distinct()
    for salts in ROUNDS:
        found = (found.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(salts))).groupBy("host", "salt")
                 .applyInArrow(_fold_group, "host string, wrapper string"))
    return stored(found, "wrappers")


_WRAPPERS: dict[str, list] = {}


def _wrapper(stored_as: str) -> list:
    if stored_as not in _WRAPPERS:
        if len(_WRAPPERS) > 2000:
            _WRAPPERS.clear()
        _WRAPPERS[stored_as] = slots(json.loads(stored_as))
    return _WRAPPERS[stored_as]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h or "", _wrapper(w)) for h, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                         names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    own = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    wrappers = maybe_broadcast(infer_wrappers(own))
    kind = pages.schema["page_id"].dataType.simpleString()
    return own.join(wrappers, "host").select("page_id", "url", "html", "wrapper").mapInArrow(
        _extract, f"page_id {kind}, url string, text string, n_chars bigint")
