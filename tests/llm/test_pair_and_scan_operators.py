"""Hard negatives, licence scans and tokenizer alignment against brute force, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from zonelytics.llm import alignment, licenses, negatives
from zonelytics.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, row long, pair string, pairs string, n long, best string, found string, labels string"


def frame(spark, texts):
    """Rows (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "x", 1, "x", "x", "x") for i, t in texts], SCHEMA)


AWKWARD = [
    (None, None), (None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "Released under the MIT License."), (4, "Released under the MIT License."),
    (5, "word and other words of this one. " * 3000), (6, "ß É 日本語 \x00   é"), (7, "..."), (8, "x" * 50_000), (9, "a ▁ b"), (10, "</s> <0x0A> <|endoftext|>"),
]

# hard negatives


def mined(rows, positives=5, fewest=3, low=50, high=95):
    """By the definition, with Python's whole numbers. Rows are (id, label, anchor, vector)."""
    fine = []
    for i, label, anchor, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine.append((i, label, anchor, [math.floor(256 * x) for x in v]))
    out = []
    for at, (i, label, anchor, v) in enumerate(fine):
        if not anchor:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for k, (j, other, _, w) in enumerate(fine) if k != at]
        scored.sort(key=lambda x: (-x[0], x[1]))
        for p, pid, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [x for x in scored if x[2] != label and low * p <= 100 * x[0] <= high * p][:fewest]
            out += [(i, pid, n + 1, x[1], p, x[0]) for n, x in enumerate(inside)]
    return sorted(out)


VECTORS = "id long, label int, anchor boolean, vector array<double>, row int, score string, cell string, bin int, chunk int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 7, "x", "x", 7, 7) for r in rows], VECTORS)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("scale", [1.0, 0.02, 3e5])
def test_mined_negatives_equal_brute_force(spark, scale):
    r = np.random.default_rng(5)
    centres = r.normal(size=(6, 24))
    rows = []
    for i in range(900):
        c = i % 6
        v = (centres[c] * r.uniform(0.2, 2) + r.normal(size=24) * r.choice([0.1, 1.5])) * scale
        rows.append((i * 3, int(c if r.random() < 0.7 else r.integers(6)), i % 17 == 0, [float(x) for x in v]))
    rows += [(5000 + i, *rows[i][1:]) for i in range(40)]  # ties
    got = answers(negatives.mine(vectors(spark, rows), chunk_rows=20, bin_rows=150, sample=200, references=6))
    assert got == mined(rows) and len(got) > 50


def test_mining_awkward_rows(spark):
    r = random.Random(3)
    v = lambda n=4: [r.uniform(-1, 1) for _ in range(n)]
    rows = [
        (None, 1, True, v()), (1, None, True, v()), (2, 1, True, None), (3, 1, True, [1.0, None]), (4, 1, True, [math.nan]), (5, 1, True, [math.inf, 0.0]),
        (6, 1, True, []), (7, 2, True, [0.0] * 4), (8, 1, None, [1.0]), (9, 2, True, v(7)), (10, 3, True, v()), (10, 3, True, [0.5] * 4), (10, 3, True, [0.5] * 4),
        *[(20 + i, i % 3, i % 2 == 0, v(r.choice([3, 4, 4, 6]))) for i in range(60)],
        (90, 1, True, [1e12, -1e12, 3e11]), (91, 1, False, [2e12, 1e11]), (92, 2, False, [1e12, 5e11]), (93, 2, False, [-1e12]),
    ]
    got = answers(negatives.mine(vectors(spark, rows), bin_rows=20, chunk_rows=10))
    limit = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    assert all(limit(x) == x for row in got for x in row)
    assert [x for x in got if x[0] < 90] == [x for x in mined(rows) if x[0] < 90]
    assert answers(negatives.mine(vectors(spark, []))) == []
    assert answers(negatives.mine(vectors(spark, rows[:6]))) == []


def test_mining_hot_label(spark):
    rows = [(i, 0 if i % 10 else 1, i % 50 == 0, [1.0, float(i % 3)]) for i in range(3000)]
    assert answers(negatives.mine(vectors(spark, rows), bin_rows=500, chunk_rows=25)) == mined(rows)


def test_bounds_hold_and_prune():
    r = np.random.default_rng(8)
    centres = r.normal(size=(5, 16))
    rows = [centres[i % 5] + 0.2 * r.normal(size=16) for i in range(400)] + [np.zeros(16)]
    numbers = [np.floor(256 * v).astype(np.int64) for v in rows]
    refs = negatives.directions(numbers, 5)
    norms = np.array([np.linalg.norm(v) for v in numbers])
    units = np.array(numbers) / np.maximum(norms, 1)[:, None]
    angles = np.arccos(np.clip(units @ refs.T, -1, 1)).astype(np.float32).astype(float)
    low, high = negatives.bounds(angles, norms, angles, angles, norms, norms)
    exact = np.array(numbers) @ np.array(numbers).T
    assert (low <= exact).all() and (exact <= high).all()
    order = np.arange(401).reshape(-1, 1)
    tiles = [order[i::20].ravel() for i in range(20)]
    low, high = negatives.bounds(angles, norms, *(np.array([f(angles[t], 0) for t in tiles]) for f in (np.min, np.max)), *(np.array([f(norms[t]) for t in tiles]) for f in (np.min, np.max)))
    for t, lo, hi in zip(tiles, low.T, high.T):
        assert (lo[:, None] <= exact[:, t]).all() and (exact[:, t] <= hi[:, None]).all()
    # whole clusters are ruled out without a score
    make = lambda: negatives.Side.__new__(negatives.Side)
    a, x = make(), make()
    for s in (a, x):
        s.row = s.id = np.arange(401)
        s.label, s.norm, s.angles, s.numbers = np.array([str(i % 5) for i in range(401)], object), norms, angles, np.array(numbers)
        s.order = np.lexsort([angles.min(1), angles.argmin(1)])
    none = np.full((401, 1), -(1 << 63)), np.full((401, 1), (1 << 63) - 1)
    _, (scored, every) = negatives.best_of_block(a, x, *none, 5, True)
    assert scored < 0.6 * every


# licences


def phrase_places(text, phrases):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    out = sorted((i, p) for p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    return len(words), out


def test_base_phrases_equal_brute_force(spark):
    r = random.Random(2)
    vocabulary = ["under", "the", "MIT", "License", "mit-license", "Apache", "license,", "Version", "2.0", "2", "cc", "by", "CC-BY-NC", "nc", "é", "x9", "\n"]
    texts = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for i in range(500)] + AWKWARD
    got = sorted(map(tuple, licenses.scan(frame(spark, texts)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()), key=repr)
    want = []
    for i, t in texts:
        n, places = phrase_places(t, licenses.BASE)
        want.append((i, n, len(places), places[0][0] if places else None, places[-1][0] if places else None, sorted({licenses.BASE[p] for _, p in places})))
    assert got == sorted(want, key=repr)
    assert any(x[2] > 1 for x in got)


def test_expressions_equal_python(spark):
    r = random.Random(4)
    names = ["MIT", "GPL-2.0-only", "Apache-2.0", "BSD-3-Clause", "LGPL-2.1"]

    def make(depth):
        if depth == 0 or r.random() < 0.3:
            name = r.choice(names)
            return (name + " WITH Some-exception", f"({name!r} in ok)") if r.random() < 0.2 else (name, f"({name!r} in ok)")
        parts = [make(depth - 1) for _ in range(r.randint(2, 4))]
        ops = [r.choice(["AND", "or", "And", "OR"]) for _ in parts[1:]]
        text, code = (" ".join(itertools.chain.from_iterable(zip([p[k] for p in parts], [*ops, ""]))).strip() for k in (0, 1))
        return f"({text})", f"({code.replace('AND', 'and').replace('And', 'and').replace('OR', 'or')})"

    for _ in range(300):
        text, code = make(3)
        ok = {n for n in names if r.random() < 0.5}
        labels, permitted = licenses.evaluate(licenses.to_postfix(text), {licenses.label_of(n) for n in ok})
        assert permitted == eval(code, {"ok": ok}) and set(labels) == {licenses.label_of(n) for n in names if n in text}, text


@pytest.mark.parametrize("text, postfix", [
    ("", []), ("()", []), ("AND MIT", []), ("MIT AND", ["MIT"]), ("MIT OR (", ["MIT"]), ("(MIT OR GPL-2.0", ["MIT", "GPL-2.0", "or"]), ("MIT) AND X", ["MIT"]),
    ("MIT this file", ["MIT"]), ("MIT */ OR X", ["MIT"]), ("A AND (B OR (", ["A", "B", "and"]), ("A WITH (B)", ["A"]), ("A OR B AND C WITH D", ["A", "B", "C", "D", "with", "and", "or"]),
])
def test_broken_expressions(text, postfix):
    assert licenses.to_postfix(text) == postfix


def test_tags_and_notices(spark):
    texts = [
        (1, "// SPDX-License-Identifier: MIT OR GPL-2.0-only\nCode under the MIT License."), (2, "SPDX-License-Identifier: GPL-3.0-or-later AND Apache-2.0"),
        (3, "Licensed under CC BY-NC-SA 4.0."), (4, "licensed under the GNU General Public License, version 3."), (5, "nothing"), (6, "SPDX-License-Identifier without one"),
        (7, "É SPDX-License-Identifier: (Apache-2.0 WITH LLVM-exception)\n * spdx-license-identifier: ISC"),
    ]
    got = {x.doc_id: x for x in licenses.scan(frame(spark, texts)).collect()}
    assert got[1].labels == ["gpl-2", "mit"] and got[1].permitted and got[1].base_labels == ["mit"]
    assert [(f.word, f.kind, f.text) for f in got[1].found] == [(0, "tag", "MIT GPL-2.0-only or"), (8, "base", "under the mit license")]
    assert got[2].labels == ["apache-2", "gpl-3.0-or-later"] and got[2].permitted is False
    assert got[3].labels == ["cc-by-nc", "cc-by-nc-sa"] and got[3].permitted is False
    assert got[4].labels == ["gpl-3"] and 0.9 < got[4].score < 1
    assert got[5].labels == [] and got[5].score == 0 and got[5].permitted is None and got[6].found == []
    assert got[7].labels == ["apache-2", "isc"] and got[7].permitted and [f.word for f in got[7].found] == [1, 8]


def test_licence_scan_of_nothing(spark):
    assert licenses.scan(frame(spark, [])).collect() == []
    assert {x.n_words for x in licenses.scan(frame(spark, AWKWARD), base={}, notices={}, tag="").collect()} >= {0, 5}


# alignment


@pytest.fixture(scope="module")
def paths():
    return pytest.importorskip("public_tokenizers") and (tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def by_bytes(a, b, text):
    """Group text and links from the lengths of the tokens' bytes alone, whole text at once."""
    if not text:
        return None
    ids = a.encoder.encode(" " + text, add_special_tokens=False).ids, b.encoder.encode(text)
    whole = (" " + text).encode()
    if any(b"".join(t.bytes[i] for i in found) != whole for t, found in zip((a, b), ids)):
        return None
    ends = [list(itertools.accumulate(len(t.bytes[i]) for i in found)) for t, found in zip((a, b), ids)]
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        m, n = ends[0].index(cut, i) + 1, ends[1].index(cut, j) + 1
        groups.append(",".join(map(str, ids[0][i:m])) + "|" + ",".join(map(str, ids[1][j:n])))
        links.append((ids[0][m - 1], ids[1][n - 1]))
        i, j = m, n
    return ";".join(groups), links, len(ids[0]), len(ids[1])


def test_alignment_equals_decoded_bytes(spark, paths):
    r = random.Random(6)
    letters = "ab é☃中文\n\t 😀<s>0x0A.,'s  　ﬁ́\r\x00"
    words = ["".join(r.choice("abcdeé中😀") for _ in range(r.randint(1, 6))) for _ in range(80)]
    texts = [(i, "".join(r.choice(letters) for _ in range(r.randint(1, 14)))) for i in range(600)]
    texts += [(1000 + i, " ".join(r.choice(words) for _ in range(60))) for i in range(80)] + AWKWARD
    a, b = alignment.Byte(paths[0]), alignment.Piece(paths[1])
    known = [(i, by_bytes(a, b, t)) for i, t in texts]
    count = Counter(x for _, f in known if f for x in f[1])
    most = defaultdict(int)
    for (_, second), n in count.items():
        most[second] = max(most[second], n)
    want = []
    for i, f in known:
        if f is None:
            want.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            n = len(f[1])
            want.append((i, f[2], f[3], n, n, sum(count[x] == most[x[1]] for x in f[1]), sum(count[x] for x in f[1]), hashlib.sha256(f[0].encode()).hexdigest()))
    for in_memory in (1 << 18, 40, 0):  # all counts in the tasks, few, none
        got = sorted(map(tuple, alignment.align(frame(spark, texts), *paths, in_memory=in_memory).collect()), key=repr)
        assert got == sorted(want, key=repr), in_memory
    assert sum(x[1] > 0 for x in want) > 500 and ("" in {x[7] for x in want})


def test_alignment_spans_of_fallback_bytes(paths):
    a, b = alignment.Byte(paths[0]), alignment.Piece(paths[1])
    for text in ("𝔘𝔫𝔦 x", "日本語 テキスト 😀", "a\nb", "ß"):
        for t in (a, b):
            ids, ends = t.ends(text)
            assert ends.tolist() == list(itertools.accumulate(len(t.bytes[i]) for i in ids))


def test_alignment_forgets_and_learns_anew(paths):
    small, large = alignment.Aligner(*paths, remembered=5), alignment.Aligner(*paths)
    for n in range(40):
        text = " ".join(f"w{(n * k) % 23}" for k in range(1, 9))
        assert small.text(text) == large.text(text)
    assert len(small.known) <= 13 and len(small.old) <= 13


def test_alignment_of_nothing(spark, paths):
    assert alignment.align(frame(spark, []), *paths).collect() == []
    got = {tuple(x)[1:] for x in alignment.align(frame(spark, [(1, None), (None, "")]), *paths).collect()}
    assert got == {(0, 0, 0, 0, 0, 0, "")}


# names of page parts


BODY = "Words of the article, as many as it takes. " * 6


@pytest.mark.parametrize("html, kept", [
    (f'<div class="layout has-sidebar"><article><h1>Title</h1><p>{BODY}</p></article></div>', ["Title", BODY]),
    (f'<div class="no-comments"><div><h1>Title</h1><p>{BODY}</p></div></div>', ["Title", BODY]),
    (f'<div class="comments"><article><h1>Title</h1><p>{BODY}</p></article></div>', ["Title", BODY]),
    (f'<div class="entry-header"><h1>Title</h1></div><div><p>{BODY}</p></div>', ["Title", BODY]),
    (f'<h2 class="share-price">Share price</h2><p>{BODY}</p><div class="share-buttons">Share this</div>', ["Share price", BODY]),
    (f'<article><h1>Title</h1><ul class="share-buttons"><li>a</li><li>b</li><li>c</li></ul><p>{BODY}</p>' + '<div class="ad-slot">x</div>' * 3 + "<p>End.</p></article>", ["Title", BODY, "End."]),
    (f'<div id="site-footer">foot</div><div class="commentList2">c</div><div class="sidebar-left">s</div><p>{BODY}</p>', [BODY]),
])
def test_names_of_parts_beside_the_article(html, kept):
    from zonelytics.llm import lineblocks

    page = f"<html><body><nav><a href=x>Menu</a></nav>{html}<footer>foot</footer></body></html>"
    assert lineblocks.extract(page) == "\n\n".join(x.strip() for x in kept)
