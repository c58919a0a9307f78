"""Corpus operators against brute force, round trips and held-out accuracy, and on awkward rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonelytics.llm import common, decontaminate, langmix, lineblocks, maxent, packing, partenum, pseudonyms, spans, spotsigs, toxicity

SCHEMA = "doc_id long, text string, score string, start string, keys string, n_chars long, __part string, block int, row int"
LONG = "word and other words of this one. " * 6000


def frame(spark, texts):
    """Rows (doc_id, text) with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "x", "x", 1, "x", 1, 1) for i, t in texts], SCHEMA)


AWKWARD = [(None, None), (None, "no id here"), (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six seven."), (4, "One two three four five six seven."), (5, LONG), (6, "ß É 日本語 \x00   é"), (7, "..."), (8, "x" * 50_000)]


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfglmnprst" for b in "aeiou" for c in "lmnrst"][:vocabulary]
    return " ".join(r.choice(words) + (". " if r.random() < 0.1 else "") for _ in range(n))


@pytest.fixture(scope="module")
def awkward(spark):
    return frame(spark, AWKWARD).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


# components


def test_components_equal_union_find(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1040)]
    got = {x["node"]: x["component"] for x in common.components(spark.createDataFrame([*links, (None, 3), (5, 5)], "a long, b long")).collect()}
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    assert got == {x: root(x) for x in parent}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 decontamination


def test_masks_hit_substituted_windows():
    for length, changed in ((9, 1), (12, 2), (16, 3)):
        for places in itertools.combinations(range(length), changed):
            assert any(all(c == "0" or p + i not in places for i, c in enumerate(m)) for m in decontaminate.MASKS for p in range(length - len(m) + 1))


def test_leaks_equal_brute_force(spark):
    items = [(i, prose(100 + i, 14 + 3 * i)) for i in range(8)] + [(8, None), (9, ""), (10, "too short"), (11, prose(100, 14))]
    r, docs = random.Random(5), []
    for i in range(60):
        words = prose(i, r.randint(1, 150)).split()
        if i % 3 == 0:
            passage = items[i % 8][1].split()
            for k in range(0, len(passage), 9):
                if i % 2:
                    passage[k] = "changed"
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in passage]
        docs.append((i, " ".join(words)))
    docs.append((0, docs[0][1]))
    got = {(x["doc_id"], x["item_id"]): (x["length"], x["matched"]) for x in decontaminate.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), reach=16).collect()}
    want = {}
    for d, t in docs:
        a = common.plain_words(t)
        for i, u in items:
            b = common.plain_words(u)
            if len(b) < 9:
                continue
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, -shift), min(len(b), len(a) - shift)
                same = [x == y for x, y in zip(a[lo + shift : hi + shift], b[lo:hi], strict=True)]
                best = max(((s - 0.8 * (e - st), -st, e - st, s) for st in range(len(same)) for e in range(st + 1, len(same) + 1) for s in [sum(same[st:e])]), default=(0, 0, 0, 0))
                if best[2] >= min(13, len(b)):
                    want[d, i] = max(want.get((d, i), (0, 0)), (best[3], best[2]))
    assert got.keys() == want.keys() and len(want) > 15
    assert all(got[k][1] == want[k][0] for k in got)


def test_leaks_meet_the_documented_rule(spark):
    """One changed token at any place: 13 and 16 tokens between others, and the whole of an item of 12."""
    filler = [f"filler{i}" for i in range(60)]
    items, docs, want = [], [], set()
    for n in (12, 13, 16):
        for k in range(n):
            i = len(items)
            passage = [f"w{i}x{j}" for j in range(n)]
            items.append((i, " ".join(passage if n == 12 else [*(f"a{i}x{j}" for j in range(20)), *passage, *(f"b{i}x{j}" for j in range(20))])))
            passage[k] = "changed"
            docs.append((i, " ".join(filler[:30] + passage + filler[30:])))
            want.add((i, i))
    # two of three tokens, and 10 tokens (77 % of 13), are no overlap
    docs.append((1000, " ".join(filler + [w if j % 3 else "changed" for j, w in enumerate(items[20][1].split())])))
    docs.append((1001, " ".join(filler + items[20][1].split()[:10] + filler)))
    got = decontaminate.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), reach=16).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == want
    assert all(x["length"] >= min(13, x["item_tokens"]) and x["matched"] >= 0.8 * x["length"] for x in got)


def test_best_overlap_equals_brute_force():
    r = np.random.default_rng(4)
    for _ in range(400):
        n, least = int(r.integers(1, 40)), int(r.integers(1, 16))
        a, b = r.integers(0, 9, n), np.zeros(n, np.int64)
        same = (np.where(a < 7, 0, 1) == b).astype(int)
        spans = [(sum(same[s:e]) - 0.8 * (e - s), -s) for s in range(n) for e in range(s + least, n + 1)]
        spans = [x for x in spans if x[0] > -1e-9]
        start, length, matched = decontaminate.best_overlap(np.where(a < 7, 0, 1), b, 0.8 - 1e-9, least)
        assert (length > 0) == bool(spans)
        if spans:
            assert length >= least and matched == sum(same[start : start + length]) and abs(matched - 0.8 * length - max(spans)[0]) < 1e-6


def test_leaks_awkward(spark, awkward, none):
    items = spark.createDataFrame([(None, "One two three four five six seven"), (1, None), (2, "One two three four five six seven")], "item_id long, text string")
    got = decontaminate.leaks(awkward, items).collect()
    assert {(x["doc_id"], x["item_id"]) for x in got} == {(4, None), (4, 2)}
    assert decontaminate.leaks(none, items).count() == 0
    assert decontaminate.leaks(awkward, items.limit(0)).count() == 0


# 2 fingerprints


def spots_of(text):
    w = [x for x in re.split(r"[^\w]+|_", (text or "").lower()) if x]
    at = [i for i, x in enumerate(w) if x in spotsigs.ANCHORS]
    content = [x for x in w if x not in spotsigs.ANCHORS]

    def chain(anchor, source, first):
        return (anchor, *((source[first + k] if first + k < len(source) else "") for k in range(2))) if first < len(source) else None

    out = {chain(w[i], content, i - j) for j, i in enumerate(at)}
    if len(at) < 8:
        out |= {chain(w[i], w, i + 1) for i in range(len(w))}
    else:
        ends = [-1, *at, len(w)]
        out |= {chain(w[i], w, i + 1) for a, b in zip(ends, ends[1:], strict=False) if b - a > 8 for i in range(a + 1, b)}
    if len(w) == 1:
        out = {(w[0],)}
    return out - {None}


def test_edited_likeness_equals_brute_force(spark):
    docs = [(i, prose(i, 5 + 7 * i) + " the of and " * (i % 4) + " la de le " * (i % 3)) for i in range(30)] + [(40, None), (41, ""), (42, "alone"), (43, docs41 := prose(3, 60)), (44, docs41)]
    got = {x["doc_id"]: x for x in spotsigs.edited_likeness(frame(spark, docs)).collect()}
    texts = [t or "" for _, t in docs]
    for k, (i, _) in enumerate(docs):
        t, after = texts[k], texts[(k + 1) % len(docs)]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = spots_of(t), spots_of(edited), spots_of(after)
        x = got[i]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert x["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
        assert x["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1.0)
    assert got[43]["fingerprint"] == got[44]["fingerprint"]


def test_next_row_over_many_ranges(spark):
    docs = [(i * 7919 % 1009, f"t{i}") for i in range(1009)]
    got = {x["doc_id"]: x["next_text"] for x in spotsigs.with_next(frame(spark, docs).select("doc_id", "text"), ["text"], rows_each=20).collect()}
    order = sorted(docs)
    assert got == {order[k][0]: order[(k + 1) % len(order)][1] for k in range(len(order))}


def test_likeness_awkward(awkward, none):
    got = spotsigs.edited_likeness(awkward).collect()
    assert len(got) == len(AWKWARD) and all(0 <= x["near_edited"] <= 1 for x in got)
    assert spotsigs.edited_likeness(none).count() == 0
    assert spotsigs.fingerprints(awkward).where("doc_id = 4").select("fingerprint").distinct().count() == 1


# 3 languages


def test_languages_held_out_and_mixtures(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langmix.fit(docs.where("doc_id % 4 <> 2"))
    got = langmix.identify(docs.where("doc_id % 4 = 2"), model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(x["lang"] == x["lang_pred"] for x in got) >= 0.95 * len(got)
    half = {lang: t for lang, t in docs.where("length(text) > 3000").groupBy("lang").agg(F.first(F.substring("text", 1, 2000))).collect()}
    mixed = langmix.identify(spark.createDataFrame([(1, half["en"] + "\n" + half["de"])], "doc_id long, text string"), model).first()
    assert sorted(mixed["languages"]) == ["de", "en"] and all(0.3 < p < 0.7 for p in mixed["proportions"])


def test_em_does_not_lower_the_likelihood():
    r = np.random.default_rng(3)
    model = langmix.Model(["a", "b", "c"], r.integers(0, 50, (3, langmix.BUCKETS)).astype(float))
    like, owner = r.normal(0, 3, (40, 3)), np.repeat(np.arange(4), 10)
    totals = [model.mixtures(like, owner, np.ones((4, 3), bool), np.full((4, 3), 1 / 3), k)[1] for k in (0, 1, 5, 30)]
    assert all((b >= a - 1e-9).all() for a, b in itertools.pairwise(totals))


def test_languages_awkward(spark, awkward, none):
    model = langmix.fit(spark.createDataFrame([("One two", "en"), ("eins zwei", "de"), (None, "en"), ("x", None)], "text string, lang string"))
    got = langmix.identify(awkward, model).collect()
    assert len(got) == len(AWKWARD)
    assert all((x["lang_pred"] == "und") == (x["doc_id"] in (1, 2, 3, 7)) for x in got if x["doc_id"] is not None)
    empty = langmix.fit(none.withColumn("lang", F.lit("en")))
    assert {x["lang_pred"] for x in langmix.identify(awkward, empty).collect()} == {"und"}


# 4 toxicity


def test_block_max_search_equals_brute_force():
    r = random.Random(2)
    vectors = [sorted({r.randrange(30): r.random() for _ in range(r.randint(1, 6))}.items()) for _ in range(500)]
    index = toxicity.Index(vectors, 30, block=16)
    dense = np.zeros((500, 30))
    for i, v in enumerate(vectors):
        for t, w in v:
            dense[i, t] = w
    dense /= np.linalg.norm(dense, axis=1, keepdims=True)
    for _ in range(60):
        q = sorted({r.randrange(30): r.random() for _ in range(r.randint(1, 5))}.items())
        x = np.zeros(30)
        for t, w in q:
            x[t] = w
        sims = dense @ x / np.linalg.norm(x)
        ids, got = index.nearest(q, 10)
        want = np.sort(sims[sims > 0])[::-1][:10]
        assert np.allclose(got, want) and np.allclose(sims[ids], got)


def test_isotonic_curve():
    got = toxicity.rising(np.array([0.0, 3, 1, 5]), np.array([4.0, 4, 4, 5]))
    assert np.allclose(got, [0, 0.5, 0.5, 1])


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(toxicity.labelled(docs, labels, common.crc_mod("doc_id", 5) != 0))
    got = toxicity.score(docs, model).where(common.crc_mod("doc_id", 5) == 0).join(labels, "doc_id").where("quality = 1").collect()
    toxic, fine = ([x["predicted"] for x in got if x["toxic"] == k] for k in (1, 0))
    assert sum(fine) <= 0.05 * len(fine) and sum(toxic) >= 0.5 * len(toxic)
    assert all(x["neighbours"] for x in got if x["predicted"])


def test_toxicity_awkward(spark, awkward, none):
    labels = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (5, 0), (None, 1), (6, None), (99, 1)], "doc_id long, toxic int")
    for learned in (toxicity.fit(toxicity.labelled(awkward, labels, F.lit(True))), toxicity.fit(toxicity.labelled(none, labels, F.lit(True)))):
        got = toxicity.score(awkward, learned).collect()
        assert len(got) == len(AWKWARD) and all(0 <= x["score"] <= 1 for x in got)
        assert toxicity.clean(awkward, learned).columns == awkward.columns
        assert toxicity.score(none, learned).count() == 0


# 5 sentence spans


def test_spans_equal_brute_force(spark):
    r, docs = random.Random(9), []
    passages = [prose(900 + i, 60) for i in range(4)]
    for i in range(50):
        docs.append((i, prose(i, r.randint(0, 80)) + "\n" + (passages[i % 4] if i % 3 else "") + "\n" + prose(500 + i, 20)))
    docs += [(50, docs[1][1]), (51, passages[0] + "\n" + passages[0])]
    got = {x["doc_id"]: x for x in spans.drop_repeats(frame(spark, docs)).collect()}
    first, gone, origin = {}, defaultdict(set), defaultdict(set)
    for i, t in docs:
        parts = spans.sentences(t)
        assert "".join(parts) == t
        norm = [" ".join(p.split()).lower() for p in parts]
        for a in range(len(parts)):
            b = next((b for b in range(a + 3, len(parts) + 1) if sum(len(x.split()) for x in norm[a:b]) >= 15), None)
            if b is None:
                continue
            run = tuple(norm[a:b])
            if run in first:
                gone[i] |= set(range(a, b))
                origin[i].add(first[run])
            first.setdefault(run, i)
    for i, t in docs:
        assert got[i]["text"] == "".join(p for k, p in enumerate(spans.sentences(t)) if k not in gone[i])
        assert got[i]["n_removed"] == len(gone[i]) and got[i]["first_docs"] == sorted(origin[i])
    assert got[50]["text"] == "" and len(gone) > 20


def test_spans_awkward(awkward, none):
    got = spans.drop_repeats(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert {(x["doc_id"], x["text"]) for x in got if x["n_removed"] == 0} >= {(i, t) for i, t in AWKWARD if i in (1, 2, 3, 6, 7, 8)}
    assert spans.drop_repeats(none).count() == 0


# 6 language model


def test_maxent_sums_to_one_and_counts_exactly(spark):
    docs = [(i, prose(i, 80, 150)) for i in range(60)] + [(60, None), (61, ""), (62, "never seen words")]
    training = frame(spark, docs[:50])
    got = {x["doc_id"]: x for x in maxent.score(frame(spark, docs), training).collect()}
    counts = Counter(w for _, t in docs[:50] for w in [*common.ascii_words(t), maxent.END])
    n, v = sum(counts.values()), len(counts)
    for i, t in docs:
        words = [*common.ascii_words(t), maxent.END]
        assert got[i]["n_tokens"] == len(words) and got[i]["n_known"] == sum(counts[w] > 0 for w in words) and got[i]["train_tokens"] == n
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words))
    assert sum(x["score"] for x in got.values()) > sum(x["base_score"] for x in got.values())
    # all words of all classes and the unseen word of each group share a mass of one
    table = maxent.count_words(training)
    words = maxent.summarise(table)
    lexicon = maxent.Lexicon(words)
    known = lexicon.look([w for w in counts])
    inside = 10 ** words.inside(known[:, 3], known[:, 1])
    mass = np.bincount(known[:, 1], inside, maxent.CLASSES)
    seen = np.flatnonzero(words.types)
    mass[maxent.HEADS + seen] += words.discount * words.types[seen] / words.tokens[seen]
    assert np.allclose(mass[: maxent.HEADS], 1) and np.allclose(mass[maxent.HEADS + seen], 1)
    x = maxent.features(np.arange(50), np.array([0]))
    assert np.allclose(np.exp(maxent.log_classes(np.random.default_rng(0).normal(size=(maxent.BUCKETS, maxent.CLASSES)).astype(np.float32), np.zeros(maxent.CLASSES, np.float32), x)).sum(axis=1), 1, atol=1e-4)


def test_rare_words_by_join_equal_words_by_table(spark, monkeypatch):
    docs = [(i, prose(i, 120, 300)) for i in range(20)]
    whole = {x["doc_id"]: x for x in maxent.score(frame(spark, docs), frame(spark, docs)).collect()}
    few = maxent.summarise
    monkeypatch.setattr(maxent, "summarise", lambda counts: few(counts, frequent=40))
    joined = {x["doc_id"]: x for x in maxent.score(frame(spark, docs), frame(spark, docs)).collect()}
    assert all(joined[i]["n_known"] == whole[i]["n_known"] and joined[i]["base_score"] == pytest.approx(whole[i]["base_score"]) for i in whole)


def test_maxent_awkward(awkward, none):
    for training in (awkward, none):
        got = maxent.score(awkward, training).collect()
        assert len(got) == len(AWKWARD) and all(math.isfinite(x["score"]) and math.isfinite(x["base_score"]) for x in got)
    assert maxent.score(none, awkward).count() == 0


# 7 pseudonyms


def luhn(d):
    return sum((v := int(c) * (1 + i % 2)) - 9 * (v > 9) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    cases = {
        "4111111111111111": (r"\d{16}", luhn),
        "4111 1111 1111 1111": (r"\d{4} \d{4} \d{4} \d{4}", lambda s: luhn(s.replace(" ", ""))),
        "152.143.123.131": (r"\d+(\.\d+){3}", lambda s: all(int(x) < 256 for x in s.split("."))),
        "+1 (873) 555-4781": (r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}", None),
        "873-555-4781": (r"[2-9]\d\d-[2-9]\d\d-\d{4}", None),
        "DE89370400440532013000": (r"DE\d{20}", lambda s: int(s[4:] + "1314" + s[2:4]) % 97 == 1),
        "2020-02-29": (r"20\d\d-\d\d-\d\d", None),
        "31.12.1999": (r"\d\d\.\d\d\.19\d\d", None),
        "123-45-6789": (r"\d{3}-\d{2}-\d{4}", lambda s: s[:3] not in ("000", "666")),
        "jo.doe42@mail7.example.com": (r"[a-z]{2}\.[a-z]{3}\d\d@mail7\.example\.com", None),
        "+49 30 1234567": (r"\+49 \d\d \d{7}", None),
    }
    left = ["4111111111111112", "300.1.1.1", "2021-02-29", "000-12-3456", "da6a7d4f67f2203943", "v1.2.3.4.5", "DE00370400440532013000", "12", "1" * 40]
    rows = [(i, f"<{v}>, {v}") for i, v in enumerate([*cases, *left])]
    got = {x["doc_id"]: x for x in pseudonyms.pseudonymise(frame(spark, rows), "k").collect()}
    for i, (v, (pattern, valid)) in enumerate(cases.items()):
        a, b = re.fullmatch(r"<(.*)>, (.*)", got[i]["text"]).groups()
        assert a == b != v and re.fullmatch(pattern, a) and (valid is None or valid(a)) and got[i]["n_replaced"] == 2, (v, a)
    assert all(got[i]["text"] == t and got[i]["n_replaced"] == 0 for i, t in rows[len(cases) :])
    # one number, however written
    assert got[0]["text"].split(", ")[1] == got[1]["text"].split(", ")[1].replace(" ", "")
    assert re.sub(r"\D", "", got[3]["text"].split(", ")[1])[1:] == re.sub(r"\D", "", got[4]["text"].split(", ")[1])
    other = pseudonyms.pseudonymise(frame(spark, rows), "another key").where("doc_id = 0").first()
    assert other["text"] != got[0]["text"]


def test_pseudonyms_beside_other_numbers(spark):
    card, iban, phone = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201", "415-555-2671"
    cases = {
        f"{card} 12/26": ([card], " 12/26"),
        "4111111111111111 123": (["4111111111111111"], " 123"),
        "ref 12 4111111111111111": (["4111111111111111"], "ref 12 "),
        f"{phone} 415-555-2672": ([phone, "415-555-2672"], " "),
        f"{iban} 12": ([iban], " 12"),
        f"{iban} PLEASE": ([iban], " PLEASE"),
        f"{iban} {card}": ([iban, card], " "),
        "AT611904300234573201 AT611904300234573201": (["AT611904300234573201"] * 2, " "),
        f"+1 {phone} 12/26": ([f"+1 {phone}"], " 12/26"),
        f"+44 20 794 0958 {card}": (["+44 20 794 0958", card], " "),
        "1234567890123 192.168.0.1": (["192.168.0.1"], "1234567890123 "),
        "1234567890123 15.03.2021": (["15.03.2021"], "1234567890123 "),
        "2021-03-15 12:30": (["2021-03-15"], " 12:30"),
        "(2021-03-15)": (["2021-03-15"], "()"),
        "1234567890123 12.ab@x.com": (["12.ab@x.com"], "1234567890123 "),
        "+1 (017) 555-7713": (["+1 (017) 555-7713"], ""),
        "+1 (415) 155-7713": (["+1 (415) 155-7713"], ""),
    }
    values = sorted({v for vs, _ in cases.values() for v in vs})
    rows = [(i, t) for i, t in enumerate([*cases, *values, "1 2 3 " * 3000])]
    got = {x["doc_id"]: x for x in pseudonyms.pseudonymise(frame(spark, rows), "k").collect()}
    new = {v: got[len(cases) + k]["text"] for k, v in enumerate(values)}
    assert all(a != b for a, b in new.items())
    for i, (t, (vs, rest)) in enumerate(cases.items()):
        want, at = t, 0
        for v in vs:
            at = want.index(v, at)
            want = want[:at] + new[v] + want[at + len(v) :]
            at += len(v)
        assert (got[i]["text"], got[i]["n_replaced"]) == (want, len(vs)), t
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["+1 (017) 555-7713"])
    low = spark.range(4000).select(F.concat(F.lit("+1"), F.lpad((F.col("id") % 2000 * 499_979).cast("string"), 10, "0")).alias("text")).distinct()
    made = {x[0] for x in pseudonyms.pseudonymise(low, "k").select("text").collect()}
    assert len(made) == low.count() and all(int(x[2:5]) < 200 or int(x[5:8]) < 200 for x in made if x)


def test_feistel_is_a_permutation(spark):
    for n, a, b in ((36524, 92, 397), (36525, 75, 487), (1000, 100, 10)):
        got = spark.range(n).select(pseudonyms.permuted(F.col("id"), a, b, "k", "t").alias("y")).agg(F.countDistinct("y"), F.min("y"), F.max("y")).first()
        assert tuple(got) == (n, 0, n - 1)
    names = spark.range(3000).select(pseudonyms.permuted_text(F.concat(F.lit("ab"), F.col("id").cast("string")), "k", "t").alias("y"))
    assert names.distinct().count() == 3000


def test_pseudonyms_awkward(awkward, none):
    got = pseudonyms.pseudonymise(awkward, "k")
    assert got.columns == [*awkward.columns, "n_replaced"]
    assert sorted((str(x["doc_id"]), str(x["text"])) for x in got.collect()) == sorted((str(i), str(t)) for i, t in AWKWARD)
    assert pseudonyms.pseudonymise(none, "k").count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


# 8 main text

PAGE = """<html><head><title>x</title><style>p{}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies, and this is a long text about them that goes on and on.</div><div class=%s><h2>The  title</h2><p>First &amp; longer paragraph with
enough text<br>to be one. It goes on for a while.<p>Short.<aside>Beside the text</aside><p>Last paragraph, again with some words in it, so that it counts.<!-- <p>hidden</p> --></div>
<div class="adBox">Buy now, buy now, buy now, and buy now again!</div><div id="comments"><p>What a great article, I have to say, really very good.</p></div><form><p>Your name and some text</form><footer>&copy; me</footer></body>"""


def test_main_text():
    want = "The title\n\nFirst & longer paragraph with enough text to be one. It goes on for a while.\n\nShort.\n\nLast paragraph, again with some words in it, so that it counts."
    assert lineblocks.extract(PAGE % '"entry-content"') == want
    assert lineblocks.extract((PAGE % "x").replace("<div class=x>", "<article>").replace("<div class=\"adBox\">", "</article><div>")) == want
    assert lineblocks.extract("<p>tiny</p>") == "tiny" and lineblocks.extract("a < b & c") == "a < b & c"


def test_surge_and_dive():
    keep = lineblocks.between(np.array([0, 3, 0, 0, 0, 40, 200, 10, 90, 0, 0, 0, 0, 100, 0]), 3, 80)
    assert np.flatnonzero(keep).tolist() == [5, 6, 7, 8, 13]
    assert not lineblocks.between(np.zeros(5, np.int64), 3, 80).any() and not lineblocks.between(np.zeros(0, np.int64), 3, 80).any()


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = lineblocks.main_text(pages).collect()
    source = {x["page_id"]: x["html"] for x in pages.collect()}
    assert len(got) == len(source)
    for x in got:
        article = re.search(r"<article>(.*?)</article>", source[x["page_id"]], re.DOTALL)[1]
        blocks = [" ".join(lineblocks.html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", article)]
        assert x["text"] == "\n\n".join(b for b in blocks if b) and x["n_chars"] == len(x["text"])


def test_pages_awkward(spark):
    rows = [(None, None, None, "a"), (1, "u", "", "a"), (2, "u", "<div" * 1000, "a"), (3, "u", "<p>" * 20000 + "x", "a"), (3, "u", "<script>never closed", "a"), (4, "u", "<p>" + "word " * 100_000, "a")]
    got = lineblocks.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 6 and all(x["text"] is not None and x["n_chars"] == len(x["text"]) for x in got)
    assert max(x["n_chars"] for x in got) == 499_999


# 9 Jaccard join


def brute_groups(docs, n, percent):
    sets = [(i, set(zip(*(w[k:] for k in range(min(n, len(w)))), strict=False)) if (w := common.ascii_words(t)) else set()) for i, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(b)] = root(a)
    low = defaultdict(list)
    for k, (i, _) in enumerate(sets):
        low[root(k)].append(i)
    return sorted((i, len(s), min(low[root(k)])) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 1000), (5, 80, 1000), (3, 90, 4), (5, 80, 4)])
def test_groups_equal_brute_force(spark, n, percent, block):
    r, docs = random.Random(percent + block), []
    for base in range(12):
        words = prose(base, (7, 40, 130, 300)[base % 4]).split()
        for _ in range(12):
            copy = list(words)
            for _ in range(r.choice((0, 1, 1, 2, 4))):
                copy[r.randrange(len(copy))] = r.choice(("swapped", "other", "third"))
            docs.append((len(docs) * 7 % 1009, " ".join(copy)))
    docs += [(2000, "one two"), (2001, "ONE  two"), (2002, ""), (2003, None), (2004, "one")]
    got = sorted(tuple(x) for x in partenum.jaccard_groups(frame(spark, docs), n, percent, block_sets=block).collect())
    assert got == brute_groups(docs, n, percent)


def test_signatures_of_similar_sets_meet():
    r = np.random.default_rng(4)
    for percent in (80, 90):
        scheme = partenum.PartEnum(percent)
        for size in [*range(1, 60), 100, 333, 1000, 2500]:
            a = r.integers(0, 2**63, size).astype(np.uint64)
            for drop in {0, 1, size // 20, size // 10}:
                for new in {0, 1, size // 20, size // 10}:
                    b = np.unique(np.append(a[drop:], r.integers(0, 2**63, new).astype(np.uint64)))
                    common_ = len(np.intersect1d(a, b))
                    if 0 < 100 * common_ >= percent * (size + len(b) - common_) and not np.array_equal(np.unique(a), b):
                        assert np.intersect1d(scheme.signatures(np.unique(a)), scheme.signatures(b)).size, (percent, size, drop, new)


def test_sketches_rule_out_no_link():
    r = np.random.default_rng(5)
    for percent in (80, 90):
        for size in (1, 9, 40, 333, 2500):
            a = r.integers(0, 2**63, size).astype(np.uint64)
            others = [np.unique(np.append(a[drop:], r.integers(0, 2**63, new).astype(np.uint64))) for drop in (0, 1, size // 20, size // 9) for new in (0, 1, size // 20, size)]
            sets = [np.unique(a), *(b for b in others if len(b)), *(r.integers(0, 2**63, size).astype(np.uint64) for _ in range(5))]
            common_ = [[len(np.intersect1d(x, y)) for y in sets] for x in sets]
            want = partenum.similar(sets, percent)
            got = partenum.near([len(s) for s in sets], [partenum.parities(s) for s in sets], percent)
            group = {i: i for i in range(len(sets))}
            for x, y in got:
                group |= {k: group[x] for k in group if group[k] == group[y]}
            assert all(common_[x][y] and group[x] == group[y] for x, y in want)
            assert size < 40 or not any(k >= len(sets) - 5 for pair in got for k in pair)  # unlike sets stay apart


@pytest.mark.parametrize("run_sets", [20_000, 3])
def test_unlike_sets_that_share_a_signature_meet_in_no_cluster(spark, monkeypatch, run_sets):
    r, whole, sizes = random.Random(9), partenum.written, Counter()
    passage = prose("passage", 16)
    docs = [(i, " ".join(f"w{r.randrange(10**9)}" for _ in range(8)) + " " + passage) for i in range(60)]
    docs += [(100 + i, f"{t} more") for i, t in docs[:6]]

    def written(df, purpose):
        out = whole(df, purpose)
        sizes[purpose] += out.count()
        return out

    monkeypatch.setattr(partenum, "written", written)
    got = sorted(tuple(x) for x in partenum.jaccard_groups(frame(spark, docs), 5, 80, run_sets=run_sets).collect())
    assert got == brute_groups(docs, 5, 80) and sum(c != i for i, _, c in got) == 6
    assert run_sets == 3 or sizes["clusters"] == 12  # of 66 before


def test_groups_awkward(spark, awkward, none):
    got = partenum.jaccard_groups(awkward, 3, 90).collect()
    assert len(got) == len(AWKWARD)
    assert all(x["component_id"] == x["doc_id"] for x in got)
    assert partenum.jaccard_groups(none).count() == 0
    one = partenum.one_of_each(awkward)
    assert one.columns == awkward.columns and one.where("doc_id = 4").count() == 1 and one.count() == len(AWKWARD) - 1


# 10 packing


def test_best_fit_equals_brute_force():
    r = random.Random(8)
    for window in (7, 64, 2048):
        lengths = sorted((r.randint(1, window) for _ in range(400)), reverse=True)
        rooms, want = [], []
        for n in lengths:
            fit = min(((room, k) for k, room in enumerate(rooms) if room >= n), default=None)
            want.append(fit[0] if fit else window)
            if fit:
                rooms[fit[1]] -= n
            else:
                rooms.append(window - n)
        where, offset = packing.best_fit(lengths, window)
        assert [window - o for o in offset] == want and len(set(where)) == len(rooms)


def test_packing_round_trip(spark, awkward, none):
    tokenizer = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")
    plain = packing.Ids(tokenizer).whole
    got = packing.pack(awkward, tokenizer, window=512, shard_docs=4).collect()
    assert sum(x["length"] for x in got) == sum(len(plain.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in AWKWARD)
    for i, t in AWKWARD:
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        crc = [zlib.crc32(np.array(ids[a : a + 512], "<u4").tobytes()) for a in range(0, len(ids), 512)]
        assert Counter(crc) <= Counter(x["ids_crc32"] for x in got if x["doc_id"] == i)
    at = defaultdict(list)
    for x in got:
        at[x["sequence_id"]].append((x["offset"], x["length"]))
    for held in at.values():
        held.sort()
        assert held[0][0] == 0 and all(a + n == b for (a, n), (b, _) in itertools.pairwise(held)) and sum(held[-1]) <= 512
    assert packing.pack(none, tokenizer).count() == 0


@pytest.mark.parametrize("text", ["it's don't İ Σ ς", "A<|endoftext|>b", "x\x1cz y", "日本語 ok", "²³½ ªº 12 É`~", "", "éa", "AÉİ", "a\tb\r\nc"])
def test_ids_equal_the_tokenizer(text):
    ids = packing.Ids(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"), remembered=2)
    assert np.frombuffer(ids.one(text), "<u4").tolist() == ids.whole.encode(text, add_special_tokens=False).ids


def test_maxent_model_is_not_cut_down():
    """Context chooses among 24 classes by four features, every word met twice is told apart, and the table grows with these."""
    assert maxent.CLASSES == 24 and maxent.features(np.arange(9), np.array([0])).shape == (9, 4)
    text = [b"w%d" % i for i in range(30_000)]
    keys = common.word_keys(text)
    order = np.argsort(keys)
    words = maxent.Words(keys[order], np.where(order < 25_000, 2, 1), total=55_000, distinct=30_000)
    table = maxent.Lexicon(words).look(text)
    assert len(set(table[:25_000, 2])) == 25_000 and len(set(table[25_000:, 2])) <= maxent.GROUPS
    assert words.buckets == 1 << 17 and maxent.Words().buckets == 1 << 16
    small = maxent.Lexicon(words, remembered=100)  # what was forgotten is learned anew
    assert all((small.look(text[i : i + 500]) == table[i : i + 500]).all() for i in range(0, 2000, 250))


def test_gradient_rows_above_16_bits():
    r = np.random.default_rng(1)
    x, cls = r.integers(0, 1 << 17, (500, maxent.FEATURES)).astype(np.int32) // 1000 * 1000, r.integers(0, maxent.CLASSES, 500)
    make = lambda: (np.zeros((1 << 17, maxent.CLASSES), np.float32), np.zeros(maxent.CLASSES, np.float32), np.zeros(1 << 17, np.float32))
    weights, bias, seen = make()
    maxent.descend(weights, bias, seen, x, cls, 0.2)
    error = np.full((500, maxent.CLASSES), 1 / maxent.CLASSES) - np.eye(maxent.CLASSES)[cls]
    want, _, sums = make()
    for i in range(maxent.FEATURES):
        grad = np.zeros(want.shape)
        np.add.at(grad, x[:, i], error)
        sums += (grad * grad).mean(axis=1)
        want -= 0.2 * grad / np.sqrt(sums + 1.0)[:, None]
    assert np.allclose(weights, want, atol=1e-5)


def test_sums_of_runs_equal_reduceat_to_the_bit():
    r = np.random.default_rng(2)
    for rows in (1, 2, 900):
        values, names = r.standard_normal((rows, maxent.CLASSES)).astype(np.float32), np.minimum(r.geometric(0.02, rows) // 3, 90)
        order = np.argsort(names, kind="stable")
        at = np.flatnonzero(np.append(True, np.diff(names[order]) > 0))
        assert np.array_equal(maxent.sums_of_runs(values, order, at), np.add.reduceat(values[order], at, axis=0))
    weights, bias, cls = r.standard_normal((64, maxent.CLASSES)).astype(np.float32), maxent.Words().classes(), r.integers(0, maxent.CLASSES, 500)
    x = r.integers(0, 64, (500, maxent.FEATURES)).astype(np.int32)
    z = bias + weights[x].sum(axis=1)
    assert np.allclose(maxent.raised(weights, bias, x), z - z.max(axis=1, keepdims=True), atol=1e-4) and maxent.raised(weights, bias, x).max(axis=1).any() == 0
    assert np.array_equal(maxent.log_classes(weights, bias, x, cls), maxent.log_classes(weights, bias, x)[np.arange(500), cls])


def test_training_sends_by_tokens_not_by_partitions(spark, monkeypatch):
    texts = [(prose(i, 40, 300),) for i in range(200)]
    parts = [spark.createDataFrame(spark.sparkContext.parallelize(texts, n), "text string") for n in (1, 40)]
    words = maxent.summarise(maxent.count_words(parts[0]))
    (one, bias), (many, its) = (maxent.train(p, words) for p in parts)
    assert one.any() and np.array_equal(one, many) and np.array_equal(bias, its)  # few tokens are one task's, however they are dealt
    monkeypatch.setattr(maxent, "TASK_TOKENS", words.total // 8)
    assert not np.array_equal(maxent.train(parts[1], words)[0], one)  # many are dealt over tasks that learn apart


def test_word_tables_equal_a_dictionary_of_the_frequent():
    text = [maxent.END, b"", b"a", b"\xc3\xa9", "日本".encode(), *(b"w%d" % i for i in range(3000))]
    keys = np.sort(common.word_keys(text[:2000:2]))
    close = np.unique(np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1)]))  # others that begin with the same bits
    for known in (close, close[:1], close[:0]):
        words = maxent.Words(known, np.arange(len(known)) % 5 + 1, heads=keys[[7, 3, 500]])
        count, heads = dict(zip(known.tolist(), words.counts.tolist(), strict=True)), words.heads.tolist()
        for got, w, k in zip(maxent.Lexicon(words).look(text).tolist(), text, common.word_keys(text).tolist(), strict=True):
            group, c, signed = maxent.xxhash.xxh32_intdigest(w[-2:]) % maxent.GROUPS, count.get(k, -1), common.signed(k)
            assert got == [signed, heads.index(k) if k in heads else maxent.HEADS + group, signed if c >= maxent.TOLD_APART else group, c]
    assert maxent.Lexicon(words).look([]).shape == (0, 4)


def test_packing_looks_up_each_word_once():
    """A text with new words is looked up once; words of letters alone need no pattern."""
    ids = packing.Ids(public_path())

    class Counting(dict):
        seen = 0

        def get(self, key, default=None):
            Counting.seen += 1
            return super().get(key, default)

    class NoPattern:
        def findall(self, word):
            assert not word.isalpha(), word
            return packing.regex.findall(packing._LETTERS_WHOLE, word)

    ids.words, ids.split = Counting(), NoPattern()
    text = "Plain words, l'été 2024 isn't over; plain Words again " * 3
    assert ids.one(text) == np.array(ids.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert Counting.seen == len(text.split())


def public_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_shuffles_of_written_frames_are_deleted(spark):
    """Written frames leave no shuffle behind, and the setting is as before."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, tracker = spark.conf.get(name), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    had = tracker.shuffleStatuses().size()
    for i in range(3):
        assert common.written(spark.range(1000).repartition(4, F.col("id") % (i + 2)).groupBy("id").count(), "test").count() == 1000
    assert spark.conf.get(name) == before and tracker.shuffleStatuses().size() <= had + 3  # those of the counts, which are not written


def test_components_broadcast_nothing(spark, monkeypatch):
    plans, whole = [], common.written

    def written(df, purpose):
        out = whole(df, purpose)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(common, "written", written)
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in common.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert plans and not any("Broadcast" in p for p in plans)
