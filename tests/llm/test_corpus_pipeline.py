"""The pipeline on a small corpus of planted cases, and its registration."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import __spark_entry__
import corpus_pipeline
from zonelytics.llm import packing, partenum, pseudonyms, toxicity
from zonelytics.llm.common import ascii_words
from zonelytics.llm.queries import KEY, QUERIES, tokenizer_path

pytest.importorskip("public_tokenizers")


def prose(r, n):
    return " ".join("".join(r.choice(("ba", "de", "fi", "go", "lu", "ne", "ra", "so", "ti")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents by kind: plain, toxic, near copies of plain ones, leaks of benchmark items, with personal values."""
    r, docs, kinds = random.Random(11), [], {}
    items = [(i, prose(r, 30)) for i in range(5)]

    def add(kind, text):
        kinds[len(docs)] = kind
        docs.append((len(docs), text, "en", "s", len(text)))

    for _ in range(60):
        add("plain", prose(r, r.randint(40, 200)))
    for _ in range(40):
        words = prose(r, 80).split()
        words[r.randrange(80)] = "nastyword"
        words[r.randrange(80)] = "nastyword"
        add("toxic", " ".join(words))
    for i in range(10):
        words = docs[i][1].split()
        words[len(words) // 2] = "changed"
        add("copy", docs[i][1] if i % 2 or len(words) < 100 else " ".join(words))
    for i in range(10):
        passage = items[i % 5][1].split()
        passage[7] = "other"
        add("leak", prose(r, 50) + " " + " ".join(passage) + " " + prose(r, 20))
    for _ in range(5):
        add("personal", prose(r, 60) + " 4111111111111111 or +1 (873) 555-4781 or jo@mail.example.com")
    root = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, 1, int(kinds[i] == "toxic")) for i in kinds if kinds[i] in ("plain", "toxic") and i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, kinds


def test_stages_decide_on_planted_cases(spark, corpus):
    root, docs, kinds = corpus
    kept = {k for k, kind in kinds.items() if kind in ("plain", "personal")}
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.read.parquet(f"{root}/documents.parquet")
    left = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, root)
        assert frame.columns == columns
        frame.cache()
        left.append(Counter(kinds[x["doc_id"]] for x in frame.select("doc_id").collect()))
    assert [c["toxic"] for c in left] == [0, 0, 0, 0]
    assert [c["copy"] for c in left] == [10, 0, 0, 0]
    assert [c["leak"] for c in left] == [10, 10, 0, 0]
    assert all(c["plain"] == 60 and c["personal"] == 5 for c in left)
    texts = {x["doc_id"]: x["text"] for x in frame.collect()}
    assert not any("4111111111111111" in t or "555-4781" in t or "jo@" in t for t in texts.values())
    assert all(texts[i] == docs[i][1] for i in kept if kinds[i] == "plain")
    plain = packing.Ids(tokenizer_path()).whole
    tokens = Counter()
    for x in corpus_pipeline.run(spark, root).collect():
        tokens[x["doc_id"]] += x["length"]
    assert tokens == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def test_stages_on_empty_tables(spark, corpus):
    root, *_ = corpus
    empty = spark.read.parquet(f"{root}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, root).count() == 0


def test_all_queries_are_registered():
    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n in QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in names if n != "pipeline") == list(range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "benchmark decontamination", "PII", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and KEY and toxicity and partenum and pseudonyms and ascii_words


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_run_over_a_whole_table(spark, name):
    """Each query on the smallest tables: a row per document or page where the contract says so."""
    root = "/root/testdata/sf0.001"
    got = QUERIES[name](spark, root)
    rows = got.count()
    size = {t: spark.read.parquet(f"{root}/{t}.parquet").count() for t in ("documents", "pages")}
    kind = int(name[2:].split("_")[0])
    if kind not in (1, 10, 11):  # these have rows by pair or piece
        assert rows == size["pages" if kind == 8 else "documents"]
    assert rows > 0


CLASHING = {"n_replaced": 7, "key": 8, "key_": 9, "copy": 10, "thinned": 11, "__new": 12, "__regions": 13, "__key": 14, "row": 15, "labels": 16, "component": 17, "cluster": 18}


def stages(spark, root, rows):
    """What every stage but the last returns for rows (doc_id, text), with columns of clashing names."""
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *CLASHING.values()) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, root)
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all([x[c] for c in CLASHING] == list(CLASHING.values()) for x in got), name
        yield name, sorted(((x.doc_id, x.text) for x in got), key=repr)


def test_rows_are_removed_not_ids(spark, corpus):
    r = random.Random(5)
    a, b, leak = prose(r, 60), prose(r, 60), corpus[1][80 + 32][1]
    rows = [(1, a), (2, a), (2, b), (2, b), (3, leak), (3, b + " more"), (None, a), (None, None), (4, ""), (4, ""), (5, None)]
    kept = dict(stages(spark, corpus[0], rows))
    near = kept["n-gram Jaccard join"]
    assert (1, a) in near and near.count((2, b)) == 1 and (2, a) not in near and (None, a) not in near
    assert near.count((4, "")) == 2 and (5, None) in near and (None, None) in near
    assert kept["toxicity"] == sorted(rows, key=repr) or len(kept["toxicity"]) <= len(rows)
    assert len(kept["PII"]) == len(rows)


def test_contaminated_rows_go_alone(spark, corpus):
    r = random.Random(6)
    item = spark.read.parquet(f"{corpus[0]}/benchmark.parquet").first().text
    clean = prose(r, 80)
    docs = spark.createDataFrame([(1, f"{clean} {item}"), (1, clean), (None, item), (None, clean)], "doc_id long, text string")
    got = corpus_pipeline.drop_contaminated(spark, docs, corpus[0]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, clean), (None, clean)], key=repr)


def test_empty_labels_and_benchmark(spark, corpus, tmp_path):
    _, docs, _ = corpus
    root = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    rows = [(d[0], d[1]) for d in docs[:20]]
    kept = dict(stages(spark, root, rows))
    assert len(kept["toxicity"]) == len(kept["benchmark decontamination"]) == 20
    assert dict(stages(spark, root, []))["n-gram Jaccard join"] == []
