"""The pipeline and its stages against a brute-force version of what each one decides."""

import itertools

import numpy as np
import pytest

import corpus_pipeline
from voxlake.llm import bpe, decontaminate, pii, quality

NAMES = ["doc_id", "text", "lang", "source", "n_chars", "key", "weight", "a.b", "__text", "c1"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, weight double, `a.b` int, __text string, c1 string"
MAIL = "ann.lee@mail3.example.com"


def prose(n, seed, vocabulary=300):
    r = np.random.default_rng(seed)
    return " ".join(f"{'aeiou'[r.integers(5)]}word{r.integers(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    rows = [(k, prose(80, k)) for k in range(300)]
    rows += [(1000 + k, prose(80, 0)) for k in range(40)] + [(1100 + k, prose(78, 1) + f" end{k} x") for k in range(6)]
    rows += [(2000 + k, prose(60, 500 + k) + " cheap pills now" * 5) for k in range(100)]
    items = [(k, prose(25, 900 + k)) for k in range(5)]
    rows += [(3000 + k, f"{prose(40, 700 + k)} {items[k % 5][1].upper() if k % 2 else items[k % 5][1]} {prose(9, 800 + k)}") for k in range(12)]
    rows += [(4000 + k, f"{prose(50, 600 + k)} {MAIL} {prose(9, 650 + k)}") for k in range(10)]
    rows += [(None, prose(30, 77)), (None, prose(30, 77)), (5000, None), (5001, ""), (5002, "x" * 20000), (5003, prose(30, 78)), (5003, prose(30, 78)), (5004, prose(30, 79)), (5004, prose(30, 80)), (None, prose(30, 80))]
    docs = [(i, t, "en", None, None if t is None else len(t), "k", 1.0, 1, "x", "y") for i, t in rows]
    labels = [(k, 1, 0) for k in [*range(300), *range(1000, 1040), *range(1100, 1106)] if k % 8 < 5] + [(k, 0, 0) for k in range(2000, 2100) if k % 8 < 5] + [(None, 1, 0), (1, None, None)]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), rows, items


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "byte_bpe"]


def test_each_stage_against_brute_force(spark, tables, tmp_path):
    sf, rows, items = tables
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, sf)
        assert out.columns[: len(NAMES)] == NAMES
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = kept[name] = docs.collect()
        ids = lambda x: sorted((-1 if r.doc_id is None else r.doc_id) for r in x)
        if name == "quality_classifier":
            chosen = quality.importance_resample(spark.createDataFrame(before, SCHEMA), spark.read.parquet(f"{sf}/labels.parquet")).where("is_selected").collect()
            assert ids(after) == ids(chosen)
            assert sum(2000 <= i < 2100 for i in ids(after)) <= 4 and sum(0 <= i < 300 for i in ids(after)) >= 288
        elif name == "minhash_near_dedup":
            sets = {(1 << 60 if r.doc_id is None else r.doc_id, r.text or ""): {tuple(w[k : k + 3]) for w in [(r.text or "").split()] for k in range(len(w) - 2)} for r in before}
            parent = {i: i for i in sets}

            def root(i):
                while parent[i] != i:
                    i = parent[i]
                return i

            for a, b in itertools.combinations(sorted(sets), 2):
                if sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
            assert ids(after) == sorted(-1 if i[0] == 1 << 60 else i[0] for i in parent if root(i) == i)
            assert ids(after).count(5004) == 2 and ids(after).count(5003) == 1 and ids(after).count(-1) == 1
        elif name == "benchmark_decontamination":
            clean = [r for r in before if r.text is None or not any(decontaminate.myers(decontaminate.normal(t), decontaminate.normal(r.text)) <= decontaminate.budget(decontaminate.normal(t)) for _, t in items)]
            assert ids(after) == ids(clean) and not any(3000 <= i < 3100 for i in ids(after))
        elif name == "pii":
            tagger = pii.Tagger(pii.weights())
            want = sorted(str(pii.redact(r.text, tagger.texts([r.text])[0]) if r.text is not None else None) for r in before)
            assert sorted(str(r.text) for r in after) == want and not any(MAIL in (r.text or "") for r in after)
            assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
        else:
            with open(bpe.VOCABULARY, "rb") as f:
                codec = bpe.codec(f.read())
            for r in after:
                assert r.text is None and r.tokens is None or r.round_trip and codec.decode(np.array(r.tokens, np.int64)).tobytes().decode() == r.text
            assert ids(after) == ids(before)
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(str, whole)) == sorted(map(str, kept["byte_bpe"]))


def test_empty_tables(spark, tables, tmp_path):
    sf, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() > 300
