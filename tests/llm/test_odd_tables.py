"""Every operator on one odd table: ids of any type, clashing and strange column names, nulls, long texts, repeats, no rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.llm import bpe, decontaminate, html_template, lm_score, metric_join, near_dedup, pii, quality, substring_dedup, warc

EXTRA = "`a.b` int, __text string, tokens int, id long, text2 string, c1 string, token string, key double, `class` string, gram long"


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join(f"w{r.integers(500)}" for _ in range(n))


ROWS = [(1, prose(80, 1)), (2, prose(80, 1)), (2, prose(80, 1)), (3, None), (None, prose(80, 2)), (None, None), (4, ""), (5, " \n\t"), (6, "x" * 30_000), (7, "word " * 20_000), (8, "é漢🎉 ½ " + prose(60, 3)), (9, prose(60, 3) + " " + prose(60, 4))]
KINDS = {"long": lambda k: k, "int": lambda k: k, "string": lambda k: f"doc-{k:03d}", "double": lambda k: k + 0.5}


def table(spark, kind, rows=ROWS):
    made = [(None if i is None else KINDS[kind](i), t, 1, "t", 2, 3, "u", "c", "tok", 0.5, "cl", 9) for i, t in rows]
    return spark.createDataFrame(made, f"doc_id {kind}, text string, {EXTRA}")


def labels(spark, docs):
    return docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).limit(3)


def items(spark, kind):
    return spark.createDataFrame([(KINDS[kind](1), prose(60, 3), 1), (None, None, 2), (KINDS[kind](2), "", 3)], f"item_id {kind}, text string, `x.y` int")


OPERATORS = {
    "op1": lambda s, d, k: substring_dedup.repeated_passages(d),
    "op2": lambda s, d, k: quality.importance_resample(d, labels(s, d)),
    "op2_rows": lambda s, d, k: quality.keep_selected(d, labels(s, d)),
    "op3": lambda s, d, k: near_dedup.near_duplicate_groups(d),
    "op4": lambda s, d, k: warc.derivatives(d.withColumns({"record_id": F.col("doc_id").cast("string"), "target_uri": F.lit(None), "date": F.lit(None), "http_headers": F.lit(""), "payload": F.col("text")}), keep="a.b"),
    "op5": lambda s, d, k: bpe.encode(d),
    "op5_back": lambda s, d, k: bpe.decode(bpe.encode(d), out_col="text"),
    "op6": lambda s, d, k: html_template.extract(d.withColumns({"page_id": F.col("doc_id"), "url": F.lit("http://h.example/"), "html": F.concat(F.lit("<p>"), "text")})),
    "op7": lambda s, d, k: pii.find_private(d),
    "op7_rows": lambda s, d, k: pii.without_private(d),
    "op8": lambda s, d, k: lm_score.lattice_scores(d),
    "op9": lambda s, d, k: metric_join.range_pairs(d.withColumns({"vec_id": F.col("doc_id"), "embedding": F.when(F.col("text").isNotNull(), F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")))})),
    "op10": lambda s, d, k: decontaminate.contaminated(d, items(s, k)),
    "op10_rows": lambda s, d, k: decontaminate.clean_documents(d, items(s, k)),
}
#: How many rows of a result there are for one of the table; None where it depends on the texts.
EACH = {"op2": 1, "op4": 2, "op5": 1, "op5_back": 1, "op6": 1, "op7": 1, "op7_rows": 1, "op8": 1}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_table(spark, name):
    results = {}
    for kind in ("long", "string"):
        d = table(spark, kind)
        got = OPERATORS[name](spark, d, kind).collect()
        results[kind] = got
        if name in EACH:
            assert len(got) == EACH[name] * len(ROWS)
        assert OPERATORS[name](spark, table(spark, kind, []), kind).collect() == []
    assert len(results["long"]) == len(results["string"])
    if name == "op1":
        assert {(r.doc_id, r.n_words) for r in results["string"]} >= {("doc-001", 80), ("doc-002", 80), ("doc-007", 20_000), ("doc-009", 60)}
        assert {(KINDS["string"](r.doc_id), r.start_word, r.n_words) for r in results["long"]} == {tuple(r) for r in results["string"]}
    if name == "op3":
        assert {tuple(r) for r in results["string"]} == {("doc-001", "doc-001", True), ("doc-002", "doc-001", False)} | {(KINDS["string"](r.doc_id), KINDS["string"](r.group_id), r.is_kept) for r in results["long"] if r.doc_id > 2}
    if name == "op9":
        assert {tuple(map(KINDS["string"], r)) for r in results["long"]} == {tuple(r) for r in results["string"]} and ("doc-001", "doc-002") in {tuple(r) for r in results["string"]}
    if name == "op10":
        assert {tuple(r) for r in results["string"]} == {("doc-008", "doc-001", 0), ("doc-009", "doc-001", 0)}
    if name in ("op5", "op7_rows", "op10_rows", "op2_rows"):
        assert {"a.b", "__text", "class"} <= set(results["string"][0].asDict())
    if name == "op5_back":
        assert sorted(str(r.text) for r in results["string"]) == sorted(str(t) for _, t in ROWS)


@pytest.mark.parametrize("kind", ["int", "double"])
def test_ids_keep_their_type(spark, kind):
    d = table(spark, kind)
    assert dict(substring_dedup.repeated_passages(d).dtypes)["doc_id"] == kind
    assert dict(near_dedup.near_duplicate_groups(d).dtypes)["group_id"] == kind
    assert {r.doc_id for r in near_dedup.near_duplicate_groups(d).collect()} >= {KINDS[kind](1), KINDS[kind](2)}


def test_long_units_are_scored_in_double_precision():
    v = lm_score.load()
    lattice = lm_score.Lattice(v)
    n = 30_000
    body = np.full(n + 1, ord("x"), np.uint32)
    body[0] = lm_score.SPACE
    got = float(lattice.marginals(body, np.array([n + 1]))[0])
    # the same sum in exact order, one character after another
    pieces = {}
    at = np.concatenate([[0], np.cumsum(v.size)])
    for k in np.flatnonzero(v.size):
        p = v.body[at[k] : at[k + 1]]
        if (p[0] in (lm_score.SPACE, ord("x"))) and (p[1:] == ord("x")).all():
            pieces[tuple(p.tolist())] = v.first[k]
    total = np.zeros(n + 2)
    total[1:] = -np.inf
    for j in range(1, n + 2):
        best = [total[j - len(p)] + s for p, s in pieces.items() if len(p) <= j and tuple(body[j - len(p) : j].tolist()) == p]
        total[j] = np.logaddexp.reduce(best) if best else -np.inf
    assert got == pytest.approx(total[n + 1], abs=1e-4)


def test_shares_of_a_bucket_meet(spark):
    rows = [(k, prose(40, 7) + f" end{k}") for k in range(40)] + [(100 + k, prose(40, 50 + k)) for k in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.group_id) for r in near_dedup.near_duplicate_groups(d, share=3).collect()}
    assert got == {(k, 0) for k in range(40)} == {(r.doc_id, r.group_id) for r in near_dedup.near_duplicate_groups(d).collect()}
