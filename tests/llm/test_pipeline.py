"""The pipeline's stages, and every query of the subpackage against its SQL or for its shape."""

import plain
import pytest
from oracle import compare, duck
from test_near_stage import near

import corpus_pipeline
from plumbline.llm import mixing, queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_matches_sql(spark, sf, name):
    ok, why, _ = compare(queries.Q[name](spark, sf), duck(sf), queries.SQL[name])
    assert ok, why


def test_queries_without_sql(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").collect()]
    got = queries.Q["op1_near_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got)) == sorted(plain.near(docs))
    for name, names, find in (("op4_pii", ("email", "ip", "card", "phone"), plain.personal),
                              ("op8_secret_scan", ("assign", "access", "hex"), lambda t: [(k, a, b) for a, k, b in plain.secrets(t)])):
        got = {r.doc_id: r for r in queries.Q[name](spark, sf).collect()}
        for i, t in docs:
            base = [f"{names[k]}:{a}:{b}" for k, a, b in find(t)]
            assert got[i].base_sha256 == plain.sha(",".join(base)) and set(base) <= set(got[i].spans.split(","))
            assert [got[i][f"n_{n}"] for n in names] == [sum(x.startswith(n) for x in base) for n in names]


def test_stages(spark, sf):
    docs = queries.table(spark, sf, "documents")
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf, "labels").collect()}
    bench = [(r.item_id, r.text) for r in queries.table(spark, sf, "benchmark").collect()]
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        given = [(r.doc_id, r.text) for r in docs.collect()]
        out = stage(spark, docs, sf)
        kept = {r.doc_id for r in out.collect()}
        if name == "quality":
            right = [(i in kept) == bool(labels[i]) for i, _ in given if i in labels]
            assert sum(right) >= 0.8 * len(right)  # some sixty labels to learn from
        elif name == "exact_dedup":
            assert kept == {i for i, _, _, keep, _ in plain.exact(given) if keep}
        elif name == "near_dedup":
            assert kept == {i for i, _, _, keep in near(given) if keep}  # five words, 0.80
        elif name == "decontamination":
            assert kept == {i for i, w, h, _ in plain.contaminated(given, bench) if not h or 20 * h < w}
        else:
            assert kept == {r.doc_id for r in mixing.mix_sizes(docs).filter("taken > 0").collect()}
        assert out.columns == (columns if n < len(corpus_pipeline.STAGES) - 1 else [*columns, "mix_repeats"])
        docs = out
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == kept and len(kept) > 100


def test_odd_rows(spark, sf):
    """Every stage takes nulls, repeated rows, clashing names and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _row string, id string, _k string, mix_repeats int"
    long = " ".join(f"w{k}" for k in range(300))
    rows = [(1, None, *"ab", 0, *"rik", 7), (None, "some words here", "a", None, 3, *"rik", 7), (2, "", *"ab", 0, *"rik", 7), (3, long, *"ab", 9, *"rik", 7),
            (3, long, *"ab", 9, *"rik", 7), (4, "y" * 50_000, *"ab", 1, *"rik", None)]
    for name, stage in corpus_pipeline.STAGES:
        for given in (rows, []):
            docs = spark.createDataFrame(given, schema)
            out = stage(spark, docs, sf)
            got = out.collect()
            assert out.columns == docs.columns, name
            ids = [r.doc_id for r in got]
            if name == "exact_dedup" and given:
                assert sorted(ids, key=str) == [1, 3, 4, None] or sorted(ids, key=str) == [2, 3, 4, None]
            elif name == "near_dedup" and given:
                assert sorted(ids, key=str) == [1, 2, 3, 3, 4, None]  # rows of the kept id stay
            elif name == "decontamination" and given:
                assert sorted(ids, key=str) == [1, 2, 3, 3, 4, None]
            elif name == "mixing":
                assert not {1, 2} & set(ids) and all(r.mix_repeats >= 1 for r in got)
            assert given or not got
