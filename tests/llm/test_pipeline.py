import pytest

import corpus_pipeline
from quillwing.llm import queries

from .test_dedup import removed_words
from .test_near_copies import kept_ids

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on its own input, at sf0.001: what goes, what stays, and that all columns come through."""
    docs = queries.documents(spark, SF)
    names = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "simhash_near_dedup", "substring_dedup", "packing"]

    one = corpus_pipeline.written(stages["language_id"](spark, docs, SF), "test")
    rows = {r.doc_id: r for r in docs.collect()}
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == names
    assert not [i for i in kept if not any(ch.isalpha() for ch in rows[i].text or "")]
    assert len(kept) >= 0.97 * sum(any(ch.isalpha() for ch in r.text or "") for r in rows.values())

    two = corpus_pipeline.written(stages["exact_dedup"](spark, one, SF), "test")
    best = {}
    for i in kept:
        best[rows[i].text] = max(best.get(rows[i].text, i), i)
    assert two.columns == names and sorted(r.doc_id for r in two.collect()) == sorted(best.values())

    three = corpus_pipeline.written(stages["simhash_near_dedup"](spark, two, SF), "test")
    assert three.columns == names and sorted(r.doc_id for r in three.collect()) == kept_ids([(i, rows[i].text) for i in best.values()])

    four = corpus_pipeline.written(stages["substring_dedup"](spark, three, SF), "test")
    before = {r.doc_id: r for r in three.collect()}
    after = {r.doc_id: r for r in four.collect()}
    assert four.columns == names and before.keys() == after.keys()
    for i, (w, gone) in removed_words([(i, r.text) for i, r in before.items()], 13).items():
        if any(gone):
            text = b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()
            assert after[i].text == text and after[i].n_chars == len(text)
        else:
            assert after[i] == before[i]

    five = stages["packing"](spark, four, SF)
    assert {r.doc_id for r in five.select("doc_id").distinct().collect()} == set(after)


def test_stages_take_odd_rows_and_empty_tables(spark, docs, odd_docs, no_docs):
    for table in (odd_docs, no_docs):
        left = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = corpus_pipeline.written(stage(spark, left, SF), "test")
            assert left.columns == table.columns, name
        assert corpus_pipeline.STAGES[-1][1](spark, left, SF).count() >= 0


def test_registered():
    names = queries.queries()
    assert [n.split("_")[0] for n in names] == [f"op{n}" for n in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", ["op2_chat_format", "op4_exact_dedup", "op7_substring_dedup"])
def test_sql_agrees(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF)
    order = sorted(want.columns)
    assert sorted(got.columns) == order
    rows = sorted(map(tuple, got.select(*order).collect()), key=repr)
    assert rows == sorted(want.project(", ".join(order)).fetchall(), key=repr)
