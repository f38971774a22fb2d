"""The pipeline's stages on small tables."""

import pytest

pipeline = pytest.importorskip("corpus_pipeline")

A = "This first document has a good number of ordinary words and it says something about the weather in the north of the country today.\nWrite to jane@corp.example about it, or call us, if there is anything else that you would like to know."
B = A.replace("north", "south") + "\nA line of its own that no other document has in it at all, as far as we know."
JUNK = "###$$$ %%% &&& *** <<< >>> ||| ### $$$ %%% &&& *** ###"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, A), (2, A), (3, B), (4, JUNK), (5, None), (6, ""), (7, "Something else entirely is written here, and it is long enough to be kept by every rule there is.")]
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, gone string")


def test_stages(spark, docs):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "near_dedup", "pii", "packing"]
    one = pipeline.quality_rules(spark, docs, "")
    assert tuple(one.columns) == pipeline.COLUMNS and {r["doc_id"] for r in one.collect()} == {1, 2, 3, 7}
    two = {r["doc_id"]: r for r in pipeline.line_dedup(spark, one, "").collect()}
    assert two[1]["text"] == A and 2 not in two and two[7]["n_chars"] == len(two[7]["text"])
    three = {r["doc_id"] for r in pipeline.near_dedup(spark, one, "").collect()}
    assert 1 in three and 2 not in three and 7 in three
    four = {r["doc_id"]: r["text"] for r in pipeline.pii(spark, one, "").collect()}
    assert "[EMAIL]" in four[1] and "jane@" not in four[1] and four[7].startswith("Something")
    five = pipeline.packing(spark, one, "").collect()
    assert {r["doc_id"] for r in five} == {1, 2, 3, 7} and all(r["length"] <= 1024 for r in five)


def test_rows_of_one_id_are_judged_apart(spark):
    """One row of a doc_id may go and another stay; a null doc_id goes where its group has an id."""
    rows = [(3, A), (5, A), (5, "Quite another text stands in this row of the same document, and nobody else has a text like it."), (None, A), (6, None), (7, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = [(r["doc_id"], (r["text"] or "")[:5]) for r in pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(kept, key=str) == sorted([(3, A[:5]), (5, "Quite"), (6, ""), (7, "")], key=str)


def test_odd_rows_in_every_stage(spark):
    """Null doc_ids, repeated rows, null, empty and very long texts."""
    long = " ".join(f"w{i} is a word" for i in range(30_000))
    rows = [(None, "A row without an id has a text of its own, and it is long enough to be kept by every rule."), (None, None), (1, A), (1, A), (2, ""), (3, long), (4, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in pipeline.STAGES:
        ids = [r["doc_id"] for r in stage(spark, docs, "").collect()]
        assert {1, 3} <= set(ids) and (name == "packing" or ids.count(1) == 2), name
        if name in ("pii", "packing"):
            assert set(ids) == {None, 1, 2, 3, 4}


def test_empty_tables(spark, docs):
    d = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, d.select(*pipeline.COLUMNS), "").count() == 0


def test_run(spark, sf):
    rows = pipeline.run(spark, sf).collect()
    assert rows and all(0 < r["length"] <= 1024 for r in rows)
