"""Each stage of the pipeline against a plain restatement on what it got."""

import corpus_pipeline
from spectrafold.llm import toxicity
from spectrafold.llm.common import materialize

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == columns
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if model.severity(t, {})[1] < 0.5}
        elif name == "near_duplicates":
            want = brute.near(list(before.items()), 5)
            assert after == {i: t for i, t in before.items() if want[i][1] == i}
        elif name == "repeats":
            want = brute.repeats(list(before.items()))
            assert all((after[i] == before[i]) == (want[i][1] == 0) for i in before)
        else:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            want = {i: brute.decontaminate(t, items) for i, t in before.items()}
            assert set(after) == {i for i in before if not want[i][4]}
            for i, t in after.items():
                assert t == before[i] if not want[i][1] else len(brute.TOKEN.findall(brute.lower(t))) == want[i][0] - want[i][1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(after)
    assert all(len(r.ids) == 4 * r.length for r in packed)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", None, "s", 5), (3, "a b c", None, "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    got = docs.collect()
    # seven ids are packed as 4 + 2 + 1, so a document may have several pieces
    assert {(r.doc_id or 0, r.doc_tokens) for r in got} == {(0, 1), (1, 1), (2, 1), (3, 4)}
    for doc, total in ((0, 1), (1, 1), (2, 1), (3, 4)):
        own = sorted((r.start, r.length) for r in got if (r.doc_id or 0) == doc)
        assert [s for s, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) == total


def test_empty_tables_clashing_columns_ties_and_long_texts(spark):
    """Every stage on an empty table, and on repeated rows, ids with two texts, a very long text
    and columns named as the stages' own are."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    none = spark.createDataFrame([], kinds)
    long = " ".join(f"w{i}" for i in range(120_000))
    rows = [(1, "one two three four five six", "en", "s", 0), (1, "one two three four five six", "en", "s", 0), (1, "quite another text of one id", "en", "s", 0), (2, long, "en", "s", 0), (3, None, "en", "s", 0), (None, "no id here at all", "en", "s", 0)]
    docs = spark.createDataFrame(rows, kinds).selectExpr("*", "1 as __k", "2 as __t", "3 as row", "4 as id", "5 as t", "6 as hits", "map('a', 1) as kept", "7 as `a.b`")
    for name, stage in corpus_pipeline.STAGES:
        none = materialize(stage(spark, none, SF), "none")
        assert none.collect() == []
        if name == "packing":
            break
        before = docs.columns
        docs = materialize(stage(spark, docs, SF), name)
        assert docs.columns == before
        got = docs.collect()
        assert sorted((r["doc_id"] or 0, r["text"]) for r in got if r["doc_id"] in (None, 2)) == [(0, "no id here at all"), (2, long)]
        # two texts under an id are two documents, of which repeated rows are one from the second stage on
        assert sum(r["doc_id"] == 1 for r in got) == (3 if name == "toxicity" else 2) and all(r["a.b"] == 7 for r in got)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == {None, 1, 2, 3}
