"""Stored indexes, streams and the SQL surface."""

import pytest

from quillsearch.operators.scoring import match_scores
from quillsearch.plans.surface import register_functions, register_index
from quillsearch.sources.store import IndexStore
from quillsearch.streaming.maintain import apply, maintain

SCHEMA = "id int, body string"


def ids(index, query):
    return {r["name"] for r in match_scores(index, query).collect()}


def test_versions(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    with pytest.raises(ValueError, match="does not exist"):
        store.load()
    store.build(spark.createDataFrame([(1, "red fox"), (2, "blue fox")], SCHEMA), "id", "body", stemmer="none", stopwords=("the",), incremental=True)
    with pytest.raises(ValueError, match="already exists"):
        store.build(spark.createDataFrame([(1, "x")], SCHEMA), "id", "body")
    old = store.load()
    store.insert(spark.createDataFrame([(3, "green fox")], SCHEMA), "id")
    store.delete(spark.createDataFrame([(1,), (9,)], "id int"))
    new = store.update(spark.createDataFrame([(2, "blue dog")], SCHEMA), "id")
    assert ids(new, "fox") == {3} and ids(new, "dog") == {2} and new.stats.num_docs == 2
    assert ids(old, "fox") == {1, 2}
    with pytest.raises(ValueError, match="in the index already"):
        store.insert(spark.createDataFrame([(3, "again")], SCHEMA), "id")
    before = {r["name"]: r["score"] for r in match_scores(new, "fox dog").collect()}
    assert {r["name"]: r["score"] for r in match_scores(store.compact(), "fox dog").collect()} == pytest.approx(before)
    store.vacuum()
    assert ids(store.load(), "dog") == {2} and store.load().analyzer.stopwords == ("the",)
    store.drop()
    assert not store.exists()


def test_stream(spark, tmp_path):
    store = IndexStore(spark, str(tmp_path / "index"))
    store.build(spark.createDataFrame([(1, "red fox"), (5, "old")], SCHEMA), "id", "body", stemmer="none", stopwords="none", incremental=True)
    rows = [(2, "blue fox", False, 1), (1, "red dog", False, 1), (5, "", True, 2), (None, "nobody", False, 1), (2, "blue bird", False, 2)]
    spark.createDataFrame(rows, "id int, body string, gone boolean, at int").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, body string, gone boolean, at int").parquet(str(tmp_path / "in"))
    maintain(stream, store, "id", str(tmp_path / "checkpoint"), deleted="gone", order="at").awaitTermination(120)
    live = store.load()
    assert (ids(live, "fox"), ids(live, "dog"), ids(live, "bird"), live.stats.num_docs) == (set(), {1}, {2}, 2)
    apply(store, spark.createDataFrame([(1, "red dog")], SCHEMA), "id")  # the same rows again
    assert ids(store.load(), "dog") == {1} and store.load().stats.num_docs == 2


def test_sql_surface(spark):
    from quillsearch.operators.index import FtsIndex

    register_functions(spark)
    row = spark.sql("SELECT stem('connection', 'porter') AS a, stem(NULL, 'porter') AS b, stem('Running', 'none') AS c, fts_tokenize_standard('It''s 漢字 ok') AS d").first()
    assert (row["a"], row["b"], row["c"], row["d"]) == ("connect", None, "Running", ["It's", "漢", "字", "ok"])
    register_index(FtsIndex.build(spark.createDataFrame([(1, "red red fox")], SCHEMA), "id", "body", stemmer="none", stopwords="none"), "t")
    assert spark.sql("SELECT count(*) AS n FROM t_terms WHERE term = 'red'").first()["n"] == 2
    assert {(r["prefix_len"], r["prefix"]) for r in spark.sql("SELECT * FROM t_term_prefixes").collect()} == {(2, "re"), (3, "red"), (2, "fo"), (3, "fox")}


def test_a_segment_moves_no_single_postings(spark, tmp_path):
    """What is shuffled and counted are blocks of postings: few rows for many documents that have the same words."""
    store = IndexStore(spark, str(tmp_path / "index"))
    rows = [(i, "red fox runs running") for i in range(500)]
    store.build(spark.createDataFrame(rows, SCHEMA).coalesce(1), "id", "body", stopwords="none", incremental=True)
    folder = store.manifest().steps[0][1]
    assert spark.read.parquet(f"{store.path}/{folder}/postings").count() == 4  # before: 2000
    index = store.delete(spark.createDataFrame([(i,) for i in range(100)], "id int"))
    assert {r["term"]: r["df"] for r in index.dict.collect()} == {"red": 400, "fox": 400, "run": 400}
    assert {r["raw_term"]: r["df"] for r in index.raw_dict.collect()} == {"red": 400, "fox": 400, "runs": 400, "running": 400}
    assert index.postings.count() == 1600 and store.compact().postings.count() == 1600
