"""The behaviour of the engine on small tables."""

import math

import pytest

from quillsearch.functions import porter, romance, snowball
from quillsearch.functions.analysis import Analyzer, query_tokens, utf8_distance
from quillsearch.functions.stemming import stemmer
from quillsearch.operators.boolean import boolean_scores, parse, search_layered_bm25_query
from quillsearch.operators.index import FtsIndex
from quillsearch.operators.layered import layered_scores, search_layered_bm25
from quillsearch.operators.scoring import match_bm25, match_scores

PLAIN = {"stemmer": "none", "stopwords": "none"}


def got(df):
    return {r["name"]: r["score"] for r in df.collect()}


@pytest.fixture(scope="module")
def sounds(spark):
    rows = [("doc1", "QUÁCKING+QUÁCKING+QUÁCKING", "Hannes"), ("doc2", "BÁRKING+BÁRKING+BÁRKING+BÁRKING", "Mark"), ("doc3", "MÉOWING+MÉOWING+MÉOWING+MÉOWING+MÉOWING+999", "Laurens")]
    return spark.createDataFrame(rows, "id string, body string, author string")


def test_golden_scores(spark, sounds):
    index = FtsIndex.build(sounds, "id", "body")
    found = {r["id"]: r["score"] for r in match_bm25(index, sounds, "id", "quacked barked").collect()}
    assert found["doc3"] is None
    assert found["doc2"] == pytest.approx(0.7208701623069375, abs=1e-12)
    assert found["doc1"] == pytest.approx(0.7072688384898254, abs=1e-12)
    assert {r["term"]: r["df"] for r in index.dict.collect()} == {"quack": 1, "bark": 1, "meow": 1}


def test_fields_and_conjunction(sounds):
    index = FtsIndex.build(sounds, "id", "body", "author")
    assert set(got(match_scores(index, "hannes", fields="author"))) == {"doc1"}
    assert got(match_scores(index, "hannes", fields="body")) == {}
    assert got(match_scores(index, "hannes", fields="")) == {}
    assert set(got(match_scores(index, "hannes quacking", conjunctive=True))) == {"doc1"}
    assert got(match_scores(index, "hannes nothinglikeit", conjunctive=True)) == {}
    assert got(match_scores(index, None)) == {}
    assert set(got(match_scores(index, "the hannes quacking", conjunctive=True))) == {"doc1"}  # stopwords don't count


def test_star_takes_string_columns(spark):
    df = spark.createDataFrame([("a", 1, "xx yy")], "id string, n int, body string")
    assert FtsIndex.build(df, "id", "*", **PLAIN).fields == ("id", "body")


def test_zero_lengths_and_stats(spark):
    rows = [(1, "a b", "c d e"), (2, "x", "c"), (3, None, ""), (4, "b b", "c y z")]
    index = FtsIndex.build(spark.createDataFrame(rows, "id int, title string, body string"), "id", "title", "body", **PLAIN)
    assert {r["name"]: (r["len"], list(r["field_lens"])) for r in index.docs.collect()} == {1: (5, [2, 3]), 2: (2, [1, 1]), 3: (0, [0, 0]), 4: (5, [2, 3])}
    s = index.stats
    assert (s.num_docs, s.avg_field_lens, s.total_field_lens) == (4, (1.25, 1.75), (5, 7))


def test_empty_table_then_insert(spark):
    empty = spark.createDataFrame([], "id int, body string")
    index = FtsIndex.build(empty, "id", "body", incremental=True, **PLAIN)
    assert index.stats.num_docs == 0 and index.stats.avgdl is None
    assert got(match_scores(index, "hello")) == {}
    grown = index.insert(spark.createDataFrame([(1, "hello world")], "id int, body string"), "id")
    assert set(got(match_scores(grown, "hello"))) == {1}
    with pytest.raises(ValueError):
        grown.insert(spark.createDataFrame([(1, "again")], "id int, body string"), "id")
    gone = grown.delete(spark.createDataFrame([(1,)], "id int"))
    assert gone.stats.num_docs == 0 and gone.stats.total_len == 0
    assert index.stats.num_docs == 0  # a snapshot doesn't see what comes later


def test_incremental_is_as_rebuilt(spark):
    rows = [(i, f"w{i % 3} w{i % 5} common") for i in range(12)]
    schema = "id int, body string"
    live = FtsIndex.build(spark.createDataFrame(rows[:6], schema), "id", "body", incremental=True, **PLAIN)
    live = live.insert(spark.createDataFrame(rows[6:], schema), "id").delete(spark.createDataFrame([(2,), (7,), (99,)], "id int"))
    again = FtsIndex.build(spark.createDataFrame([r for r in rows if r[0] not in (2, 7)], schema), "id", "body", **PLAIN)
    assert got(match_scores(live, "w1 w4 common")) == pytest.approx(got(match_scores(again, "w1 w4 common")))


def test_ids_are_checked(spark):
    twice = spark.createDataFrame([(1, "a"), (1, "b")], "id int, body string")
    null = spark.createDataFrame([(None, "a")], "id int, body string")
    with pytest.raises(ValueError):
        FtsIndex.build(twice, "id", "body")
    with pytest.raises(ValueError):
        FtsIndex.build(null, "id", "body", incremental=True)
    with pytest.raises(ValueError, match="does not have a column named 'nope'"):
        FtsIndex.build(null, "id", "nope")
    with pytest.raises(ValueError, match="at least one column"):
        FtsIndex.build(null, "id")


@pytest.mark.parametrize(
    "options, message",
    [
        ({"scoring_model": "bm26"}, "scoring_model must be either bm25f or best_fields"),
        ({"tie_breaker": 2.0, "scoring_model": "best_fields"}, "tie_breaker must be finite and between 0 and 1"),
        ({"tie_breaker": 0.5}, "tie_breaker is only supported with best_fields scoring"),
        ({"b": math.nan}, "b must be finite and between 0 and 1"),
        ({"field_weights": {"body": -1}}, "field weight for body must be finite and non-negative"),
        ({"field_weights": {"nope": 1}}, "field_weights contains unknown field: nope"),
        ({"field_b": {"body": 1.5}}, "field b for body must be finite and between 0 and 1"),
        ({"field_b": {"nope": 0.5}}, "field_b contains unknown field: nope"),
    ],
)
def test_scoring_errors(sounds, options, message):
    with pytest.raises(ValueError, match=message):
        match_scores(FtsIndex.build(sounds, "id", "body"), "nothing", **options)


def test_one_field_models_agree(sounds):
    index = FtsIndex.build(sounds, "id", "body")
    assert got(match_scores(index, "quacking")) == pytest.approx(got(match_scores(index, "quacking", scoring_model="best_fields")))
    assert got(match_scores(index, "quacking", field_weights={"body": 0})) == {"doc1": 0.0}
    assert got(match_scores(index, "quacking", field_weights={"body": 0}, k=0.0)) == {"doc1": 0.0}


def test_layered(spark):
    rows = [(1, "quack"), (2, "quark"), (3, "the theme noisy"), (4, "blackbirds sing 12345"), (5, "other text")]
    index = FtsIndex.build(spark.createDataFrame(rows, "id int, body string"), "id", "body", ignore="[.,]+", **PLAIN)
    wide = {"max_df_ratio": 1.0}
    assert set(got(layered_scores(index, "quak", **wide))) == {1, 2}
    assert set(got(layered_scores(index, "bird", **wide))) == {4}
    assert got(layered_scores(index, "bird", enable_substring=False, enable_fuzzy=False, **wide)) == {}
    assert set(got(layered_scores(index, "black", **wide))) == {4}
    assert got(layered_scores(index, "1234", **wide)) == {} and set(got(layered_scores(index, "12345", **wide))) == {4}
    assert got(layered_scores(index, "qu", **wide)) == {}
    assert got(layered_scores(index, "quak", term_limit=None, **wide)) == {}
    assert len(got(layered_scores(index, "quak", term_limit=1, **wide))) == 1
    assert set(got(layered_scores(index, "qu", query_mode="autocomplete", **wide))) == {1, 2}
    assert got(layered_scores(index, "sing q", query_mode="autocomplete", **wide)) == {}
    with pytest.raises(ValueError, match="query_mode must be either standard or autocomplete"):
        layered_scores(index, "q", query_mode=None)
    ranks = search_layered_bm25(index, "quak", top_k=1, **wide).collect()
    assert [r["rank"] for r in ranks] == [1]


def test_shared_expansion_counts_twice(spark):
    rows = [(1, "banana"), (2, "zzz")]
    index = FtsIndex.build(spark.createDataFrame(rows, "id int, body string"), "id", "body", **PLAIN)
    one, two = got(layered_scores(index, "bananna", max_df_ratio=1.0))[1], got(layered_scores(index, "bananna bananaa", max_df_ratio=1.0))[1]
    tf = lambda n: n * 2.2 / (n + 1.2)
    assert two / one == pytest.approx(tf(2) / tf(1), rel=0.05)


def test_boolean(spark):
    rows = [(1, "red fox"), (2, "red dog"), (3, "blue fox"), (4, "green bird"), (5, "red fox bird")]
    index = FtsIndex.build(spark.createDataFrame(rows, "id int, body string"), "id", "body", **PLAIN)
    leaf = lambda q, **m: {"query": q, **m}
    ids = lambda tree: set(got(boolean_scores(index, tree)))
    assert ids({"must": [leaf("red")], "must_not": [leaf("bird")]}) == {1, 2}
    assert ids({"should": [leaf("red"), leaf("fox")], "minimum_should_match": 2}) == {1, 5}
    assert ids({"should": [leaf("red")], "minimum_should_match": 0}) == {1, 2, 3, 4, 5}
    assert ids({"must": [leaf("red", boost=0)]}) == {1, 2, 5}
    a, b = got(boolean_scores(index, {"should": [leaf("fox"), leaf("fox")]})), got(boolean_scores(index, leaf("fox")))
    assert a == pytest.approx({k: 2 * v for k, v in b.items()})
    c = got(boolean_scores(index, {"must": [leaf("fox", boost=3)], "boost": 2}))
    assert c == pytest.approx({k: 6 * v for k, v in b.items()})
    assert [r["rank"] for r in search_layered_bm25_query(index, leaf("fox"), top_k=2).collect()] == [1, 2]


@pytest.mark.parametrize(
    "query, message",
    [
        (None, "query must be a non-null JSON object"),
        ("[1]", "query must be a non-null JSON object"),
        ('{"query": "a", "must": []}', "query node cannot contain both query and Boolean clauses"),
        ('{"must": 1}', "must must be an array"),
        ('{"must": [1]}', "must entries must be JSON objects"),
        ('{"query": "a", "query": "b"}', "query node contains duplicate keys"),
        ('{"query": "a", "x": 1}', "query node contains unknown key: x"),
        ('{"query": 1}', "query leaf must contain a string query"),
        ('{"query": "a", "fields": []}', "fields must be a non-empty array of field names"),
        ('{"query": "a", "fields": ["a,b"]}', "fields entries must be non-empty strings"),
        ('{"query": "a", "fields": ["nope"]}', "fields contains unknown field: nope"),
        ('{"query": "a", "query_mode": "x"}', "query_mode must be either standard or autocomplete"),
        ('{"query": "a", "boost": null}', "boost must be finite and non-negative"),
        ('{"must_not": [{"query": "a"}]}', "Boolean group must contain at least one must or should clause"),
        ('{"should": [{"query": "a"}], "minimum_should_match": 2}', "minimum_should_match must be a non-negative integer"),
        ('{"should": [{"query": "a"}], "minimum_should_match": 0.5}', "minimum_should_match must be a non-negative integer"),
    ],
)
def test_boolean_errors(query, message):
    with pytest.raises(ValueError, match=message):
        parse(query, ("body",))


def test_boolean_limits():
    tree = {"must": [{"query": "a"}, {"query": "b"}]}
    with pytest.raises(ValueError, match="query exceeds max_leaf_clauses of 1"):
        parse(tree, ("body",), max_leaf_clauses=1)
    with pytest.raises(ValueError, match="query exceeds max_boolean_depth of 1"):
        parse({"must": [tree]}, ("body",), max_boolean_depth=1)
    with pytest.raises(ValueError, match="max_leaf_clauses must be NULL or a positive integer"):
        parse(tree, ("body",), max_leaf_clauses=1.5)
    assert parse({"must": [tree]}, ("body",), None, None).must


def test_porter_vectors():
    words = {"iiiiiiinformation": "iiiiiiinform", "": "", "connection": "connect", "an": "an", "🦆": "🦆", "information information": "information inform", "information ": "information ", "meowing": "meow"}
    words |= {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "sized": "size", "conditional": "condit", "sensibiliti": "sensibl", "controlling": "control", "adjustment": "adjust"}
    assert {w: porter.stem(w) for w in words} == words
    assert [snowball.english(w) for w in ("knightly", "generously", "skies", "running")] == ["knight", "generous", "sky", "run"]
    assert [snowball.german(w) for w in ("aufeinander", "häuser", "kategorischen")] == ["aufeinand", "haus", "kategor"]
    assert snowball.russian("какие") == snowball.russian("каких")
    assert [romance.italian(w) for w in ("abbandonerà", "pronunciamento", "propagare", "propriamente")] == ["abbandon", "pronunc", "propag", "propr"]
    assert [romance.portuguese(w) for w in ("boataria", "quilométricas", "química", "quinhão")] == ["boat", "quilométr", "químic", "quinhã"]
    assert [romance.dutch_porter(w) for w in ("lichaamszwakheid", "lichamelijkheden", "opglimpende")] == ["lichaamszwak", "licham", "opglimp"]
    assert [romance.romanian(w) for w in ("abruptă", "absența", "absenţa", "oceanele")] == ["abrupt", "absenț", "absenț", "ocean"]
    assert all(f(w) is not None for f in romance.STEMMERS.values() for w in ("", "a", "y", "é", "x" * 5000, "aa", "qu", "ie"))
    with pytest.raises(ValueError):
        stemmer("klingon")
    with pytest.raises(NotImplementedError):
        stemmer("yiddish")


def test_distance_over_bytes():
    assert (utf8_distance("é", "e"), utf8_distance("ca", "abc"), utf8_distance("ab", "ba"), utf8_distance("", "xy")) == (2, 2, 1, 2)


def test_tokenizers(spark):
    standard = Analyzer(tokenizer="standard", stemmer="none", stopwords="none")
    assert query_tokens(spark, standard, "Don't stop 3.14 foo_bar ЖЗ 漢字ひ カタカナ 🦆a") == ["don't", "stop", "3.14", "foo_bar", "жз", "漢", "字", "ひ", "カタカナ", "🦆", "a"]
    assert query_tokens(spark, Analyzer(stopwords="none"), "Ünï-code ß ﬁ x1y") == ["uni", "code", "ß", "ﬁ", "x", "y"]
    assert query_tokens(spark, Analyzer(stopwords="none", ignore="(\\.|[^a-z'])+"), "hans o'brien") == ["hans", "o'brien"]
    with pytest.raises(ValueError):
        Analyzer(tokenizer="nope")
    with pytest.raises(ValueError):
        Analyzer(tokenizer="standard", strip_accents=True)


def test_struct_columns_and_odd_names(spark):
    df = spark.sql("SELECT 1 AS id, named_struct('duck', 42) AS `odd name`, 'x' AS document")
    index = FtsIndex.build(df, "id", "odd name", "document", **PLAIN)
    assert set(got(match_scores(index, "duck"))) == {1}


def test_postings_are_counted_where_the_text_is(spark):
    rows = [(1, "Running runs", "ran the runner"), (2, "run running, runs", None), (None, "", "RUNS run"), (4, "of", "the")]
    df = spark.createDataFrame(rows, "id int, title string, body string")
    index = FtsIndex.build(df, "id", "title", "body")  # stemmed: tokens used to be joined with their stems, each row with its document's tokens
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert "Generate" not in index.forward._jdf.queryExecution().executedPlan().toString()
    want = {("run", "running", 1, 0, 1, 2), ("run", "runs", 1, 0, 1, 2), ("ran", "ran", 1, 1, 1, 2), ("runner", "runner", 1, 1, 1, 2), ("run", "run", 2, 0, 1, 3), ("run", "running", 2, 0, 1, 3), ("run", "runs", 2, 0, 1, 3), ("run", "runs", None, 1, 1, 2), ("run", "run", None, 1, 1, 2)}
    assert {tuple(r) for r in index.postings.select("term", "raw_term", "name", "fieldid", "tf", "flen").collect()} == want
    assert {r["term"]: r["df"] for r in index.dict.collect()} == {"run": 3, "ran": 1, "runner": 1}
    assert {(r["raw_term"], r["term"]): r["df"] for r in index.raw_dict.collect()} == {("running", "run"): 2, ("runs", "run"): 3, ("run", "run"): 2, ("ran", "ran"): 1, ("runner", "runner"): 1}
    assert {r["name"]: r["len"] for r in index.docs.collect()} == {1: 4, 2: 3, None: 2, 4: 0}


def test_blocks_hold_what_documents_hold(spark):
    from quillsearch.operators import inverting

    assert list(inverting.pieces([0, 3, 9, 0, 2, 2, 2], 5)) == [(0, 2), (2, 3), (3, 6), (6, 7)]
    rows = [(i, " ".join(f"w{'abc'[i % 3]}{'xyz'[j % 3]} runs" for j in range(i))) for i in range(30)]
    for language in ("none", "porter"):
        index = FtsIndex.build(spark.createDataFrame(rows, "id int, body string").repartition(3), "id", "body", stemmer=language, stopwords="none")
        every = ["term", "raw_term", "name", "fieldid", "tf", "flen"]
        blocks = inverting.from_blocks(inverting.inverted(index.forward)).select(*every)
        assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, index.postings.select(*every).collect()))
        assert {r["term"]: r["df"] for r in index.dict.collect()}["runs" if language == "none" else "run"] == 29


def test_a_batch_is_scored_where_the_documents_are(spark, monkeypatch):
    from quillsearch.operators import scoring

    words = "red blue green fox dog the of".split()
    rows = [(i, " ".join(words[j % 7] for j in range(i % 5, i)), None if i % 4 == 0 else " ".join(words[(i * j) % 7] for j in range(9))) for i in range(80)]
    index = FtsIndex.build(spark.createDataFrame(rows, "id int, title string, body string").repartition(3), "id", "title", "body", **PLAIN)
    asked = spark.createDataFrame([("a", "the red fox"), ("b", "of the dog dog"), ("c", "nothing"), ("d", None), ("e", "green")], "q string, words string")
    ways = [{"decimals": 6}, {"field_weights": {"title": 0}, "k": 0}, {"scoring_model": "best_fields", "tie_breaker": 0.3, "field_b": {"title": 0.2}, "field_weights": {"body": 2}}, {"fields": "title"}, {"fields": "title", "field_weights": {"title": 0}}, {"fields": ""}]
    found = []
    for most in (scoring.SENT, 0):
        monkeypatch.setattr(scoring, "SENT", most)
        found.append([[(*r[:2], pytest.approx(r["score"], abs=1e-9), r["rank"]) for r in sorted(scoring.match_batch(index, asked, "q", "words", top_k=7, **{"decimals": 9} | way).collect())] for way in ways])
        plan = scoring.match_batch(index, asked, "q", "words")._jdf.queryExecution().executedPlan().toString()
        assert ("Join" in plan) == (most == 0)  # before: a row for each document and query, always
    assert [len(x) for x in found[0]] == [21, 21, 21, 21, 21, 0]
    assert [[x[:2] + x[3:] for x in way] for way in found[0]] == [[x[:2] + x[3:] for x in way] for way in found[1]]
    assert [[x[2].expected for x in way] for way in found[0]] == [[x[2] for x in way] for way in found[1]]


def test_standard_tokens_of_any_length(spark):
    from pyspark.sql import functions as F

    from quillsearch.functions.analysis import STANDARD_TOKEN, STANDARD_TOKEN_PLAIN, tokenize_standard

    long = spark.range(1).select(tokenize_standard(F.repeat(F.lit("aéb"), 50_000)).alias("t")).first()["t"]  # before: a stack overflow
    assert [len(t) for t in long] == [150_000]
    marks = [chr(c) for c in (*range(0x500), *range(0x900, 0x980), *range(0x2000, 0x2070), *range(0x2300, 0x2400), *range(0x3000, 0x3110), 0x4E00, 0xFF70, 0x1F600)]
    rows = spark.createDataFrame([(f"a{c}b {c} {c}{c}'{c}._x1_{c}.é{c}",) for c in marks], "s string")
    both = rows.select(*(F.regexp_extract_all("s", F.lit(p), 0).alias(n) for n, p in (("fast", STANDARD_TOKEN), ("plain", STANDARD_TOKEN_PLAIN))))
    assert both.where("fast <> plain or (fast is null) <> (plain is null)").count() == 0


def test_texts_are_taken_apart_once(spark, tmp_path):
    from quillsearch.plans.queries import QUERIES

    spark.createDataFrame([(1, "red fox red"), (2, None), (3, "...")], "doc_id int, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, most in (("tokenize_standard", 1), ("tokenize_regex", 0)):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all") == most and plan.count("split(") == 1 - most  # before: three times
        assert {r["token"]: r["n"] for r in df.collect()} == {"red": 2, "fox": 1}
