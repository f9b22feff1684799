"""The registered queries of the engine, each with the SQL it is held against where stock SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.analysis import Analyzer, damerau, tokenize_standard
from ..functions.stemming import stem
from ..operators import boolean, layered, scoring
from ..operators.index import FtsIndex
from ..operators.numbering import checkpoint_folder
from ..sources.store import IndexStore
from ..sources.tables import table
from . import oracle as o
from .surface import register_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PART = ("p_name", "p_type", "p_brand")
#: Words of the test texts.
ONE, TWO, THREE = "ention", "inging", "erreth"
STOP = ("the", "and", "of", "la", "der")


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


PLAIN = {"stemmer": "none", "stopwords": "none"}
_STORES: dict[tuple, IndexStore] = {}


def fresh(spark: SparkSession, d: str, **options) -> FtsIndex:
    """Texts without stemming, so that SQL can follow; a lazy index. The ids of the tables are keys."""
    return FtsIndex.build(table(spark, d, "documents"), "doc_id", "text", check_ids=False, **PLAIN | options)


def stored(spark: SparkSession, d: str, name: str, id_column: str, *fields: str, **options) -> FtsIndex:
    """The stored index of a table, built by the first query of the session that asks for it."""
    df = table(spark, d, name)
    key = (spark.sparkContext.applicationId, tuple(sorted(df.inputFiles())), fields, tuple(sorted(options.items())))
    if key not in _STORES:
        store = new_store(spark)
        store.build(df, id_column, *fields, check_ids=False, **PLAIN | options)
        _STORES[key] = store
    return _STORES[key].load()


def new_store(spark: SparkSession) -> IndexStore:
    return IndexStore(spark, f"{checkpoint_folder(spark)}/fts-{uuid.uuid4()}")


def documents(spark: SparkSession, d: str, **options) -> FtsIndex:
    return stored(spark, d, "documents", "doc_id", "text", **options)


def parts(spark: SparkSession, d: str, **options) -> FtsIndex:
    return stored(spark, d, "part", "p_partkey", *PART, **options)


def _docs(**more) -> str:
    return "WITH " + o.base("documents", "doc_id", ["text"], **more)


def _parts(**more) -> str:
    return "WITH " + o.base("part", "p_partkey", PART, **more)


def rounded(found: DataFrame) -> DataFrame:
    return found.select("name", F.round("score", 6).alias("score"))


def top(found: DataFrame, k: int | None = 50) -> DataFrame:
    return scoring.ranked(rounded(found), k)


# Analysis: how often each token occurs in the whole table.


def _counted(spark: SparkSession, d: str, tokens: Column) -> DataFrame:
    """By the outer form of explode: the other has a filter that takes each text apart twice more."""
    return table(spark, d, "documents").select(F.explode_outer(tokens).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("n"))


def _counts(spark: SparkSession, d: str, analyzer: Analyzer) -> DataFrame:
    return _counted(spark, d, analyzer.tokens(F.col("text")))


def _token_query(name: str, analyzer: Analyzer, **sql) -> None:
    register(name, _docs(**sql) + " SELECT term AS token, count(*) AS n FROM tok GROUP BY term")(lambda spark, d: _counts(spark, d, analyzer))


_token_query("tokenize_regex", Analyzer(stemmer="none", stopwords="none"))
_token_query("tokenize_custom_ignore", Analyzer(stemmer="none", stopwords="none", ignore="[aeiou.,]+"), ignore="[aeiou.,]+")
_token_query("strip_accents_off", Analyzer(stemmer="none", stopwords="none", strip_accents=False), strip=False)
_token_query("stopword_filter_english", Analyzer(stemmer="none"), stop=o.english())
_token_query("stopword_filter_custom", Analyzer(stemmer="none", stopwords=STOP), stop=STOP)


@register("tokenize_standard", "SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{Nd}](?:[\\p{L}\\p{Nd}\\p{M}]|[''’._][\\p{L}\\p{Nd}\\p{M}])*')) AS token FROM documents) GROUP BY token")
def tokenize_standard_query(spark: SparkSession, d: str) -> DataFrame:
    return _counted(spark, d, tokenize_standard(F.col("text")))


@register("damerau_distance", "SELECT a.n_name AS a, b.n_name AS b, damerau_levenshtein(a.n_name, b.n_name) AS distance FROM nation a CROSS JOIN nation b")
def damerau_query(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_name")
    pairs = n.withColumnRenamed("n_name", "a").crossJoin(n.withColumnRenamed("n_name", "b"))
    return pairs.select("a", "b", damerau(F.col("a"), F.col("b")).alias("distance"))


@register("stem_porter")
def stem_query(spark: SparkSession, d: str) -> DataFrame:
    words = _counts(spark, d, Analyzer(stemmer="none"))
    return words.select("token", stem(F.col("token"), "porter").alias("stem"))


# The index's tables.


@register("index_docs", _docs() + " SELECT name AS doc_id, len FROM docs")
def index_docs(spark, d):
    return fresh(spark, d).docs.select(F.col("name").alias("doc_id"), "len")


@register("index_field_lens", _parts() + " SELECT name AS p_partkey, f0, f1, f2 FROM docs")
def index_field_lens(spark, d):
    return parts(spark, d).docs.select(F.col("name").alias("p_partkey"), *(F.col("field_lens")[i].alias(f"f{i}") for i in range(3)))


@register("index_dict_df", _docs() + " SELECT term, df FROM dict")
def index_dict(spark, d):
    return fresh(spark, d).dict


@register("index_terms_tf", _docs() + " SELECT term, name AS doc_id, fieldid::INTEGER AS fieldid, count(*) AS tf FROM tok GROUP BY ALL")
def index_terms(spark, d):
    return fresh(spark, d).postings.select("term", F.col("name").alias("doc_id"), "fieldid", "tf")


@register("index_stats", _parts() + " SELECT n AS num_docs, round(avgdl, 6) AS avgdl, round(a0, 6) AS a0, round(a1, 6) AS a1, round(a2, 6) AS a2, t AS total_len, t0, t1, t2 FROM st")
def index_stats(spark, d):
    s = parts(spark, d).stats_table()
    means = (F.round(F.col("avg_field_lens")[i], 6).alias(f"a{i}") for i in range(3))
    return s.select("num_docs", F.round("avgdl", 6).alias("avgdl"), *means, "total_len", *(F.col("total_field_lens")[i].alias(f"t{i}") for i in range(3)))


@register("index_raw_dict", _docs() + " SELECT term AS raw_term, term, df FROM dict")
def index_raw_dict(spark, d):
    return fresh(spark, d).raw_dict


@register("index_term_stats", _docs() + " SELECT term, df, length(term) AS term_len, greatest(length(term) - 2, 0) AS gram_count FROM dict")
def index_term_stats(spark, d):
    return fresh(spark, d).term_stats()


@register("index_term_grams", _docs() + " SELECT g AS gram, term FROM (SELECT term, unnest(list_transform(range(1, length(term) - 1), lambda i: substr(term, i::INTEGER, 3))) AS g FROM dict WHERE length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+'))")
def index_term_grams(spark, d):
    return fresh(spark, d).term_grams().select("gram", "term")


@register("index_term_prefixes", _docs() + " SELECT 2 AS prefix_len, substr(term, 1, 2) AS prefix, term AS raw_term FROM dict WHERE length(term) >= 2 UNION ALL SELECT 3, substr(term, 1, 3), term FROM dict WHERE length(term) >= 3")
def index_term_prefixes(spark, d):
    return fresh(spark, d).term_prefixes().select("prefix_len", "prefix", "raw_term")


@register("index_build", _docs() + " SELECT name AS doc_id, len, row_number() OVER (ORDER BY name) - 1 AS docid FROM docs")
def index_build(spark, d):
    """A stored index with all its tables, built anew; documents are numbered in the order of their names."""
    index = new_store(spark).build(table(spark, d, "documents"), "doc_id", "text", **PLAIN)
    return index.docs.select(F.col("name").alias("doc_id"), "len", "docid")


@register("index_term_ids", _docs() + " SELECT term, df, row_number() OVER (ORDER BY term) - 1 AS termid FROM dict")
def index_term_ids(spark, d):
    return documents(spark, d).dict.select("term", "df", "termid")


@register("index_stored_grams", _docs() + " SELECT g AS gram, term, df, length(term) AS term_len FROM (SELECT term, df, unnest(list_transform(range(1, length(term) - 1), lambda i: substr(term, i::INTEGER, 3))) AS g FROM dict WHERE length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+'))")
def index_stored_grams(spark, d):
    return documents(spark, d).term_grams().select("gram", "term", "df", F.col("term_len").cast("long"))


# BM25, BM25F and best fields.


def _match(name: str, query: str, terms: list[str], score: str, spark_options: dict, stop=()) -> None:
    sql = _docs(stop=stop) + ", " + o.exact(terms) + ", " + score + " SELECT name AS doc_id, round(score, 6) AS score FROM found"
    index = {"stopwords": "english"} if stop else {}
    register(name, sql)(lambda spark, d: rounded(scoring.match_scores(documents(spark, d, **index), query, **spark_options)).withColumnRenamed("name", "doc_id"))


_match("match_bm25_basic", f"the {ONE} of {TWO}", [ONE, TWO], o.score(1), {}, stop=o.english())
_match("match_bm25_conjunctive", f"{ONE} of {TWO}", [ONE, "of", TWO], o.score(1, needed=3), {"conjunctive": True})
_match("match_bm25_k_b", f"{ONE}, {THREE}!", [ONE, THREE], o.score(1, k=2.0, b=0.3), {"k": 2.0, "b": 0.3})


@register("match_bm25_rows", _docs() + ", " + o.exact([TWO]) + ", " + o.score(1) + " SELECT d.doc_id, d.lang, round(f.score, 6) AS score FROM documents d LEFT JOIN found f ON f.name = d.doc_id")
def match_rows(spark, d):
    docs = table(spark, d, "documents")
    return scoring.match_bm25(documents(spark, d), docs, "doc_id", TWO).select("doc_id", "lang", F.round("score", 6).alias("score"))


def _part_match(name: str, query: str, terms: list[str], score: str, options: dict) -> None:
    register(name, _parts() + ", " + o.exact(terms) + ", " + score + " SELECT name AS p_partkey, round(score, 6) AS score FROM found")(
        lambda spark, d: rounded(scoring.match_scores(parts(spark, d), query, **options)).withColumnRenamed("name", "p_partkey")
    )


_SMALL = ["small", "large", "brand"]
_part_match("match_bm25_fields", "small large brand", _SMALL, o.score(3, fields=[0, 1]), {"fields": "p_name, p_type, nothing"})
_part_match("match_bm25f_weights", "small large brand", _SMALL, o.score(3, weights=[4.0, 1.0, 0.5]), {"field_weights": {"p_name": 4, "p_brand": 0.5}})
_part_match("match_bm25f_field_b", "small large brand", _SMALL, o.score(3, b=[0.2, 0.9, 0.75]), {"field_b": {"p_name": 0.2, "p_type": 0.9}})
_part_match("match_best_fields_tie", "small large", _SMALL[:2], o.score(3, model="best_fields", tie=0.1, b=[0.2, 0.75, 0.75], weights=[2.0, 1.0, 1.0]), {"scoring_model": "best_fields", "tie_breaker": 0.1, "field_b": {"p_name": 0.2}, "field_weights": {"p_name": 2}})


@register("match_bm25_stemmed")
def match_stemmed(spark, d):
    return rounded(scoring.match_scores(documents(spark, d, stemmer="porter", stopwords="english"), f"{ONE}s {TWO}")).withColumnRenamed("name", "doc_id")


# Layered search.


def _layered(name: str, query: str, terms: list[str], options: dict, **sql) -> None:
    k = options.get("top_k", 50)
    register(name, _docs() + ", " + o.expansion(terms, **sql) + ", " + o.score(1) + " " + o.ranked(k))(
        lambda spark, d: top(layered.layered_scores(documents(spark, d), query, **{x: y for x, y in options.items() if x != "top_k"}), k)
    )


_OFF = {"enable_prefix": False, "enable_substring": False, "enable_fuzzy": False, "enable_short_fuzzy": False}
_NONE = {"prefix": False, "substring": False, "fuzzy": False, "short": False}
_layered("layered_exact", f"{ONE} {TWO}", [ONE, TWO], {})
_layered("layered_prefix", "thtion", ["thtion"], _OFF | {"enable_prefix": True, "expand_exact_terms": True}, **_NONE | {"prefix": True}, expand_exact=True)
_layered("layered_substring", "ingtion", ["ingtion"], _OFF | {"enable_substring": True, "expand_exact_terms": True}, **_NONE | {"substring": True}, expand_exact=True)
_layered("layered_fuzzy", "erretth intionn", ["erretth", "intionn"], {"enable_short_fuzzy": False}, short=False)
_layered("layered_short_fuzzy", "tionx zaing", ["tionx", "zaing"], {"enable_prefix": False, "enable_substring": False, "max_df_ratio": 1.0}, prefix=False, substring=False, ratio=1.0)
_layered("layered_expand_exact", f"{TWO} {ONE} entions", [TWO, ONE, "entions"], {"expand_exact_terms": True}, expand_exact=True)
_layered("layered_term_limit", "heblex", ["heblex"], {"term_limit": 3}, limit=3)
_layered("layered_df_cap", "entionx", ["entionx"], {"max_df_ratio": 0.02, "max_df": 40}, ratio=0.02, max_df=40)
_layered("layered_unlimited", f"{THREE}x", [f"{THREE}x"], {"top_k": None})


@register("layered_scalar", _docs() + ", " + o.expansion(["erretthx"]) + ", " + o.score(1) + " SELECT d.doc_id, round(f.score, 6) AS score FROM documents d LEFT JOIN found f ON f.name = d.doc_id")
def layered_rows(spark, d):
    return layered.match_layered_bm25(documents(spark, d), table(spark, d, "documents"), "doc_id", "erretthx").select("doc_id", F.round("score", 6).alias("score"))


def _complete(name: str, query: str, words: list[str], last: str) -> None:
    register(name, _docs() + ", " + o.completion(words, last) + ", " + o.score(1) + " " + o.ranked())(
        lambda spark, d: top(layered.layered_scores(documents(spark, d), query, query_mode="autocomplete"))
    )


_complete("autocomplete_2char", "zu", [], "zu")
_complete("autocomplete_3char", f"{ONE} int", [ONE], "int")
_complete("autocomplete_long", "erreth", [], "erreth")


# Boolean trees, over the fields of part.


def _boolean(name: str, tree: dict, leaves: dict[str, str], result: str, **options) -> None:
    """leaves: the terms of each leaf's CTE. result: SQL of (name, score)."""
    sql = _parts()
    for leaf, terms in leaves.items():
        sql += ", " + o.exact(terms.split(), f"{leaf}_pick") + ", " + o.score(3, fields=options.get("only", {}).get(leaf), pick=f"{leaf}_pick", name=leaf)
    sql += f", found AS ({result}) " + o.ranked()
    register(name, sql)(lambda spark, d: top(boolean.boolean_scores(parts(spark, d), tree, **_OFF)))


_leaf = lambda q, **more: {"query": q, **more}
_boolean("boolean_leaf", _leaf("small widget"), {"a": "small widget"}, "SELECT * FROM a")
_boolean("boolean_must_should", {"must": [_leaf("widget")], "should": [_leaf("promo")]}, {"a": "widget", "b": "promo"}, "SELECT a.name, a.score + coalesce(b.score, 0) AS score FROM a LEFT JOIN b USING (name)")
_boolean("boolean_must_not", {"must": [_leaf("gear")], "must_not": [_leaf("red"), _leaf("economy")]}, {"a": "gear", "b": "red", "c": "economy"}, "SELECT * FROM a WHERE name NOT IN (SELECT name FROM b UNION ALL SELECT name FROM c)")
_boolean(
    "boolean_min_should",
    {"should": [_leaf("blue"), _leaf("bolt"), _leaf("standard")], "minimum_should_match": 2},
    {"a": "blue", "b": "bolt", "c": "standard"},
    "SELECT name, sum(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c) GROUP BY name HAVING count(*) >= 2",
)
_boolean(
    "boolean_nested",
    {"must": [_leaf("small", fields=["p_name"]), {"should": [_leaf("ring"), {"must": [_leaf("rod")], "must_not": [_leaf("large")]}]}]},
    {"a": "small", "b": "ring", "c": "rod", "e": "large"},
    "SELECT a.name, a.score + coalesce(b.score, 0) + coalesce(g.score, 0) AS score FROM a LEFT JOIN b USING (name) LEFT JOIN (SELECT * FROM c WHERE name NOT IN (SELECT name FROM e)) g USING (name) WHERE b.score IS NOT NULL OR g.score IS NOT NULL",
    only={"a": [0]},
)
_boolean("boolean_universe", {"should": [_leaf("anvil", boost=2)], "minimum_should_match": 0}, {"a": "anvil"}, "SELECT d.name, coalesce(2 * a.score, 0) AS score FROM docs d LEFT JOIN a USING (name)")
_boolean(
    "boolean_boosts",
    {"must": [_leaf("plate", boost=1.5)], "should": [{"should": [_leaf("hot", boost=0.5), _leaf("cold")], "boost": 3}], "boost": 2},
    {"a": "plate", "b": "hot", "c": "cold"},
    "SELECT a.name, 2 * (1.5 * a.score + 3 * (0.5 * coalesce(b.score, 0) + coalesce(c.score, 0))) AS score FROM a LEFT JOIN b USING (name) LEFT JOIN c USING (name)",
)


@register("boolean_rows", _parts() + ", " + o.exact(["ring"]) + ", " + o.score(3) + " SELECT p.p_partkey, round(f.score, 6) AS score FROM part p LEFT JOIN found f ON f.name = p.p_partkey")
def boolean_rows(spark, d):
    return boolean.match_layered_bm25_query(parts(spark, d), table(spark, d, "part"), "p_partkey", _leaf("ring"), **_OFF).select("p_partkey", F.round("score", 6).alias("score"))


# Maintenance: the whole table is indexed, in two steps.


def _split(spark, d, lang: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    return docs.where(F.col("lang") != lang), docs.where(F.col("lang") == lang)


def _maintained(first: DataFrame) -> IndexStore:
    store = new_store(first.sparkSession)
    store.build(first, "doc_id", "text", incremental=True, **PLAIN)
    return store


def _query(index: FtsIndex) -> DataFrame:
    return rounded(scoring.match_scores(index, f"{ONE} {TWO} enlich")).withColumnRenamed("name", "doc_id")


_ASKED = ", " + o.exact([ONE, TWO, "enlich"]) + ", " + o.score(1) + " SELECT name AS doc_id, round(score, 6) AS score FROM found"


@register("incremental_insert", _docs() + _ASKED)
def incremental_insert(spark, d):
    first, later = _split(spark, d, "de")
    return _query(_maintained(first).insert(later, "doc_id"))


@register("incremental_delete", _docs(source="SELECT * FROM documents WHERE lang <> 'fr'") + _ASKED)
def incremental_delete(spark, d):
    _, gone = _split(spark, d, "fr")
    return _query(_maintained(table(spark, d, "documents")).delete(gone.select("doc_id")))


@register("incremental_update", _docs(source="SELECT doc_id, CASE WHEN lang = 'de' THEN text || ' ention ention' ELSE text END AS text FROM documents") + _ASKED)
def incremental_update(spark, d):
    _, some = _split(spark, d, "de")
    return _query(_maintained(table(spark, d, "documents")).update(some.withColumn("text", F.concat("text", F.lit(" ention ention"))), "doc_id"))


def _both(spark, d, lang: str) -> FtsIndex:
    """Documents of a language are inserted later, those of French deleted."""
    first, later = _split(spark, d, lang)
    store = _maintained(first)
    store.insert(later, "doc_id")
    return store.delete(table(spark, d, "documents").where("lang = 'fr'").select("doc_id"))


_LEFT = {"source": "SELECT * FROM documents WHERE lang <> 'fr'"}


@register("incremental_layered", _docs(**_LEFT) + ", " + o.expansion(["erretth", "intionn"], short=False) + ", " + o.score(1) + " " + o.ranked())
def incremental_layered(spark, d):
    return top(layered.layered_scores(_both(spark, d, "de"), "erretth intionn", enable_short_fuzzy=False))


@register("incremental_autocomplete", _docs(**_LEFT) + ", " + o.completion([ONE], "int") + ", " + o.score(1) + " " + o.ranked())
def incremental_autocomplete(spark, d):
    return top(layered.layered_scores(_both(spark, d, "de"), f"{ONE} int", query_mode="autocomplete"))


@register("incremental_dict", _docs(**_LEFT) + " SELECT term, df FROM dict")
def incremental_dict(spark, d):
    return _both(spark, d, "de").dict.select("term", "df")


@register("incremental_compacted", _docs(**_LEFT) + ", " + o.expansion(["ingtion"], prefix=False, fuzzy=False, short=False, expand_exact=True) + ", " + o.score(1) + " " + o.ranked())
def incremental_compacted(spark, d):
    first, later = _split(spark, d, "fr")
    store = _maintained(table(spark, d, "documents"))
    store.delete(later.select("doc_id"))
    return top(layered.layered_scores(store.compact(), "ingtion", **_OFF | {"enable_substring": True, "expand_exact_terms": True}))


# Many queries at once, and SQL.


@register("batch_match_bm25", _docs() + ", " + o.batch("benchmark", "item_id", "text", 10))
def batch_match(spark, d):
    return scoring.match_batch(documents(spark, d), table(spark, d, "benchmark"), "item_id", "text", top_k=10, decimals=6)


@register("sql_match_bm25", _docs() + ", " + o.exact([ONE, TWO]) + ", " + o.score(1) + " SELECT name AS doc_id, round(score, 6) AS score FROM found")
def sql_match(spark, d):
    register_index(documents(spark, d), "corpus")
    return spark.sql(f"SELECT docname AS doc_id, round(score, 6) AS score FROM corpus_match_bm25('{ONE}, {TWO}!')")
