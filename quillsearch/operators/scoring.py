"""Ranking: BM25, BM25F and best-fields scores of selected terms."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stemming import stem
from .index import FtsIndex
from .matching import best_candidates
from .numbering import numbered

#: Terms up to which a search is a list in the filter that reaches the scan of the postings.
LISTED = 1000
#: Terms of all queries together up to which a batch of them is sent to where the documents are; more are joined with the postings.
SENT = 200_000

_SELECTED = "leaf int, term string, raw string, fieldid int, x double, m bigint, idf double, w double, c double, d double"


def _finite(x) -> bool:
    return x is not None and not isinstance(x, bool) and math.isfinite(x)


@dataclass(frozen=True)
class Scoring:
    """k and b; weights and b of single fields; 'bm25f' or 'best_fields', the latter with a tie breaker."""

    k: float = 1.2
    b: float = 0.75
    field_weights: Mapping[str, float] | None = None
    field_b: Mapping[str, float] | None = None
    scoring_model: str = "bm25f"
    tie_breaker: float = 0.0

    @property
    def model(self) -> str:
        return self.scoring_model.lower()

    def check(self, fields: tuple[str, ...]) -> None:
        if self.scoring_model is None or self.model not in ("bm25f", "best_fields"):
            raise ValueError("scoring_model must be either bm25f or best_fields")
        if not _finite(self.tie_breaker) or not 0 <= self.tie_breaker <= 1:
            raise ValueError("tie_breaker must be finite and between 0 and 1")
        if self.model == "bm25f" and self.tie_breaker:
            raise ValueError("tie_breaker is only supported with best_fields scoring")
        if not _finite(self.b) or not 0 <= self.b <= 1:
            raise ValueError("b must be finite and between 0 and 1")
        for f, x in (self.field_weights or {}).items():
            if not _finite(x) or x < 0:
                raise ValueError(f"field weight for {f} must be finite and non-negative")
            if f not in fields:
                raise ValueError(f"field_weights contains unknown field: {f}")
        for f, x in (self.field_b or {}).items():
            if not _finite(x) or not 0 <= x <= 1:
                raise ValueError(f"field b for {f} must be finite and between 0 and 1")
            if f not in fields:
                raise ValueError(f"field_b contains unknown field: {f}")


@dataclass(frozen=True)
class Pick:
    """A term to be scored: for all its raw forms or one; its weight, how many query terms chose it, its documents."""

    term: str
    raw: str | None
    x: float
    m: int
    df: int


def parse_fields(index: FtsIndex, fields: str | None) -> list[int]:
    """Numbers of the fields in a comma-separated list; null means all, unknown names are passed over."""
    if fields is None:
        return list(range(len(index.fields)))
    named = {x.strip() for x in fields.split(",")}
    return [i for i, f in enumerate(index.fields) if f in named]


def idf(num_docs: int, df: int) -> float:
    return math.log10((num_docs - df + 0.5) / (df + 0.5) + 1)


def scores(index: FtsIndex, leaves: dict[int, tuple[list[Pick], list[int]]], s: Scoring, terms_needed: int | None = None) -> DataFrame:
    """(leaf, name, score) of the documents that each leaf's picks are in, within its fields. One pass over the postings of the picked terms, one shuffle by document."""
    stats = index.stats
    rows = []
    for leaf, (picks, fields) in leaves.items():
        for p in picks:
            for f in fields:
                name, mean = index.fields[f], stats.avg_field_lens[f]
                b = float((s.field_b or {}).get(name, s.b))
                rows.append((leaf, p.term, p.raw, f, float(p.x), p.m, idf(stats.num_docs, p.df), float((s.field_weights or {}).get(name, 1.0)), 1 - b, b / mean if mean else 0.0))
    chosen = index.spark.createDataFrame(rows, _SELECTED)
    terms = {r[1] for r in rows}
    postings = index.postings
    if len(terms) <= LISTED:
        postings = postings.where(F.col("term").isin(*terms) if terms else F.lit(False))
    p = postings.join(F.broadcast(chosen), ["term", "fieldid"]).where("raw is null or raw = raw_term").repartition("leaf", "name")  # chosen has a few rows for each query term
    if terms_needed is not None:
        p = p.withColumn("n", F.size(F.collect_set("term").over(Window.partitionBy("leaf", "name")))).where(F.col("n") == terms_needed)
    tf = F.col("tf") * F.col("m") / (F.col("c") + F.col("d") * F.col("flen"))
    k = float(s.k)
    saturated = F.coalesce(F.try_divide(F.col("p") * (k + 1), F.col("p") + k), F.lit(0.0))  # 0 / 0 only for k = 0 and a weight of 0
    if s.model == "bm25f":
        by_term = p.groupBy("leaf", "name", "term", "raw", "idf").agg(F.sum(F.col("w") * tf).alias("p"), F.max("x").alias("x"))
        return by_term.groupBy("leaf", "name").agg(F.sum(F.col("x") * F.col("idf") * saturated).alias("score"))
    by_term = p.groupBy("leaf", "name", "fieldid", "term", "raw", "idf", "w").agg(F.sum(tf).alias("p"), F.max("x").alias("x"))
    by_field = by_term.groupBy("leaf", "name", "fieldid").agg((F.max("w") * F.sum(F.col("x") * F.col("idf") * saturated)).alias("f"))
    return by_field.groupBy("leaf", "name").agg((F.max("f") + float(s.tie_breaker) * (F.sum("f") - F.max("f"))).alias("score"))


def dictionary_df(index: FtsIndex, terms: list[str]) -> dict[str, int]:
    return {r["term"]: r["df"] for r in index.dict.where(F.col("term").isin(*terms)).collect()} if terms else {}


def match_scores(index: FtsIndex, query: str | None, fields: str | None = None, k: float = 1.2, b: float = 0.75, conjunctive: bool = False, field_weights=None, field_b=None, scoring_model: str = "bm25f", tie_breaker: float = 0.0) -> DataFrame:
    """(name, score) of the documents that have a token of the query, or with `conjunctive` all of them, those included that no document has."""
    s = Scoring(k, b, field_weights, field_b, scoring_model, tie_breaker)
    s.check(index.fields)
    terms = index.stemmed(index.tokens(query))
    known = dictionary_df(index, terms)
    picks = [Pick(t, None, 1.0, 1, known[t]) for t in terms if t in known]
    return scores(index, {0: (picks, parse_fields(index, fields))}, s, len(terms) if conjunctive else None).select("name", "score")


def match_bm25(index: FtsIndex, df: DataFrame, id_column: str, query: str | None, score_column: str = "score", **options) -> DataFrame:
    """The rows of a table with their scores, null where the query doesn't match."""
    found = match_scores(index, query, **options).select(F.col("name").alias("__name"), F.col("score").alias(score_column))
    return df.join(found, df[id_column] == F.col("__name"), "left").drop("__name")


def ranked(found: DataFrame, top_k: int | None) -> DataFrame:
    """docname, score, rank: the best first, equal ones by name, nulls last. Without top_k all rows are numbered, by ranges of scores."""
    order = [F.col("score").desc(), F.col("name").asc_nulls_last()]
    if top_k is None:
        return numbered(found.select("name", "score"), order, "rank", 1).select(F.col("name").alias("docname"), "score", "rank")
    best = found.orderBy(*order).limit(int(top_k))
    return best.select(F.col("name").alias("docname"), "score", F.row_number().over(Window.orderBy(*order)).cast("long").alias("rank"))


def match_batch(index: FtsIndex, queries: DataFrame, id_column: str, query_column: str, top_k: int = 10, fields: str | None = None, decimals: int | None = None, **options) -> DataFrame:
    """(query_id, docname, score, rank): the best documents for each row of a table of queries, all queries in one job.

    Up to SENT terms of queries go to the documents, which are scored where they are, and of each task only those come back that may be
    among the best: a document that has common terms of many queries would otherwise be a row for each. More terms are a table that is
    joined with the postings. A null query, or one without a token that is in the dictionary, has no rows. decimals: scores are rounded
    before they are ranked.
    """
    s = Scoring(**options)
    s.check(index.fields)
    stats = index.stats
    asked = queries.select(F.col(f"`{id_column}`").alias("query_id"), F.explode(index.analyzer.tokens(F.col(f"`{query_column}`").cast("string"))).alias("raw")).distinct()
    asked = asked.select("query_id", stem(F.col("raw"), index.analyzer.stemmer).alias("term")).where("term <> ''").distinct()
    idf_ = F.log10((F.lit(stats.num_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    picked = asked.join(index.dict, "term").select("query_id", "term", idf_.alias("idf"))
    own = parse_fields(index, fields)
    named = [(f, index.fields[f], stats.avg_field_lens[f]) for f in own]
    b_of = lambda name: float((s.field_b or {}).get(name, s.b))
    weights = {f: (float((s.field_weights or {}).get(name, 1.0)), 1 - b_of(name), b_of(name) / mean if mean else 0.0) for f, name, mean in named}
    sent = picked.limit(SENT + 1).toArrow()
    if sent.num_rows <= SENT:
        found = best_candidates(index.forward, sent, picked.schema["query_id"].dataType.simpleString(), weights, s.model, float(s.k), float(s.tie_breaker), int(top_k), decimals)
    else:
        found = _joined(index, picked, weights, s)
    if decimals is not None:
        found = found.withColumn("score", F.round("score", decimals))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("name").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= int(top_k)).select("query_id", F.col("name").alias("docname"), "score", "rank")


def _joined(index: FtsIndex, picked: DataFrame, weights: dict[int, tuple[float, float, float]], s: Scoring) -> DataFrame:
    """(query_id, name, score) of all documents that each query matches."""
    lookup = lambda i: F.element_at(F.create_map(*(F.lit(v) for f, x in weights.items() for v in (f, x[i]))), F.col("fieldid")) if weights else F.lit(None).cast("double")
    w, c, d = lookup(0), lookup(1), lookup(2)
    p = index.postings.where(F.col("fieldid").isin(*weights) if weights else F.lit(False)).join(picked, "term").select("query_id", "name", "term", "fieldid", "idf", w.alias("w"), (F.col("tf") / (c + d * F.col("flen"))).alias("x"))
    k = float(s.k)
    saturated = F.coalesce(F.try_divide(F.col("p") * (k + 1), F.col("p") + k), F.lit(0.0))
    if s.model == "bm25f":
        return p.groupBy("query_id", "name", "term", "idf").agg(F.sum(F.col("w") * F.col("x")).alias("p")).groupBy("query_id", "name").agg(F.sum(F.col("idf") * saturated).alias("score"))
    by_field = p.groupBy("query_id", "name", "fieldid", "term", "idf", "w").agg(F.sum("x").alias("p")).groupBy("query_id", "name", "fieldid").agg((F.max("w") * F.sum(F.col("idf") * saturated)).alias("f"))
    return by_field.groupBy("query_id", "name").agg((F.max("f") + float(s.tie_breaker) * (F.sum("f") - F.max("f"))).alias("score"))
