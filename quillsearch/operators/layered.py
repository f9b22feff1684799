"""Search that also finds prefixes, substrings and misspelled terms, and autocompletion."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.analysis import damerau
from .index import FtsIndex
from .scoring import Pick, Scoring, dictionary_df, parse_fields, ranked, scores


@dataclass(frozen=True)
class Expansion:
    """Which other terms a query term stands for, and how many."""

    term_limit: int | None = 32
    max_df_ratio: float | None = 0.15
    max_df: int | None = 50000
    enable_prefix: bool = True
    enable_substring: bool = True
    enable_fuzzy: bool = True
    enable_short_fuzzy: bool = True
    expand_exact_terms: bool = False

    def cap(self, num_docs: int) -> int | None:
        """Documents that an expanded term has at most."""
        ways = [x for x in (self.max_df, None if self.max_df_ratio is None else math.ceil(num_docs * self.max_df_ratio)) if x is not None]
        return min(ways) if ways else None


def check_mode(mode: str | None) -> str:
    if mode is None or str(mode).lower() not in ("standard", "autocomplete"):
        raise ValueError("query_mode must be either standard or autocomplete")
    return mode.lower()


def _rare(df: DataFrame, cap: int | None) -> DataFrame:
    return df.where(F.lit(False)) if cap is None else df.where(F.col("df") <= cap)


def _expanded(index: FtsIndex, terms: list[str], e: Expansion) -> list[tuple[str, str, float, int]]:
    """(query term, term, weight, df) of the terms that stand for query terms: at most term_limit for each."""
    cap = e.cap(index.stats.num_docs)
    terms = [t for t in terms if len(t) >= 3 and not (t.isascii() and t.isdigit())]
    if not terms or e.term_limit is None:
        return []
    spark = index.spark
    limit = F.when(F.col("q_len") <= 4, 1).when(F.col("q_len") <= 8, 2).otherwise(3)
    q, term = F.col("query_term"), F.col("term")
    near = F.greatest(F.lit(0.25), 1.0 - F.col("dist") / F.greatest("q_len", "term_len"))
    grams = [(t, g, n, len(t), len(t) - 2) for t in terms for g, n in Counter(t[i : i + 3] for i in range(len(t) - 2)).items()]
    asked = spark.createDataFrame(grams, "query_term string, gram string, times bigint, q_len bigint, q_grams bigint")
    sharing = _rare(index.term_grams(), cap).where(F.col("gram").isin(*{g[1] for g in grams})).join(F.broadcast(asked), "gram")  # asked: the query's own grams
    found = sharing.groupBy("query_term", "q_len", "q_grams", "term", "df", "term_len").agg(F.sum("times").alias("matching"))
    fixed = F.when(F.lit(e.enable_prefix) & term.startswith(q) & (term != q), 0.85).when(F.lit(e.enable_substring) & term.contains(q) & (term != q) & (F.col("matching") == F.col("q_grams")), 0.75)
    fuzzy = F.lit(e.enable_fuzzy) & (F.col("matching") >= F.greatest(F.lit(1), F.col("q_grams") - 1)) & (F.abs(F.col("term_len") - F.col("q_len")) <= limit) & (F.levenshtein(q, term) <= 2 * limit)
    found = found.withColumn("weight", fixed)
    columns = ["query_term", "term", "df", "term_len", "weight"]
    candidates = found.where("weight is not null").select(*columns)
    if e.enable_fuzzy:
        close = found.where(F.col("weight").isNull() & fuzzy).withColumn("dist", damerau(q, term)).where(F.col("dist") <= limit)
        candidates = candidates.unionByName(close.withColumn("weight", near).select(*columns))
        short = [(t, len(t), n) for t in terms if len(t) <= 5 for n in (len(t) - 1, len(t), len(t) + 1)]
        if e.enable_short_fuzzy and short:
            asked = spark.createDataFrame(short, "query_term string, q_len bigint, term_len bigint")
            pairs = _rare(index.term_stats(), cap).join(F.broadcast(asked), "term_len").where((term != q) & (F.levenshtein(q, term) <= 2))
            pairs = pairs.withColumn("dist", damerau(q, term)).where("dist <= 1")
            candidates = candidates.unionByName(pairs.withColumn("weight", near).select(*columns))
    best = candidates.groupBy("query_term", "term", "df", "term_len").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("query_term").orderBy(F.desc("weight"), "df", "term_len", "term")
    rows = best.withColumn("n", F.row_number().over(order)).where(F.col("n") <= int(e.term_limit)).collect()  # term_limit rows a query term
    return [(r["query_term"], r["term"], r["weight"], r["df"]) for r in rows]


def picks_of(index: FtsIndex, query: str | None, mode: str, e: Expansion) -> list[Pick]:
    """The dictionary's terms that a query asks for."""
    if not index.layered:
        raise ValueError("the index has no layered search")
    raw = index.tokens(query)
    chosen: dict[tuple[str, str | None], list[tuple[float, int]]] = {}
    if not raw:
        return []
    words = raw
    if check_mode(mode) == "autocomplete":
        last = raw[-1]
        if len(last) < 2:
            return []
        words = raw[:-1]
    terms = index.stemmed(words)
    known = dictionary_df(index, terms)
    for t in terms:
        if t in known:
            chosen.setdefault((t, None), []).append((1.0, known[t]))
    if mode == "standard":
        for q, t, weight, df in _expanded(index, [t for t in terms if e.expand_exact_terms or t not in known], e):
            if (t, None) in chosen and q == t:
                continue  # the term itself, chosen already by the same query term
            chosen.setdefault((t, None), []).append((weight, df))
    else:
        for r in _completions(index, last, e):
            chosen.setdefault((r["term"], r["raw_term"]), []).append((1.0 if r["raw_term"] == last else 0.85, r["df"]))
    return [Pick(t, raw_term, max(w for w, _ in found), len(found), found[0][1]) for (t, raw_term), found in chosen.items()]


def _completions(index: FtsIndex, last: str, e: Expansion) -> list:
    cap = e.cap(index.stats.num_docs)
    n = min(3, len(last))
    begin = index.term_prefixes().where((F.col("prefix_len") == n) & (F.col("prefix") == last[:n]) & F.col("raw_term").startswith(last)).select("raw_term", "term", "df")
    own = begin.where(F.col("raw_term") == last)
    if e.term_limit is None:
        return own.collect()
    longer = _rare(begin.where(F.col("raw_term") != last), cap).orderBy("df", F.length("raw_term"), "raw_term", "term").limit(int(e.term_limit))
    return own.unionByName(longer).collect()


def split_options(options: dict) -> tuple[Scoring, Expansion]:
    names = Scoring.__dataclass_fields__
    return Scoring(**{k: v for k, v in options.items() if k in names}), Expansion(**{k: v for k, v in options.items() if k not in names})


def layered_scores(index: FtsIndex, query: str | None, fields: str | None = None, query_mode: str = "standard", **options) -> DataFrame:
    """(name, score) of all documents that match."""
    mode = check_mode(query_mode)
    s, e = split_options(options)
    s.check(index.fields)
    return scores(index, {0: (picks_of(index, query, mode, e), parse_fields(index, fields))}, s).select("name", "score")


def search_layered_bm25(index: FtsIndex, query: str | None, fields: str | None = None, top_k: int | None = 50, query_mode: str = "standard", **options) -> DataFrame:
    """docname, score, rank of the best documents. Options: those of Scoring and of Expansion."""
    return ranked(layered_scores(index, query, fields, query_mode, **options), top_k)


def match_layered_bm25(index: FtsIndex, df: DataFrame, id_column: str, query: str | None, score_column: str = "score", **options) -> DataFrame:
    """The rows of a table with their scores, null where the query doesn't match."""
    found = layered_scores(index, query, **options).select(F.col("name").alias("__name"), F.col("score").alias(score_column))
    return df.join(found, df[id_column] == F.col("__name"), "left").drop("__name")
