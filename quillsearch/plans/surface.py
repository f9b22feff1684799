"""The SQL surface: functions and views of an index in a session."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf

from ..functions.analysis import STANDARD_TOKEN, WHITE, Analyzer
from ..functions.stemming import stemmer
from ..operators.index import FtsIndex


def register_functions(spark: SparkSession) -> None:
    """stem(text, language) and fts_tokenize_standard(text)."""

    @pandas_udf("string")
    def stem(text: pd.Series, language: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], str] = {}
        out = []
        for t, name in zip(text, language):
            if t is None or name is None:
                out.append(None)
                continue
            if (t, name) not in known:
                known[t, name] = stemmer(name)(t)
            out.append(known[t, name])
        return pd.Series(out, dtype="object")

    spark.udf.register("stem", stem)
    pattern = STANDARD_TOKEN.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION fts_tokenize_standard(s STRING) RETURNS ARRAY<STRING> RETURN CASE WHEN s IS NOT NULL THEN regexp_extract_all(s, '{pattern}', 0) END")


def tokens_sql(analyzer: Analyzer, text: str) -> str:
    """The tokens of a text as a SQL expression."""
    raw = lambda x: "r'" + x.replace("'", "\\x27") + "'"
    if (not analyzer.standard) if analyzer.strip_accents is None else analyzer.strip_accents:
        normal = lambda how, x: f"java_method('com.ibm.icu.text.Normalizer', '{how}', {x}, false)"
        bare = f"regexp_replace({normal('decompose', text)}, {raw(chr(92) + 'p{M}+')}, '')"
        text = f"CASE WHEN {text} RLIKE {raw('[^' + chr(92) + 'x00-' + chr(92) + 'x7F]')} THEN {normal('compose', bare)} ELSE {text} END"
    if analyzer.lower:
        text = f"lower({text})"
    found = f"regexp_extract_all({text}, {raw(STANDARD_TOKEN)}, 0)" if analyzer.standard else f"split({text}, {raw(f'({analyzer.ignore})|{WHITE}')}, -1)"
    stop = ", ".join("'" + w.replace(chr(92), chr(92) * 2).replace("'", chr(92) + "'") + "'" for w in analyzer.words())
    return f"filter({found}, t -> t <> ''" + (f" AND t NOT IN ({stop})" if stop else "") + ")"


def register_index(index: FtsIndex, name: str) -> None:
    """The index's tables as temporary views, and its functions.

    Views: <name>_docs, _dict, _terms, _postings, _stats, _fields and, with layered search, _raw_dict, _term_stats, _term_grams, _term_prefixes.
    Functions: <name>_tokenize(text), and the table function <name>_match_bm25(query, k => 1.2, b => 0.75, conjunctive => false) of
    (docname, score), in which all fields count alike.
    """
    tables = {"docs": index.docs, "dict": index.dict, "terms": index.terms_table(), "postings": index.postings, "stats": index.stats_table(), "fields": index.fields_table()}
    if index.layered:
        tables |= {"raw_dict": index.raw_dict, "term_stats": index.term_stats(), "term_grams": index.term_grams(), "term_prefixes": index.term_prefixes()}
    for part, df in tables.items():
        df.createOrReplaceTempView(f"{name}_{part}")
    register_functions(index.spark)
    spark, stats = index.spark, index.stats
    tokens = lambda text: tokens_sql(index.analyzer, text)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}_tokenize(s STRING) RETURNS ARRAY<STRING> RETURN {tokens('s')}")
    term = "t" if index.analyzer.stemmer == "none" else f"stem(t, '{index.analyzer.stemmer}')"
    mean = "CASE p.fieldid " + " ".join(f"WHEN {i} THEN {a!r}D" for i, a in enumerate(stats.avg_field_lens) if a) + " ELSE 1D END" if any(stats.avg_field_lens) else "1D"
    n = stats.num_docs
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}_match_bm25(query STRING, k DOUBLE DEFAULT 1.2D, b DOUBLE DEFAULT 0.75D, conjunctive BOOLEAN DEFAULT false)
RETURNS TABLE (docname {index.docs.schema["name"].dataType.simpleString()}, score DOUBLE) RETURN
SELECT name, score FROM (
  SELECT name, sum(s) AS score, count(*) AS found FROM (
    SELECT name, idf * x * (k + 1) / (x + k) AS s FROM (
      SELECT name, term, log10(({n} - any_value(df) + 0.5D) / (any_value(df) + 0.5D) + 1) AS idf, sum(part) AS x FROM (
        SELECT p.name, p.term, d.df, p.tf / (1 - b + b * p.flen / {mean}) AS part FROM {name}_postings p JOIN {name}_dict d ON d.term = p.term
        WHERE array_contains(transform({tokens('query')}, t -> {term}), p.term))
      GROUP BY name, term))
  GROUP BY name)
WHERE NOT conjunctive OR found = size(array_distinct(transform({tokens('query')}, t -> {term})))""")
