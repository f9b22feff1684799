"""SQL from first principles for what the engine computes."""

from __future__ import annotations

from collections.abc import Sequence

from ..functions.analysis import DEFAULT_IGNORE, english_stopwords

WHITE = "[\t\n\f\r ]+"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words: Sequence[str]) -> str:
    return ", ".join(map(text, words))


def tokens(column: str, strip: bool = True, ignore: str = DEFAULT_IGNORE) -> str:
    plain = f"strip_accents({column}::VARCHAR)" if strip else f"{column}::VARCHAR"
    return f"string_split_regex(lower({plain}), {text(f'({ignore})|{WHITE}')})"


def base(table: str, id_column: str, columns: Sequence[str], stop: Sequence[str] = (), strip: bool = True, ignore: str = DEFAULT_IGNORE, source: str | None = None) -> str:
    """CTEs: src, tok (name, fieldid, term), docs (name, len, f0, f1, ...), st (n, avgdl, a0, ..., t, t0, ...), dict (term, df)."""
    each = " UNION ALL ".join(f"SELECT {id_column} AS name, {i} AS fieldid, unnest({tokens(c, strip, ignore)}) AS term FROM src" for i, c in enumerate(columns))
    without = f" AND term NOT IN ({listed(stop)})" if stop else ""
    n = range(len(columns))
    return f"""src AS ({source or f'SELECT * FROM {table}'}),
tok AS (SELECT * FROM ({each}) WHERE term IS NOT NULL AND term <> ''{without}),
docs AS (SELECT d.{id_column} AS name, count(t.term) AS len, {', '.join(f'count(t.term) FILTER (WHERE t.fieldid = {i}) AS f{i}' for i in n)}
  FROM src d LEFT JOIN tok t ON t.name = d.{id_column} GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len) AS avgdl, {', '.join(f'avg(f{i}) AS a{i}' for i in n)}, sum(len)::BIGINT AS t, {', '.join(f'sum(f{i})::BIGINT AS t{i}' for i in n)} FROM docs),
dict AS (SELECT term, count(DISTINCT name) AS df FROM tok GROUP BY term)"""


def english() -> tuple[str, ...]:
    return english_stopwords()


def exact(terms: Sequence[str], name: str = "pick") -> str:
    """The picks of a plain query."""
    return f"{name} AS (SELECT term, 1.0::DOUBLE AS x, df, 1 AS m FROM dict WHERE term IN ({listed(terms)}))"


def score(n_fields: int, fields: Sequence[int] | None = None, k: float = 1.2, b: Sequence[float] | float = 0.75, weights: Sequence[float] | None = None, model: str = "bm25f", tie: float = 0.0, needed: int | None = None, pick: str = "pick", name: str = "found") -> str:
    """CTEs that end in `name` (name, score)."""
    fields = range(n_fields) if fields is None else fields
    b = [b] * n_fields if isinstance(b, (int, float)) else b
    weights = weights or [1.0] * n_fields
    case = lambda xs: "CASE t.fieldid " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    fl, av = case([f"d.f{i}" for i in range(n_fields)]), case([f"st.a{i}" for i in range(n_fields)])
    keep = f"HAVING count(DISTINCT t.term) = {needed}" if needed is not None else ""
    idf = "log10((n - df + 0.5) / (df + 0.5) + 1)"
    out = f"""{name}_all AS (SELECT t.name FROM tok t JOIN {pick} p ON p.term = t.term WHERE t.fieldid IN ({', '.join(map(str, fields)) or '-1'}) GROUP BY t.name {keep}),
{name}_tf AS (SELECT t.name, t.term, t.fieldid, count(*) * any_value(p.m) AS tf, any_value(p.x) AS x, any_value(p.df) AS df FROM tok t JOIN {pick} p ON p.term = t.term
  WHERE t.fieldid IN ({', '.join(map(str, fields)) or '-1'}) AND t.name IN (SELECT name FROM {name}_all) GROUP BY t.name, t.term, t.fieldid),
{name}_ntf AS (SELECT t.name, t.term, t.fieldid, t.x, t.df, st.n, {case(weights)}::DOUBLE AS w, t.tf / ((1 - {case(b)}) + {case(b)} * ({fl}) / ({av})) AS ntf FROM {name}_tf t JOIN docs d ON d.name = t.name CROSS JOIN st),
"""
    if model == "bm25f":
        return out + f"""{name}_term AS (SELECT name, term, x, df, n, sum(w * ntf) AS p FROM {name}_ntf GROUP BY ALL),
{name} AS (SELECT name, sum(x * {idf} * p * ({k} + 1) / (p + {k})) AS score FROM {name}_term GROUP BY name)"""
    return out + f"""{name}_field AS (SELECT name, fieldid, max(w) * sum(x * {idf} * ntf * ({k} + 1) / (ntf + {k})) AS f FROM {name}_ntf GROUP BY name, fieldid),
{name} AS (SELECT name, max(f) + {tie} * (sum(f) - max(f)) AS score FROM {name}_field GROUP BY name)"""


def ranked(top_k: int | None = 50, found: str = "found") -> str:
    cut = f"WHERE rank <= {top_k}" if top_k is not None else ""
    return f"SELECT * FROM (SELECT name AS docname, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 6) DESC, name) AS rank FROM {found}) {cut}"


def expansion(terms: Sequence[str], limit: int = 32, ratio: float = 0.15, max_df: int = 50000, prefix=True, substring=True, fuzzy=True, short=True, expand_exact=False) -> str:
    """CTEs that end in pick (term, x, df, m) for the terms of a layered query."""
    rows = ", ".join(f"({text(t)}, {len(t)}, {max(len(t) - 2, 0)})" for t in terms)
    lim = "CASE WHEN ql <= 4 THEN 1 WHEN ql <= 8 THEN 2 ELSE 3 END"
    near = "greatest(0.25, 1.0 - damerau_levenshtein(q, term)::DOUBLE / greatest(ql, length(term)))"
    triples = lambda c: f"unnest(list_transform(range(1, length({c}) - 1), lambda i: substr({c}, i::INTEGER, 3)))"
    return f"""qt(q, ql, qg) AS (VALUES {rows}),
cap AS (SELECT least({max_df}, ceil(n * {ratio})::BIGINT) AS most FROM st),
ex AS (SELECT q, term, 1.0::DOUBLE AS x, df FROM qt JOIN dict ON term = q),
xt AS (SELECT * FROM qt WHERE {expand_exact} OR q NOT IN (SELECT q FROM ex)),
qgr AS (SELECT q, ql, qg, {triples('q')} AS g FROM xt WHERE qg > 0 AND NOT regexp_full_match(q, '[0-9]+')),
tg AS (SELECT term, df, {triples('term')} AS g FROM dict WHERE length(term) > 2 AND NOT regexp_full_match(term, '[0-9]+')),
gc AS (SELECT q, ql, qg, term, df, count(*) AS mg FROM qgr JOIN tg USING (g) CROSS JOIN cap WHERE df <= most GROUP BY ALL),
cand AS (SELECT q, term, df, CASE WHEN {prefix} AND starts_with(term, q) AND term <> q THEN 0.85
    WHEN {substring} AND contains(term, q) AND term <> q AND mg = qg THEN 0.75
    WHEN {fuzzy} AND mg >= greatest(1, qg - 1) AND abs(length(term) - ql) <= {lim} AND damerau_levenshtein(q, term) <= {lim} THEN {near} END AS x FROM gc
  UNION ALL SELECT q, term, df, {near} FROM xt JOIN dict ON length(term) BETWEEN ql - 1 AND ql + 1 CROSS JOIN cap
    WHERE {fuzzy} AND {short} AND ql BETWEEN 3 AND 5 AND NOT regexp_full_match(q, '[0-9]+') AND df <= most AND term <> q AND damerau_levenshtein(q, term) <= 1),
best AS (SELECT q, term, df, max(x) AS x FROM cand WHERE x IS NOT NULL GROUP BY q, term, df),
few AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY x DESC, df, length(term), term) AS r FROM best),
chosen AS (SELECT q, term, max(x) AS x, df FROM (SELECT q, term, x, df FROM ex UNION ALL SELECT q, term, x, df FROM few WHERE r <= {limit}) GROUP BY q, term, df),
pick AS (SELECT term, max(x) AS x, df, count(*) AS m FROM chosen GROUP BY term, df)"""


def completion(words: Sequence[str], last: str, limit: int = 32, ratio: float = 0.15, max_df: int = 50000) -> str:
    """CTEs that end in pick for an autocompleted query without stemming, none of whose other words begins with the last."""
    return f"""cap AS (SELECT least({max_df}, ceil(n * {ratio})::BIGINT) AS most FROM st),
begin AS (SELECT term, df, CASE WHEN term = {text(last)} THEN 1.0 ELSE 0.85 END AS x FROM dict CROSS JOIN cap WHERE starts_with(term, {text(last)}) AND (term = {text(last)} OR df <= most)),
few AS (SELECT *, row_number() OVER (ORDER BY df, length(term), term) AS r FROM begin WHERE term <> {text(last)}),
pick AS (SELECT term, 1.0::DOUBLE AS x, df, 1 AS m FROM dict WHERE term IN ({listed(words) or "''"})
  UNION ALL SELECT term, x, df, 1 FROM begin WHERE term = {text(last)} UNION ALL SELECT term, x, df, 1 FROM few WHERE r <= {limit})"""


def batch(table: str, id_column: str, column: str, top_k: int, k: float = 1.2, b: float = 0.75) -> str:
    """The best documents for each text of a table, by one field."""
    x = f"(tf / ((1 - {b}) + {b} * d.f0 / a0))"
    return f"""qt AS (SELECT DISTINCT query_id, term FROM (SELECT {id_column} AS query_id, unnest({tokens(column)}) AS term FROM {table}) WHERE term <> ''),
tf AS (SELECT name, term, count(*) AS tf FROM tok GROUP BY ALL),
found AS (SELECT query_id, t.name, sum(log10((n - df + 0.5) / (df + 0.5) + 1) * {x} * ({k} + 1) / ({x} + {k})) AS score
  FROM qt JOIN dict USING (term) JOIN tf t USING (term) JOIN docs d ON d.name = t.name CROSS JOIN st GROUP BY query_id, t.name)
SELECT query_id, name AS docname, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, name) AS rank FROM found) WHERE rank <= {top_k}"""
