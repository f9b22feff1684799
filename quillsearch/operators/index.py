"""The inverted index of a table: documents, postings, dictionaries and statistics as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import Analyzer, as_text, query_tokens
from ..functions.stemming import stemmer
from .inverting import counted, dictionary, from_documents, inverted, raw_dictionary


@dataclass(frozen=True)
class Stats:
    num_docs: int
    avgdl: float | None
    avg_field_lens: tuple[float | None, ...]
    total_len: int
    total_field_lens: tuple[int, ...]


@dataclass(frozen=True)
class Side:
    """What a stored index has beside its postings, each laid out by what it is looked up by: dict (term, df), raw_dict (raw_term, term, df), grams (gram, term, df, term_len), lens (term, df, term_len, gram_count), prefixes (prefix_len, prefix, raw_term, term, df)."""

    stats: Stats
    dict: DataFrame
    raw_dict: DataFrame
    grams: DataFrame | None
    lens: DataFrame | None
    prefixes: DataFrame | None


def stats_of(num_docs: int, field_lens: Iterable[int]) -> Stats:
    field_lens = tuple(field_lens)
    mean = lambda x: x / num_docs if num_docs else None
    return Stats(num_docs, mean(sum(field_lens)), tuple(map(mean, field_lens)), sum(field_lens), field_lens)


def resolve_fields(df: DataFrame, id_column: str, columns: Iterable[str]) -> tuple[str, ...]:
    """The columns to index; '*' stands for all string columns, the id among them if it is one, whatever else is named."""
    columns = tuple(columns)
    for c in (id_column, *(c for c in columns if c != "*")):
        if c not in df.columns:
            raise ValueError(f"Table does not have a column named '{c}'!")
    if "*" in columns:
        columns = tuple(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType))
    if not columns:
        raise ValueError("at least one column must be supplied for indexing!")
    return columns


@dataclass(frozen=True)
class FtsIndex:
    """docs: name, len, field_lens. forward: the same with the postings of each document as arrays. postings: term, raw_term, name, fieldid, tf, flen (the field's length in that document). All are lazy; the dictionaries and the statistics follow from them. Names are unique."""

    spark: SparkSession
    analyzer: Analyzer
    fields: tuple[str, ...]
    docs: DataFrame
    forward: DataFrame
    postings: DataFrame
    layered: bool = True
    incremental: bool = True
    side: Side | None = None

    @classmethod
    def build(cls, df: DataFrame, id_column: str, *columns: str, analyzer: Analyzer | None = None, layered: bool = True, incremental: bool = False, check_ids: bool = True, **options) -> FtsIndex:
        """An index over one or more columns of any type. Texts that are null, and those without tokens, are documents of length 0.

        Ids have to be unique, and not null if the index is incremental; check_ids=False leaves the check out for tables that are known to be so.
        """
        fields = resolve_fields(df, id_column, columns)
        analyzer = analyzer or Analyzer(**options)
        stemmer(analyzer.stemmer)
        if check_ids:
            _check_ids(df.select(F.col(f"`{id_column}`").alias("name")), incremental)
        docs, forward = _analysed(df, id_column, fields, analyzer)
        return cls(df.sparkSession, analyzer, fields, docs, forward, from_documents(forward), layered, incremental)

    def segment(self, df: DataFrame, id_column: str) -> tuple[DataFrame, DataFrame]:
        """Documents of further rows, without and with their postings."""
        return _analysed(df, id_column, self.fields, self.analyzer)

    def insert(self, df: DataFrame, id_column: str) -> FtsIndex:
        """The index with further rows; an id that is live already is an error."""
        self._maintained()
        names = df.select(F.col(f"`{id_column}`").alias("name"))
        _check_ids(names, True)
        if names.join(self.docs.select("name"), "name", "left_semi").limit(1).count():
            raise ValueError("Constraint Error: an inserted id is in the index already")
        docs, forward = self.segment(df, id_column)
        return replace(self, docs=self.docs.unionByName(docs, allowMissingColumns=True), forward=self.forward.unionByName(forward), postings=self.postings.unionByName(from_documents(forward)), side=None)

    def delete(self, ids: DataFrame) -> FtsIndex:
        """The index without the documents whose ids the frame's first column has; unknown and null ids do nothing."""
        self._maintained()
        gone = ids.select(F.col(f"`{ids.columns[0]}`").alias("name")).distinct()
        docs, forward, postings = (x.join(gone, "name", "left_anti") for x in (self.docs, self.forward, self.postings))
        return replace(self, docs=docs, forward=forward, postings=postings, side=None)

    def update(self, df: DataFrame, id_column: str) -> FtsIndex:
        """Rows in place of those of the same ids."""
        return self.delete(df.select(id_column)).insert(df, id_column)

    def _maintained(self) -> None:
        if not self.incremental:
            raise ValueError("the index isn't incremental")

    def persist(self) -> FtsIndex:
        """The same index with documents, postings and dictionaries kept in the executors' memory and disks."""
        out = replace(self, docs=self.docs.persist(), forward=self.forward.persist(), postings=self.postings.persist())
        out.__dict__["dict"] = out.dict.persist()
        out.__dict__["raw_dict"] = out.raw_dict.persist()
        return out

    def unpersist(self) -> None:
        for df in (self.docs, self.forward, self.postings, self.dict, self.raw_dict):
            df.unpersist()

    @cached_property
    def dict(self) -> DataFrame:
        """term, df: documents that have the term in any field."""
        if self.side:
            return self.side.dict
        return dictionary(inverted(self.forward))

    @cached_property
    def raw_dict(self) -> DataFrame:
        """raw_term, term, df of each pair of a raw token and its stem."""
        if self.side:
            return self.side.raw_dict
        return raw_dictionary(inverted(self.forward))

    @cached_property
    def stats(self) -> Stats:
        if self.side:
            return self.side.stats
        r = self.stats_table().first()
        return Stats(r["num_docs"], r["avgdl"], tuple(r["avg_field_lens"]), r["total_len"], tuple(r["total_field_lens"]))

    def stats_table(self) -> DataFrame:
        """One row: num_docs, avgdl, avg_field_lens, total_len, total_field_lens; averages are null without documents."""
        parts = [F.col("field_lens")[i] for i in range(len(self.fields))]
        return self.docs.agg(
            F.count("*").alias("num_docs"),
            F.avg("len").alias("avgdl"),
            F.array(*(F.avg(p) for p in parts)).alias("avg_field_lens"),
            F.coalesce(F.sum("len"), F.lit(0)).alias("total_len"),
            F.array(*(F.coalesce(F.sum(p), F.lit(0)) for p in parts)).alias("total_field_lens"),
        )

    def terms_table(self) -> DataFrame:
        """One row for each occurrence of a token: term, raw_term, name, fieldid."""
        return self.postings.select("term", "raw_term", "name", "fieldid", F.explode(F.sequence(F.lit(1), F.col("tf"))).alias("_")).drop("_")

    def fields_table(self) -> DataFrame:
        return self.spark.createDataFrame([(i, f) for i, f in enumerate(self.fields)], "fieldid bigint, field string")

    def term_stats(self) -> DataFrame:
        """term, df, term_len in characters, gram_count."""
        if self.side and self.side.lens is not None:
            return self.side.lens
        return self.dict.select("term", "df", F.length("term").cast("long").alias("term_len"), F.greatest(F.length("term") - 2, F.lit(0)).cast("long").alias("gram_count"))

    def term_grams(self) -> DataFrame:
        """gram, term, df, term_len: each run of three characters of each term that isn't a number, as often as it occurs."""
        if self.side and self.side.grams is not None:
            return self.side.grams
        some = self.term_stats().where((F.col("gram_count") > 0) & ~F.col("term").rlike("^[0-9]+$"))
        return some.select(F.explode_outer(F.transform(F.sequence(F.lit(1), F.col("gram_count").cast("int")), lambda i: F.substring("term", i, F.lit(3)))).alias("gram"), "term", "df", "term_len")

    def term_prefixes(self) -> DataFrame:
        """prefix_len, prefix, raw_term, term, df: the first two and three characters of the raw terms that have them."""
        if self.side and self.side.prefixes is not None:
            return self.side.prefixes
        two_three = F.array(*(F.struct(F.lit(n).alias("prefix_len"), F.substring("raw_term", 1, n).alias("prefix")) for n in (2, 3)))
        each = self.raw_dict.select("raw_term", "term", "df", F.explode(two_three).alias("p"))
        return each.where(F.length("raw_term") >= F.col("p.prefix_len")).select("p.prefix_len", "p.prefix", "raw_term", "term", "df")

    def tokens(self, query: str | None) -> list[str]:
        return query_tokens(self.spark, self.analyzer, query)

    def stemmed(self, tokens: Iterable[str]) -> list[str]:
        """Distinct stems that aren't empty, in order."""
        f = stemmer(self.analyzer.stemmer)
        return [t for t in dict.fromkeys(f(x) for x in tokens) if t]


def _check_ids(names: DataFrame, not_null: bool) -> None:
    bad = names.groupBy("name").count().where((F.col("count") > 1) | F.col("name").isNull()).limit(2).collect()
    if not_null and any(r["name"] is None for r in bad):
        raise ValueError("Constraint Error: an incremental index needs ids that are NOT NULL")
    if any(r["count"] > 1 for r in bad):
        raise ValueError("Constraint Error: ids must be unique")


def _analysed(df: DataFrame, id_column: str, fields: tuple[str, ...], analyzer: Analyzer) -> tuple[DataFrame, DataFrame]:
    """The documents of a table, without and with their postings; the table is read once for either."""
    missing = [c for c in (id_column, *fields) if c not in df.columns]
    if missing:
        raise ValueError(f"Table does not have a column named '{missing[0]}'!")
    name: Column = F.col(f"`{id_column}`").alias("name")
    rows = df.select(name, F.array(*(analyzer.tokens(as_text(df, c)) for c in fields)).alias("fields"))
    lens = F.transform("fields", lambda t: F.size(t).cast("long"))
    docs = rows.select("name", lens.alias("field_lens")).select("name", F.aggregate("field_lens", F.lit(0).cast("long"), lambda a, x: a + x).alias("len"), "field_lens")
    return docs, counted(rows, len(fields), analyzer.stemmer)
