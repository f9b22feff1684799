"""An index kept as Parquet: segments, tombstones and a manifest for each version."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.analysis import Analyzer
from ..operators.index import FtsIndex, Side, _check_ids, stats_of
from ..operators.inverting import dictionary, from_blocks, inverted, raw_dictionary
from ..operators.numbering import numbered, staged


@dataclass(frozen=True)
class Manifest:
    """What makes up one version: folders of segments and of tombstones, in the order they were added, with the documents and the length of each field that a folder adds or takes away; the next free numbers of documents and terms."""

    version: int
    analyzer: dict
    fields: tuple[str, ...]
    layered: bool
    incremental: bool
    steps: tuple[tuple[str, str, int, tuple[int, ...]], ...]  # ("segment" or "tombstones", folder, documents, field lengths)
    schemas: dict  # DDL of each table, so that opening an index reads no footers
    next_docid: int = 0
    next_termid: int = 0


class IndexStore:
    """A folder that holds an index. A change writes new folders first and then the manifest of the next version, whose name is the commit: a writer that comes second finds it taken, and a reader of an older version keeps what it had."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder) if f.getPath().getName().endswith(".json"))

    def exists(self) -> bool:
        return bool(self._versions())

    def manifest(self, version: int | None = None) -> Manifest:
        versions = self._versions()
        if not versions:
            raise ValueError(f"a FTS index does not exist at '{self.path}'. Create one with build()")
        text = self.spark.sparkContext.wholeTextFiles(f"{self.path}/manifests/{versions[-1] if version is None else version:09d}.json").first()[1]
        m = json.loads(text)
        steps = tuple((kind, folder, n, tuple(lens)) for kind, folder, n, lens in m["steps"])
        return Manifest(m["version"], m["analyzer"], tuple(m["fields"]), m["layered"], m["incremental"], steps, m["schemas"], m["next_docid"], m["next_termid"])

    def _commit(self, m: Manifest) -> None:
        target = self._path(f"{self.path}/manifests/{m.version:09d}.json")
        out = self._fs.create(target, False)  # fails if another writer was first
        out.write(bytearray(json.dumps(asdict(m)).encode()))
        out.close()

    def _put(self, df: DataFrame, path: str, *order: str) -> DataFrame:
        """Writes a table in the order of what it is looked up by, so that row groups' ranges find it, and reads it again."""
        if order:
            df = df.repartitionByRange(order[0]).sortWithinPartitions(*order)
        df.write.parquet(f"{self.path}/{path}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{path}")

    def _write_segment(self, forward: DataFrame, m: Manifest | None, n_fields: int, layered: bool, known: DataFrame | None = None) -> tuple[tuple, dict, int, int]:
        """A segment and all that is derived from its documents, whose texts are read once: the step of the manifest, the tables' schemas, the next numbers. known: the terms that have numbers already."""
        folder = f"segments/{uuid.uuid4()}"
        first_doc, first_term = (m.next_docid, m.next_termid) if m else (0, 0)
        forward = self._put(forward, f"{folder}/forward")
        kept = self._put(numbered(forward.select("name", "len", "field_lens"), [F.col("name")], "docid", first_doc), f"{folder}/docs")  # in order already
        p = self._put(inverted(forward), f"{folder}/postings", "term", "raw")
        terms = dictionary(p)
        order = ()
        if known is None:
            ids = numbered(terms, [F.col("term")], "termid", first_term)
        else:
            terms, order = staged(terms.join(known.select("term", "termid"), "term", "left")), ("term",)
            ids = numbered(terms.where("termid is null").drop("termid"), [F.col("term")], "termid", first_term).unionByName(terms.where("termid is not null"))
        side = FtsIndex(self.spark, Analyzer(stemmer="none"), (), kept, forward, p)
        side.__dict__["dict"] = self._put(ids.select("term", "termid", "df"), f"{folder}/dict", *order)
        side.__dict__["raw_dict"] = self._put(raw_dictionary(p), f"{folder}/raw_dict", "raw_term", "term")
        tables = {"docs": kept, "forward": forward, "postings": p, "dict": side.dict, "raw_dict": side.raw_dict}
        if layered:
            tables["lens"] = self._put(side.term_stats(), f"{folder}/lens", "term_len", "term")
            tables["grams"] = self._put(side.term_grams(), f"{folder}/grams", "gram", "term")
            tables["prefixes"] = self._put(side.term_prefixes(), f"{folder}/prefixes", "prefix", "prefix_len", "raw_term")
        r = kept.agg(F.count("*"), *(F.coalesce(F.sum(F.col("field_lens")[i]), F.lit(0)) for i in range(n_fields)), F.coalesce(F.max("docid") + 1, F.lit(first_doc))).first()
        next_term = side.dict.agg(F.max("termid")).first()[0]
        step = ("segment", folder, r[0], tuple(r[1:-1]))
        return step, {k: t.schema.json() for k, t in tables.items()}, r[-1], max(first_term, -1 if next_term is None else next_term + 1)

    def build(self, df: DataFrame, id_column: str, *columns: str, overwrite: bool = False, **options) -> FtsIndex:
        if self.exists() and not overwrite:
            raise ValueError(f"a FTS index already exists at '{self.path}'. Supply overwrite=True to overwrite, or drop() it")
        index = FtsIndex.build(df, id_column, *columns, **options)
        step, schemas, docid, termid = self._write_segment(index.forward, None, len(index.fields), index.layered)
        analyzer = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(index.analyzer).items()}
        next_version = (self._versions() or [-1])[-1] + 1
        self._commit(Manifest(next_version, analyzer, index.fields, index.layered, index.incremental, (step,), schemas, docid, termid))
        return self.load()

    def drop(self) -> None:
        if not self.exists():
            raise ValueError(f"a FTS index does not exist at '{self.path}'. Create one with build()")
        for part in ("manifests", "segments", "tombstones"):
            self._fs.delete(self._path(f"{self.path}/{part}"), True)

    def _read(self, m: Manifest, folder: str, name: str) -> DataFrame:
        return self.spark.read.schema(T.StructType.fromJson(json.loads(m.schemas[name]))).parquet(f"{self.path}/{folder}/{name}")

    def load(self, version: int | None = None) -> FtsIndex:
        """The index of a version. Statistics are sums over the manifest; dictionaries are sums over the segments, of which what tombstones took away is subtracted. Nothing is tokenized or counted again."""
        m = self.manifest(version)
        if "forward" not in m.schemas:
            raise ValueError(f"the FTS index at '{self.path}' was written by an older version. Build it anew")
        live: list[DataFrame] = []  # docs, forward, postings
        for kind, folder, *_ in m.steps:  # tombstones are for what came before them
            if kind == "segment":
                more = [self._read(m, folder, "docs"), self._read(m, folder, "forward"), from_blocks(self._read(m, folder, "postings"))]
                live = [x.unionByName(y) for x, y in zip(live, more)] if live else more
            else:
                gone = self.spark.read.schema(T.StructType([live[0].schema["name"]])).parquet(f"{self.path}/{folder}/names")
                live = [x.join(gone, "name", "left_anti") for x in live]
        options = dict(m.analyzer)
        if isinstance(options["stopwords"], list):
            options["stopwords"] = tuple(options["stopwords"])
        sign = {"segment": 1, "tombstones": -1}
        n = sum(sign[kind] * n for kind, _, n, _ in m.steps)
        stats = stats_of(n, (sum(sign[kind] * lens[i] for kind, _, _, lens in m.steps) for i in range(len(m.fields))))
        segments = [folder for kind, folder, *_ in m.steps if kind == "segment"]
        if len(m.steps) == 1:
            own = lambda name: self._read(m, segments[0], name) if m.layered else None
            side = Side(stats, self._read(m, segments[0], "dict"), self._read(m, segments[0], "raw_dict"), own("grams"), own("lens"), own("prefixes"))
        else:
            deltas = {name: reduce(DataFrame.unionByName, (self._read(m, folder, name).withColumn("df", F.col("df") * sign[kind]) for kind, folder, *_ in m.steps)) for name in ("dict", "raw_dict")}
            terms = deltas["dict"].groupBy("term").agg(F.min("termid").alias("termid"), F.sum("df").alias("df")).where("df > 0")
            raw = deltas["raw_dict"].groupBy("raw_term", "term").agg(F.sum("df").alias("df")).where("df > 0")
            grams = prefixes = None
            if m.layered:  # what a segment has of a term, all have: df comes from the sums, for the few terms that a gram or prefix leaves
                each = {name: [self._read(m, folder, name) for folder in segments] for name in ("grams", "prefixes")}
                times = [g.groupBy("gram", "term", "term_len").agg(F.count("*").alias("times")) for g in each["grams"]]
                grams = reduce(DataFrame.unionByName, times).groupBy("gram", "term", "term_len").agg(F.max("times").alias("times"))
                grams = grams.join(terms.select("term", "df"), "term").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("gram", "term", "df", "term_len")
                prefixes = reduce(DataFrame.unionByName, (p.drop("df") for p in each["prefixes"])).distinct().join(raw, ["raw_term", "term"])
            side = Side(stats, terms, raw, grams, None, prefixes)
        return FtsIndex(self.spark, Analyzer(**options), m.fields, *live, m.layered, m.incremental, side)

    def _next(self, m: Manifest, steps: list[tuple], schemas: dict | None = None, docid: int | None = None, termid: int | None = None) -> FtsIndex:
        self._commit(replace(m, version=m.version + 1, steps=(*m.steps, *steps), schemas=schemas or m.schemas, next_docid=m.next_docid if docid is None else docid, next_termid=m.next_termid if termid is None else termid))
        return self.load()

    def _inserted(self, m: Manifest, live: FtsIndex, dict_: DataFrame, df: DataFrame, id_column: str) -> tuple[tuple, dict, int, int]:
        live._maintained()
        names = df.select(F.col(f"`{id_column}`").alias("name"))
        _check_ids(names, True)
        if names.join(live.docs.select("name"), "name", "left_semi").limit(1).count():
            raise ValueError("Constraint Error: an inserted id is in the index already")
        return self._write_segment(live.segment(df, id_column)[1], m, len(m.fields), m.layered, dict_)

    def _deleted(self, m: Manifest, live: FtsIndex, ids: DataFrame) -> tuple:
        """The names that go, and what the dictionaries and statistics lose by them."""
        live._maintained()
        folder = f"tombstones/{uuid.uuid4()}"
        asked = ids.select(F.col(f"`{ids.columns[0]}`").alias("name").cast(live.docs.schema["name"].dataType)).where("name is not null").distinct()
        gone = self._put(live.docs.join(asked, "name", "left_semi").select("name"), f"{folder}/names")
        lost = staged(inverted(live.forward.join(gone, "name", "left_semi")).groupBy("term", "raw").agg(F.sum("df").alias("df"), F.sum("raw_df").alias("raw_df")))
        self._put(dictionary(lost).join(live.dict.select("term", "termid"), "term").select("term", "termid", "df"), f"{folder}/dict", "term")
        self._put(raw_dictionary(lost), f"{folder}/raw_dict", "raw_term", "term")
        r = live.docs.join(gone, "name", "left_semi").agg(F.count("*"), *(F.coalesce(F.sum(F.col("field_lens")[i]), F.lit(0)) for i in range(len(m.fields)))).first()
        return "tombstones", folder, r[0], tuple(r[1:])

    def insert(self, df: DataFrame, id_column: str) -> FtsIndex:
        m = self.manifest()
        live = self.load(m.version)
        step, schemas, docid, termid = self._inserted(m, live, live.dict, df, id_column)
        return self._next(m, [step], schemas, docid, termid)

    def delete(self, ids: DataFrame) -> FtsIndex:
        m = self.manifest()
        return self._next(m, [self._deleted(m, self.load(m.version), ids)])

    def update(self, df: DataFrame, id_column: str, deleted: DataFrame | None = None) -> FtsIndex:
        """Rows in place of those of the same ids, and without the documents whose ids `deleted` has, in one version."""
        m = self.manifest()
        live = self.load(m.version)
        ids = df.select(id_column) if deleted is None else df.select(id_column).union(deleted.select(deleted.columns[0]))
        gone = self._deleted(m, live, ids)
        step, schemas, docid, termid = self._inserted(m, live.delete(ids), live.dict, df, id_column)
        return self._next(m, [gone, step], schemas, docid, termid)

    def compact(self) -> FtsIndex:
        """One segment in place of all segments and tombstones; older versions stay readable until vacuum(). Documents and terms are numbered anew."""
        m = self.manifest()
        live = self.load(m.version)
        step, schemas, docid, termid = self._write_segment(live.forward, None, len(m.fields), m.layered)
        self._commit(replace(m, version=m.version + 1, steps=(step,), schemas=schemas, next_docid=docid, next_termid=termid))
        return self.load()

    def vacuum(self) -> None:
        """Deletes what the last version doesn't use."""
        m = self.manifest()
        used = {folder for _, folder, *_ in m.steps}
        for part in ("segments", "tombstones"):
            root = self._path(f"{self.path}/{part}")
            for f in self._fs.listStatus(root) if self._fs.exists(root) else []:
                if f"{part}/{f.getPath().getName()}" not in used:
                    self._fs.delete(f.getPath(), True)
        for v in self._versions()[:-1]:
            self._fs.delete(self._path(f"{self.path}/manifests/{v:09d}.json"), False)
