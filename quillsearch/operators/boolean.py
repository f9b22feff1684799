"""Boolean query trees: parsed and checked on the driver, all leaves scored in one job, combined in one expression."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .index import FtsIndex
from .layered import picks_of, split_options
from .scoring import ranked, scores

_LEAF, _GROUP, _CLAUSES = {"query", "fields", "query_mode", "boost"}, {"must", "should", "must_not", "minimum_should_match", "boost"}, ("must", "should", "must_not")


class _Pairs(list):
    """A JSON object with its keys as they are written, repeated ones too."""

    def keys(self) -> list[str]:
        return [k for k, _ in self]

    def get(self, key: str, default=None):
        return next((v for k, v in self if k == key), default)

    def has(self, key: str) -> bool:
        return any(k == key for k, _ in self)


@dataclass
class Node:
    boost: float = 1.0
    query: str | None = None
    fields: tuple[str, ...] | None = None
    mode: str = "standard"
    must: list[Node] = field(default_factory=list)
    should: list[Node] = field(default_factory=list)
    must_not: list[Node] = field(default_factory=list)
    least: int = 0
    leaf: bool = False

    def leaves(self) -> list[Node]:
        return [self] if self.leaf else [x for c in (*self.must, *self.should, *self.must_not) for x in c.leaves()]


def _limit(value, name: str) -> int | None:
    if value is None:
        return None
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value) or value != int(value) or value < 1:
        raise ValueError(f"{name} must be NULL or a positive integer")
    return int(value)


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _wrong(node: _Pairs, known: tuple[str, ...], errors: list[tuple[int, str]]) -> None:
    is_leaf, is_group = node.has("query"), any(node.has(c) for c in _CLAUSES)
    say = lambda rank, text: errors.append((rank, text))
    if is_leaf and is_group:
        say(20, "query node cannot contain both query and Boolean clauses")
    for c in _CLAUSES:
        value = node.get(c)
        if node.has(c) and (not isinstance(value, list) or isinstance(value, _Pairs)):
            say(30, f"{c} must be an array")
        elif node.has(c) and not all(isinstance(x, _Pairs) for x in value):
            say(30, f"{c} entries must be JSON objects")
    if len(set(node.keys())) < len(node):
        say(40, "query node contains duplicate keys")
    for key in node.keys():
        if is_leaf and not is_group and key not in _LEAF or not is_leaf and key not in _GROUP:
            say(50, f"query node contains unknown key: {key}")
    if is_leaf and not isinstance(node.get("query"), str):
        say(60, "query leaf must contain a string query")
    if is_leaf and node.has("fields"):
        fields = node.get("fields")
        if not isinstance(fields, list) or isinstance(fields, _Pairs) or not fields:
            say(70, "fields must be a non-empty array of field names")
        else:
            for f in fields:
                if not isinstance(f, str) or not f or f != f.strip(" ") or "," in f:
                    say(70, "fields entries must be non-empty strings without commas or surrounding whitespace")
                if isinstance(f, str) and f not in known:
                    say(71, f"fields contains unknown field: {f}")
    if is_leaf and node.has("query_mode") and str(node.get("query_mode")).lower() not in ("standard", "autocomplete"):
        say(80, "query_mode must be either standard or autocomplete")
    boost = node.get("boost")
    if node.has("boost") and (not _number(boost) or not math.isfinite(boost) or boost < 0):
        say(90, "boost must be finite and non-negative")
    if not is_leaf:
        sizes = {c: len(node.get(c)) if isinstance(node.get(c), list) else 0 for c in _CLAUSES}
        if not sizes["must"] + sizes["should"]:
            say(100, "Boolean group must contain at least one must or should clause")
        least = node.get("minimum_should_match")
        if node.has("minimum_should_match") and (not isinstance(least, int) or isinstance(least, bool) or least < 0 or least > sizes["should"]):
            say(110, "minimum_should_match must be a non-negative integer no greater than the number of should clauses")


def parse(query: str | dict | None, fields: tuple[str, ...], max_leaf_clauses=1024, max_boolean_depth=64) -> Node:
    """The tree of a query, or a ValueError with the first of its errors by rank, then by text."""
    most_leaves, most_depth = _limit(max_leaf_clauses, "max_leaf_clauses"), _limit(max_boolean_depth, "max_boolean_depth")
    text = json.dumps(query) if isinstance(query, dict) else query
    try:
        root = None if text is None else json.loads(text, object_pairs_hook=_Pairs)
    except ValueError as e:
        raise ValueError(f"Malformed JSON: {e}") from None
    if not isinstance(root, _Pairs):
        raise ValueError("query must be a non-null JSON object")
    errors: list[tuple[int, str]] = []
    n_leaves = depth = 0
    todo = [(root, 0)]
    while todo:
        node, level = todo.pop()
        n_leaves, depth = n_leaves + node.has("query"), max(depth, level)
        _wrong(node, fields, errors)
        for c in _CLAUSES:
            value = node.get(c)
            if isinstance(value, list) and not isinstance(value, _Pairs):
                todo += [(x, level + 1) for x in value if isinstance(x, _Pairs)]
    if most_leaves is not None and n_leaves > most_leaves:
        errors.append((120, f"query exceeds max_leaf_clauses of {most_leaves}"))
    if most_depth is not None and depth > most_depth:
        errors.append((121, f"query exceeds max_boolean_depth of {most_depth}"))
    if errors:
        raise ValueError(min(errors)[1])

    def built(node: _Pairs) -> Node:
        boost = float(node.get("boost", 1.0))
        if node.has("query"):
            own = node.get("fields")
            return Node(boost, node.get("query"), tuple(own) if own else None, node.get("query_mode", "standard").lower(), leaf=True)
        must, should, must_not = ([built(x) for x in node.get(c) or []] for c in _CLAUSES)
        return Node(boost, must=must, should=should, must_not=must_not, least=node.get("minimum_should_match", 0 if must else 1))

    return built(root)


def _evaluated(node: Node, place: dict[int, Column]) -> tuple[Column, Column]:
    """Whether a document matches a node, and its score there (0 if it doesn't)."""
    if node.leaf:
        s = place[id(node)]
        return s.isNotNull(), F.coalesce(s, F.lit(0.0)) * node.boost
    true, zero = F.lit(True), F.lit(0.0)
    must, should, must_not = ([_evaluated(c, place) for c in part] for part in (node.must, node.should, node.must_not))
    matched = true
    for m, _ in must:
        matched = matched & m
    if should and node.least:
        matched = matched & (sum((m.cast("int") for m, _ in should), F.lit(0)) >= node.least)
    for m, _ in must_not:
        matched = matched & ~m
    total = sum((s for _, s in must + should), zero)
    return matched, F.when(matched, total * node.boost).otherwise(zero)


def _empty(node: Node) -> bool:
    """Whether a document that no leaf matches does match."""
    if node.leaf:
        return False
    return all(map(_empty, node.must)) and sum(map(_empty, node.should)) >= node.least and not any(map(_empty, node.must_not))


def boolean_scores(index: FtsIndex, query: str | dict | None, max_leaf_clauses=1024, max_boolean_depth=64, **options) -> DataFrame:
    """(name, score) of all documents that match the tree. Equal leaves are searched once; one job scores them all."""
    s, e = split_options(options)
    s.check(index.fields)
    root = parse(query, index.fields, max_leaf_clauses, max_boolean_depth)
    kinds: dict[tuple, int] = {}
    own: dict[int, int] = {}
    for leaf in root.leaves():
        own[id(leaf)] = kinds.setdefault((leaf.query, leaf.fields, leaf.mode), len(kinds))
    leaves = {}
    for (text, fields, mode), n in kinds.items():
        numbers = [i for i, f in enumerate(index.fields) if fields is None or f in fields]
        leaves[n] = (picks_of(index, text, mode, e), numbers)
    found = scores(index, leaves, s).groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("leaf", "score"))).alias("leaves"))
    if _empty(root):
        found = index.docs.select("name").join(found, "name", "left").withColumn("leaves", F.coalesce("leaves", F.create_map().cast("map<int,double>")))
    got = F.col("leaves")
    matched, score = _evaluated(root, {k: F.try_element_at(got, F.lit(n)) for k, n in own.items()})
    return found.select("name", matched.alias("matched"), score.alias("score")).where("matched").select("name", "score")


def search_layered_bm25_query(index: FtsIndex, query: str | dict | None, top_k: int | None = 50, **options) -> DataFrame:
    """docname, score, rank of the best documents for a Boolean tree."""
    return ranked(boolean_scores(index, query, **options), top_k)


def match_layered_bm25_query(index: FtsIndex, df: DataFrame, id_column: str, query: str | dict | None, score_column: str = "score", **options) -> DataFrame:
    """The rows of a table with their scores, null where the tree doesn't match."""
    found = boolean_scores(index, query, **options).select(F.col("name").alias("__name"), F.col("score").alias(score_column))
    return df.join(found, df[id_column] == F.col("__name"), "left").drop("__name")
