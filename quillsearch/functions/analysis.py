"""Text analysis as Spark columns: to text, without accents, lower case, split into tokens, without stopwords."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

DEFAULT_IGNORE = "[0-9!@#$%^&*()_+={}\\[\\]:;<>,.?~\\\\/\\|'\"`-]+"
#: White space that parts tokens, in so many words: Java's own class has one character more.
WHITE = "[\\t\\n\\f\\r ]+"
TOKENIZERS = ("regex", "standard", "opensearch_standard")

_EMOJI = (
    "\\x{231A}\\x{231B}\\x{23E9}-\\x{23EC}\\x{23F0}\\x{23F3}\\x{25FD}\\x{25FE}\\x{2614}\\x{2615}\\x{2648}-\\x{2653}\\x{267F}\\x{2693}\\x{26A1}\\x{26AA}\\x{26AB}\\x{26BD}\\x{26BE}"
    "\\x{26C4}\\x{26C5}\\x{26CE}\\x{26D4}\\x{26EA}\\x{26F2}\\x{26F3}\\x{26F5}\\x{26FA}\\x{26FD}\\x{2705}\\x{270A}\\x{270B}\\x{2728}\\x{274C}\\x{274E}\\x{2753}-\\x{2755}\\x{2757}\\x{2795}-\\x{2797}"
    "\\x{27B0}\\x{27BF}\\x{2B1B}\\x{2B1C}\\x{2B50}\\x{2B55}\\x{1F000}-\\x{1FAFF}"
)
_SINGLE = f"[\\p{{IsHan}}\\p{{IsHiragana}}{_EMOJI}]"
_WORD = f"[[\\p{{IsAlphabetic}}\\p{{Nd}}\\p{{IsKatakana}}\\x{{30FC}}\\x{{FF70}}]&&[^\\p{{IsHan}}\\p{{IsHiragana}}{_EMOJI}\\p{{P}}\\s]]"
_MORE = f"(?:{_WORD}|\\p{{M}})"
_ASCII, _OTHER = "[A-Za-z0-9]", "(?=[^\\x00-\\x7F])"
#: Words of any script; characters of scripts without spaces, and emoji, by themselves. Of ASCII only letters and digits are in the
#: classes, which take long to test, so those are tried for other characters alone; what was taken is never given back.
STANDARD_TOKEN = f"(?:{_ASCII}++|{_OTHER}{_WORD})(?:{_ASCII}++|{_OTHER}{_MORE}|['\\x{{2019}}._](?={_ASCII}|{_OTHER}{_MORE}))*+|{_OTHER}{_SINGLE}"
#: The same by the classes alone.
STANDARD_TOKEN_PLAIN = f"{_SINGLE}|{_WORD}(?:{_MORE}|['\\x{{2019}}._](?={_MORE}))*"


@cache
def english_stopwords() -> tuple[str, ...]:
    return tuple((Path(__file__).parent / "stopwords_en.txt").read_text().split())


@dataclass(frozen=True)
class Analyzer:
    """How texts become tokens. strip_accents: by default as the tokenizer has it. stopwords: 'english', 'none', or the words themselves. ignore: a regular expression of what parts tokens, in Java's syntax."""

    tokenizer: str = "regex"
    stemmer: str = "porter"
    stopwords: str | tuple[str, ...] = "english"
    ignore: str = DEFAULT_IGNORE
    strip_accents: bool | None = None
    lower: bool = True

    def __post_init__(self) -> None:
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"Unrecognized tokenizer '{self.tokenizer}'. Supported tokenizers are: {list(TOKENIZERS)}")
        if self.standard and self.strip_accents:
            raise ValueError(f"strip_accents=true is not supported with tokenizer '{self.tokenizer}'")

    @property
    def standard(self) -> bool:
        return self.tokenizer != "regex"

    def words(self) -> tuple[str, ...]:
        if self.stopwords == "none":
            return ()
        return english_stopwords() if self.stopwords == "english" else tuple(w for w in self.stopwords if w is not None)

    def normalised(self, text: Column) -> Column:
        if (not self.standard) if self.strip_accents is None else self.strip_accents:
            text = strip_accents(text)
        return F.lower(text) if self.lower else text

    def tokens(self, text: Column) -> Column:
        """All tokens that aren't empty or stopwords, in order; null gives none."""
        text = F.coalesce(self.normalised(text), F.lit(""))
        found = F.regexp_extract_all(text, F.lit(STANDARD_TOKEN), 0) if self.standard else F.split(text, f"({self.ignore})|{WHITE}", -1)
        stop = self.words()
        if not stop:
            return F.filter(found, lambda t: t != "")
        return F.filter(found, lambda t: (t != "") & ~t.isin(*stop))


def strip_accents(text: Column) -> Column:
    """Without combining marks; letters that aren't made of a letter and a mark stay. ASCII texts are left alone."""
    apart = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(False))
    bare = F.regexp_replace(apart, "\\p{M}+", "")
    return F.when(text.rlike("[^\\x00-\\x7F]"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), bare, F.lit(False))).otherwise(text)


def as_text(df: DataFrame, name: str) -> Column:
    """Any column as text: structs, arrays and maps as JSON, so that the names of their fields can be found too."""
    c = F.col("`" + name.replace("`", "``") + "`")
    kind = df.schema[name].dataType
    return F.to_json(c) if isinstance(kind, (T.StructType, T.MapType, T.ArrayType)) else c.cast("string")


def tokenize_standard(text: Column) -> Column:
    """The words of a text by the standard tokenizer, as they are written."""
    return F.when(text.isNotNull(), F.regexp_extract_all(text, F.lit(STANDARD_TOKEN), 0))


def query_tokens(spark: SparkSession, analyzer: Analyzer, query: str | None) -> list[str]:
    """The tokens of a query, by the same columns as those of the documents."""
    if query is None:
        return []
    return list(spark.range(1).select(analyzer.tokens(F.lit(query)).alias("t")).first()["t"])


def utf8_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance over UTF-8 bytes, in which what is transposed may be edited again."""
    x, y = a.encode(), b.encode()
    far = len(x) + len(y)
    rows: dict[tuple[int, int], int] = {(-1, -1): far}
    for i in range(len(x) + 1):
        rows[i, -1], rows[i, 0] = far, i
    for j in range(len(y) + 1):
        rows[-1, j], rows[0, j] = far, j
    seen: dict[int, int] = {}
    for i in range(1, len(x) + 1):
        match = 0
        for j in range(1, len(y) + 1):
            k, m = seen.get(y[j - 1], 0), match
            same = x[i - 1] == y[j - 1]
            if same:
                match = j
            rows[i, j] = min(rows[i - 1, j - 1] + (not same), rows[i, j - 1] + 1, rows[i - 1, j] + 1, rows[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        seen[x[i - 1]] = i
    return rows[len(x), len(y)]


def damerau(a: Column, b: Column) -> Column:
    """The distance as a column, in Arrow batches; each distinct pair of a batch is compared once."""
    @pandas_udf("long")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], int] = {}
        out = []
        for p, q in zip(x, y):
            if p is None or q is None:
                out.append(None)
            else:
                if (p, q) not in known:
                    known[p, q] = utf8_distance(p, q)
                out.append(known[p, q])
        return pd.Series(out, dtype="Int64")

    return distance(a, b)

