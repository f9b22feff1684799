"""Stemmers by their published descriptions, and the column that applies them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from . import porter, romance, snowball

STEMMERS: dict[str, Callable[[str], str]] = {"porter": porter.stem, **snowball.STEMMERS, **romance.STEMMERS}
#: Names that are known but have no stemmer here yet: using one is an error, never the identity.
PLANNED = (
    "arabic armenian basque catalan czech danish dutch dutch_porter english esperanto estonian finnish french german greek hindi hungarian indonesian irish italian lithuanian nepali norwegian "
    "persian polish porter portuguese romanian russian serbian sesotho spanish swedish tamil turkish yiddish"
).split()


def stemmer(name: str) -> Callable[[str], str]:
    if name == "none":
        return lambda s: s
    if name in STEMMERS:
        return STEMMERS[name]
    if name in PLANNED:
        raise NotImplementedError(f"Stemmer '{name}' isn't available yet. Available stemmers are: {sorted(STEMMERS)}, or use 'none' for no stemming")
    raise ValueError(f"Unrecognized stemmer '{name}'. Supported stemmers are: {sorted(STEMMERS)}, or use 'none' for no stemming")


def stem(text: Column, name: str) -> Column:
    """The stem of a whole string; null stays null. Rows go through Arrow in batches; each distinct string of a batch is stemmed once."""
    f = stemmer(name)
    if name == "none":
        return text
    @pandas_udf("string")
    def stems(x: pd.Series) -> pd.Series:
        return x.map({w: f(w) for w in x.dropna().unique()})

    return stems(text)
