"""Text normalisation for place names."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from martlet.functions.numbers import col


@lru_cache(maxsize=1)
def _latin_folds() -> tuple[str, str]:
    """Accented Latin letters and the plain letter each decomposes to (derived from Unicode)."""
    source, target = [], []
    for code in range(0xC0, 0x250):
        plain = unicodedata.normalize("NFKD", chr(code)).encode("ascii", "ignore").decode("ascii")
        if len(plain) == 1:
            source.append(chr(code))
            target.append(plain)
    return "".join(source), "".join(target)


def normalise(c: Column | str) -> Column:
    """Lower case, no accents, runs of other characters as one space. Built-ins only.

    Combining marks are removed, Latin letters are folded, everything else outside a-z0-9
    separates words.
    """
    source, target = _latin_folds()
    lowered = F.lower(F.trim(col(c)))
    folded = F.translate(F.regexp_replace(lowered, r"\p{M}+", ""), source, target)
    return F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))


@pandas_udf(StringType())
def _nfkd_ascii(text: pd.Series) -> pd.Series:
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def normalise_any_script(c: Column | str) -> Column:
    """As ``normalise`` but with full compatibility decomposition (ligatures, width forms).

    Needs one Arrow round trip per batch, so it is opt-in.
    """
    ascii_only = _nfkd_ascii(F.lower(F.trim(col(c))))
    return F.trim(F.regexp_replace(ascii_only, "[^a-z0-9]+", " "))


def code(c: Column | str) -> Column:
    """State and country codes: upper case, no outer blanks."""
    return F.trim(F.upper(col(c)))
