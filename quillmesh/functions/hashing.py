"""Content hashes and stable identifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def _compatible(text: pd.Series) -> pd.Series:
    return text.map(lambda s: " ".join(unicodedata.normalize("NFKC", s).split()).casefold(), na_action="ignore")


def normal_text(text: Column) -> Column:
    """Text for hashing: compatibility form, single blanks, trimmed, case folded.

    ASCII text takes the built-in path, where folding is lower case; the
    vectorised function sees only rows with other characters.
    """
    plain = F.lower(F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " ")))
    other = text.rlike(r"[^\x00-\x7f]")
    return F.when(other, _compatible(F.when(other, text))).otherwise(plain)


def content_hash(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def short_id(prefix: str, length: int, *parts: Column) -> Column:
    """``prefix`` and the first hex digits of the hash of the joined parts; null parts count as empty."""
    joined = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, length))


def pair_id(a: Column, b: Column) -> Column:
    """Identifier of an unordered pair."""
    return F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 24)
