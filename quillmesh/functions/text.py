"""Column builders for text keys shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def site(domain: Column) -> Column:
    """Site of a domain: trimmed of white space, lower case, without a leading ``www.``."""
    bare = F.lower(F.regexp_replace(domain, r"^\s+|\s+$", ""))
    return F.regexp_replace(bare, r"^www\.", "")


def letters(text: Column) -> Column:
    """Only the letters (Unicode category L) of a text, in lower case and in order."""
    return F.regexp_replace(F.lower(text), r"\P{L}+", "")


def squash(text: Column) -> Column:
    """Lower case with white space trimmed at both ends."""
    return F.lower(F.regexp_replace(text, r"^\s+|\s+$", ""))


# Languages of the corpus in the spellings that name them.
LANGUAGE_SPELLINGS = {
    "en": ("en", "eng", "english"),
    "de": ("de", "deu", "ger", "german", "deutsch"),
    "fr": ("fr", "fra", "fre", "french", "français"),
    "es": ("es", "spa", "spanish", "español"),
    "ja": ("ja", "jpn", "japanese", "日本語"),
    "zh": ("zh", "zho", "chi", "chinese", "中文"),
    "ko": ("ko", "kor", "korean", "한국어"),
}


def language_code(value: Column) -> Column:
    """Two-letter language of any spelling (code, regional code, English name); ``und`` when unnamed.

    An unlisted spelling keeps its own primary subtag.
    """
    primary = F.regexp_extract(squash(value), r"^([^-_\s]+)", 1)
    out = F.when(value.isNull() | (primary == "") | (primary == "und"), F.lit("und"))
    for code, names in LANGUAGE_SPELLINGS.items():
        out = out.when(primary.isin(*names), F.lit(code))
    return out.otherwise(primary)
