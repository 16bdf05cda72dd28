"""Views for annotators and reports: hidden columns, excerpts, bodies shown only where use is allowed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def excerpt(text: Column, most: int) -> Column:
    """At most ``most`` characters; a longer text ends in an ellipsis within that length."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def blind(df: DataFrame, hidden: list[str]) -> DataFrame:
    """``df`` without the hidden columns; a hidden name that survives in a struct raises."""
    out = df.drop(*hidden)
    for field in out.schema.fields:
        inner = getattr(field.dataType, "names", [])
        if set(inner) & set(hidden):
            raise ValueError(f"{field.name} still holds {sorted(set(inner) & set(hidden))}")
    return out


def redact_bodies(articles: DataFrame, provenance: DataFrame) -> DataFrame:
    """Articles with ``body`` null unless some provenance row allows its use; articles without a row show none."""
    allowed = provenance.groupBy("article_id").agg(F.max(F.col("research_use_allowed") & F.col("storage_allowed")).alias("_may"))
    joined = articles.join(allowed, "article_id", "left")
    return joined.withColumn("body", F.when(F.coalesce("_may", F.lit(False)), F.col("body"))).drop("_may")


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """A report table of the first rows of a small result."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else (f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " "))
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join(f"| {' | '.join(cells)} |" for cells in lines)
