"""Entity linking: dictionary aliases found in text with their offsets, longest alias of an entity first."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def alias_pattern(aliases: list[tuple[str, str]]) -> tuple[re.Pattern[str], dict[str, list[str]]]:
    """One pattern over all aliases, longest first, and the entities each lower-cased alias may mean."""
    owners: dict[str, list[str]] = {}
    for entity, alias in aliases:
        text = alias.strip().lower()
        if text and entity not in owners.setdefault(text, []):
            owners[text].append(entity)
    ordered = sorted(owners, key=lambda a: (-len(a), a))
    body = "|".join(map(re.escape, ordered)) or r"(?!)"
    return re.compile(rf"(?<![^\W_])(?:{body})(?![^\W_])", re.IGNORECASE), owners


def link_entities(df: DataFrame, identity: str, text: str, aliases: list[tuple[str, str]]) -> DataFrame:
    """(``identity``, entity_id, alias, start_at, end_at, ambiguous) of every whole-word alias in a text.

    Matching ignores case; overlapping aliases leave the longest. An alias of
    several entities gives a row for each, marked ambiguous. The dictionary is
    part of the function, so its size is that of the driver's list.
    """
    pattern, owners = alias_pattern(aliases)
    schema = T.StructType([
        df.schema[identity], T.StructField("entity_id", T.StringType()), T.StructField("alias", T.StringType()),
        T.StructField("start_at", T.LongType()), T.StructField("end_at", T.LongType()), T.StructField("ambiguous", T.BooleanType()),
    ])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for found in pattern.finditer(value) if value else ():
                    entities = owners.get(found[0].lower(), [])
                    for entity in entities:
                        at.append(i)
                        rows.append((entity, found[0].lower(), found.start(), found.end(), len(entities) > 1))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names
            )

    return df.select(identity, text).mapInArrow(search, schema)


def link_summary(links: DataFrame, identity: str) -> DataFrame:
    """(entity_id, documents, mentions, ambiguous_mentions) of linked text."""
    return links.groupBy("entity_id").agg(
        F.count_distinct(identity).alias("documents"), F.count(F.lit(1)).alias("mentions"), F.sum(F.col("ambiguous").cast("long")).alias("ambiguous_mentions")
    )
