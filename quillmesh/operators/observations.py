"""The joined research dataset: what was known before a session, what happened in it, and what followed.

An observation is one topic, symbol and session. Its columns are five structs:
``inputs`` (news features and the market's state at the previous bar),
``contemporaneous`` (the session's own bar), ``targets``, ``quality`` and
``lineage``. Audits raise before anything is written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.hashing import short_id
from quillmesh.operators.joins import active_mapping

# Market features of the previous bar and of the session itself.
PRIOR = (
    "simple_return", "trailing_return_5", "trailing_return_20", "volatility_20", "rolling_parkinson_20", "volume_zscore_20", "log_volume", "dollar_volume",
    "amihud", "distance_from_mean_20", "prior_direction", "vwap_deviation",
)
SAME_SESSION = (
    "volume", "log_volume", "dollar_volume", "trade_count", "vwap_deviation", "close_location", "volume_per_trade", "high_low_range", "true_range", "intraday_return",
)
# Beginnings of names that must never be among the inputs.
FORBIDDEN = ("target_", "forward_", "fwd_", "next_session")


class Leakage(ValueError):
    """An input that was not known in time."""


def market_state(features: DataFrame) -> DataFrame:
    """(symbol, session, prior struct, same struct, history_length): the state at the previous existing bar, and the session's own."""
    w = Window.partitionBy("symbol").orderBy("day")
    prior = F.struct(*(F.lag(c).over(w).alias(f"mkt_prior_{c}") for c in PRIOR))
    same = F.struct(*(F.col(c).alias(f"mkt_{c}") for c in SAME_SESSION))
    return features.select("symbol", F.col("day").alias("session"), prior.alias("prior"), same.alias("same"), F.col("history_length").alias("history"))


def _field(struct: str, name: str) -> Column:
    return F.col(struct)[name]


def build(
    news: DataFrame, mapping: DataFrame, features: DataFrame, targets: DataFrame, news_inputs: list[str], attention: str,
    method: str, version: str = "1", keep_missing_market: bool = False,
) -> DataFrame:
    """Observations of every topic's session and each symbol mapped to the topic on that day.

    ``news`` is (topic, session, available_at, cutoff, ...), ``mapping`` (topic,
    symbol, valid_from, valid_to). Sessions without a bar of the symbol are left
    out, or kept without market structs' values. Market tables are joined on
    (symbol, session), both already grouped by symbol.
    """
    mapped = active_mapping(news, mapping, "topic", "session", "valid_from", "valid_to")
    how = "left" if keep_missing_market else "inner"
    joined = mapped.join(market_state(features), ["symbol", "session"], how)
    ahead = targets.withColumnRenamed("day", "session")
    names = [c for c in ahead.columns if c not in ("symbol", "session", "complete")]
    ahead = ahead.select("symbol", "session", F.col("complete"), F.struct(*(F.col(c).alias(f"target_{c}") for c in names)).alias("targets"))
    full = joined.join(ahead, ["symbol", "session"], "left")
    product = F.col(attention) * _field("prior", "mkt_prior_volatility_20")
    inputs = F.struct(
        *(F.col(c).cast("double").alias(f"news_{c}") for c in news_inputs), *(_field("prior", f"mkt_prior_{c}").cast("double").alias(f"mkt_prior_{c}") for c in PRIOR),
        product.alias("x_attention_volatility"),
    )
    return full.select(
        short_id("obs-", 20, F.lit(method), F.col("topic"), F.col("symbol"), F.col("session")).alias("observation_id"), "topic", "symbol", "session", F.lit(method).alias("method"),
        F.col("available_at").alias("feature_available_at"), F.col("cutoff").alias("feature_cutoff"), inputs.alias("inputs"), F.col("same").alias("contemporaneous"), "targets",
        F.struct(F.col("same").isNotNull().alias("market_present"), F.coalesce("complete", F.lit(False)).alias("targets_complete"), F.coalesce("history", F.lit(0)).cast("long").alias("history_length")).alias("quality"),
        F.struct(F.lit(version).alias("dataset_version"), F.lit(method).alias("news_method")).alias("lineage"),
    )


def audit(observations: DataFrame) -> DataFrame:
    """``observations``, if no input looks ahead: by name, by category, and by the time it became available."""
    names = observations.schema["inputs"].dataType.names
    same = set(observations.schema["contemporaneous"].dataType.names)
    bad = [n for n in names if n.startswith(FORBIDDEN) or n in same]
    if bad:
        raise Leakage(f"inputs hold {bad}")
    late = observations.filter(F.col("feature_available_at") > F.col("feature_cutoff")).limit(1).count()
    if late:
        raise Leakage("an input became available after its cutoff")
    return observations


def require_symbols(market: DataFrame, symbols: list) -> None:
    """Raise unless every symbol has a bar."""
    have = {r["symbol"] for r in market.filter(F.col("symbol").isin(symbols)).select("symbol").distinct().collect()}
    missing = sorted(set(symbols) - have, key=str)
    if missing:
        raise ValueError(f"no bars of {missing}")


def model_rows(observations: DataFrame) -> DataFrame:
    """Identity and inputs only: what a model may see."""
    return observations.select("observation_id", "topic", "symbol", "session", "inputs.*")


def manifest(observations: DataFrame) -> DataFrame:
    """(field, observations, missing) of every input, with the counts of topics, symbols and sessions as fields of their own."""
    names = observations.schema["inputs"].dataType.names
    row = observations.agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(F.col("inputs")[c].isNull().cast("long")).alias(f"m{i}") for i, c in enumerate(names)),
        *(F.count_distinct(c).alias(f"d_{c}") for c in ("topic", "symbol", "session")),
    )
    fields = [F.struct(F.lit(c).alias("field"), F.col("n").alias("observations"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(names)]
    fields += [F.struct(F.lit(f"distinct_{c}").alias("field"), F.col(f"d_{c}").alias("observations"), F.lit(0).cast("long").alias("missing")) for c in ("topic", "symbol", "session")]
    return row.select(F.inline(F.array(*fields)))
