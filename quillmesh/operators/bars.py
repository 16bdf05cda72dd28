"""Daily bars, lag-only session features and forward targets of a symbol's series.

Offsets are positional: they walk the bars a symbol has, never the calendar.
Every window is partitioned by symbol, so one shuffle on the symbol serves all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.functions.stats import ratio, safe_ln


def daily_bars(trades: DataFrame, symbol: str, at: str, price: Column, size: Column, order: list[str]) -> DataFrame:
    """(symbol, day, open, high, low, close, volume, vwap, trade_count) of a symbol's trades per day.

    ``order`` puts the trades of a day in sequence; trades without a price,
    size or time are left out.
    """
    rows = trades.select(
        F.col(symbol).alias("symbol"), F.to_date(at).alias("day"), price.cast("double").alias("p"), size.cast("double").alias("q"),
        F.struct(*order).alias("seq"),
    ).filter("symbol is not null and day is not null and p is not null and q is not null")
    return rows.groupBy("symbol", "day").agg(
        F.min_by("p", "seq").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "seq").alias("close"),
        F.sum("q").alias("volume"), ratio(F.sum(F.col("p") * F.col("q")), F.sum("q")).alias("vwap"), F.count(F.lit(1)).alias("trade_count"),
    )


def _series(name: str = "symbol") -> Window:
    return Window.partitionBy(name).orderBy("day")


def trailing_known(value: str, size: int, how) -> Column:
    """``how`` over the last ``size`` non-null values up to this row; null while there are fewer.

    The window runs over the non-null rows alone; a row with a null carries
    the value of the last row that had one.
    """
    known = F.col(value).isNotNull()
    frame = Window.partitionBy("symbol", known).orderBy("day").rowsBetween(-(size - 1), 0)
    return F.when(known & (F.count(value).over(frame) == size), how(F.col(value)).over(frame))


def session_features(bars: DataFrame) -> DataFrame:
    """Bars with their self-contained, lagged and trailing features.

    A previous close of zero counts as missing; trailing statistics need their
    full length, or are null; a prior window never holds the current row.
    """
    w = _series()
    prior20 = w.rowsBetween(-20, -1)
    p = F.col("prev")
    base = bars.withColumn("prev", F.nullif(F.lag("close").over(w), F.lit(0.0))).withColumns({
        "lag5": F.lag("close", 5).over(w), "lag20": F.lag("close", 20).over(w), "history_length": F.row_number().over(w) - 1,
        "n20": F.count("volume").over(prior20), "mean_volume20": F.avg("volume").over(prior20), "sd_volume20": F.stddev_samp("volume").over(prior20),
        "mean_close20": F.avg("close").over(prior20),
    })
    c, o, h, low, v = (F.col(x) for x in ("close", "open", "high", "low", "volume"))
    simple = F.when(p > 0, ratio(c, p) - 1)
    full = F.col("n20") == 20
    step = base.withColumns({
        "simple_return": simple,
        "log_return": safe_ln(F.when(p > 0, ratio(c, p))),
        "overnight_return": F.when(p > 0, ratio(o, p) - 1),
        "intraday_return": F.when(o > 0, ratio(c, o) - 1),
        "high_low_range": F.when(c > 0, (h - low) / c),
        "close_location": F.when(h > low, (c - low) / (h - low)).otherwise(0.5),
        "true_range": F.when(p.isNull(), h - low).otherwise(F.greatest(h - low, F.abs(h - p), F.abs(low - p))),
        "parkinson_variance": F.when((h > 0) & (low > 0), F.pow(F.ln(h / low), 2) / (4 * F.ln(F.lit(2.0)))),
        "dollar_volume": c * v,
        "amihud": F.when(c * v > 0, F.abs(simple) / (c * v)),
        "vwap_deviation": F.when(F.col("vwap") > 0, c / F.col("vwap") - 1),
        "volume_per_trade": ratio(v, F.col("trade_count")),
        "log_volume": F.log1p(v),
        "trailing_return_5": F.when(F.col("lag5") > 0, c / F.col("lag5") - 1),
        "trailing_return_20": F.when(F.col("lag20") > 0, c / F.col("lag20") - 1),
        "volume_zscore_20": F.when(full & (F.col("sd_volume20") > 0), (v - F.col("mean_volume20")) / F.col("sd_volume20")),
        "distance_from_mean_20": F.when(full & (F.col("mean_close20") > 0), c / F.col("mean_close20") - 1),
        "prior_direction": F.when(simple.isNotNull(), F.when(simple > 0, 1).otherwise(-1)),
    })
    known = step.withColumns({
        "_vol": trailing_known("log_return", 20, F.stddev_samp), "_park": trailing_known("parkinson_variance", 20, F.avg)
    })
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return known.withColumns({
        "volatility_20": F.last("_vol", ignorenulls=True).over(upto), "rolling_parkinson_20": F.last("_park", ignorenulls=True).over(upto)
    }).drop("_vol", "_park", "prev", "lag5", "lag20", "n20", "mean_volume20", "sd_volume20", "mean_close20")


def forward_targets(bars: DataFrame, benchmark: DataFrame, horizon: int = 5, keep: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, day, ``keep``) with what follows over ``horizon`` bars from this one on.

    ``benchmark`` is a bar series (day, close) of its own; each leg's returns
    walk its own positions. A horizon is complete only when the previous bar
    and all of its bars exist; otherwise its targets are null.
    """
    w = _series()
    ahead, prior = w.rowsBetween(0, horizon - 1), w.rowsBetween(-20, -1)
    returns = bars.withColumn("prev", F.nullif(F.lag("close").over(w), F.lit(0.0))).withColumn("r", ratio(F.col("close"), F.col("prev")) - 1)
    own = returns.withColumns({
        "_n": F.count(F.lit(1)).over(ahead), "_end": F.lead("close", horizon - 1).over(w), "_sd": F.stddev_samp("r").over(ahead),
        "_rn": F.count("r").over(ahead), "_va": F.avg("volume").over(ahead), "_vp": F.avg("volume").over(prior), "_sum": F.sum("r").over(ahead),
    })
    one = Window.partitionBy(F.lit(0)).orderBy("day")
    market = benchmark.withColumn("rb", ratio(F.col("close"), F.nullif(F.lag("close").over(one), F.lit(0.0))) - 1).withColumns({
        "_bn": F.count("rb").over(one.rowsBetween(0, horizon - 1)), "_bsum": F.sum("rb").over(one.rowsBetween(0, horizon - 1))
    }).select("day", F.col("rb").alias("benchmark_return"), "_bn", "_bsum")
    done = (F.col("_n") == horizon) & F.col("prev").isNotNull()
    # The benchmark has one bar a day, so its side is bounded by the number of days.
    return own.join(F.broadcast(market), "day", "left").select(
        "symbol", "day", *keep, F.col("r").alias("session_return"), F.abs("r").alias("absolute_return"), "benchmark_return",
        (F.col("r") - F.col("benchmark_return")).alias("benchmark_adjusted_return"), done.alias("complete"),
        F.when(done, ratio(F.col("_end"), F.col("prev")) - 1).alias("cumulative_return"),
        F.when(done & (F.col("_rn") == horizon) & (F.col("_bn") == horizon), F.col("_sum") - F.col("_bsum")).alias("cumulative_adjusted_return"),
        F.when(done & (F.col("_rn") >= 2), F.col("_sd")).alias("return_std"),
        F.when(done, ratio(F.col("_va"), F.col("_vp"))).alias("volume_ratio"),
    )
