"""Event-versus-control comparison of session responses, with block bootstrap intervals."""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import exact_medians
from quillmesh.lineage import Workspace

#: Draws of a bootstrap, sessions per block, seed, and what is added to the seed for the control draws.
DRAWS, BLOCK, SEED, CONTROL_SEED = 2000, 5, 12345, 10_000_019


def classify(df: DataFrame, score: str, threshold: float = 2.0) -> DataFrame:
    """``df`` with ``kind``: event at or above the threshold, control below it, unclassified without a score."""
    kind = F.when(F.col(score).isNull() | F.isnan(score), "unclassified").when(F.col(score) >= threshold, "event").otherwise("control")
    return df.withColumn("kind", kind)


def long_responses(df: DataFrame, keep: list[str], responses: list[str]) -> DataFrame:
    """One row per response of each row; missing responses are left out."""
    pairs = F.array(*(F.struct(F.lit(r).alias("response"), F.col(r).cast("double").alias("value")) for r in responses))
    return df.select(*keep, F.inline(pairs)).filter("value is not null")


def describe_groups(long: DataFrame, groups: list[str]) -> DataFrame:
    """Descriptive statistics of each response: overall, and by each group column, from one set of groupings; medians are exact."""
    names = F.array(*(F.struct(F.lit(g).alias("grouping"), F.col(g).cast("string").alias("member")) for g in groups))
    every = F.concat(F.array(F.struct(F.lit("all").alias("grouping"), F.lit("all").alias("member"))), names)
    # Written once: the statistics and the three passes of the medians would else each compute the responses again.
    ws = Workspace(long.sparkSession, "responses")
    kept = ws.write(long.select("kind", "response", "value", *groups), "long")
    rows = kept.select("kind", "response", "value", F.inline(every)).filter("member is not null")
    keys = ["grouping", "member", "kind", "response"]
    described = ws.write(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("minimum"),
        F.max("value").alias("maximum"), F.avg((F.col("value") > 0).cast("double")).alias("positive_fraction"),
    ), "described")
    ends = described.select(*keys, F.col("minimum").alias("_lo"), F.col("maximum").alias("_hi"), F.col("n").alias("_n"))
    return described.join(exact_medians(rows, keys, "value", ends=ends), keys).select(
        *keys, "n", "mean", "median", "std", "minimum", "maximum", "positive_fraction"
    )


def session_means(long: DataFrame, session: str, by: list[str]) -> DataFrame:
    """Mean of each session first, so that a crowded session weighs no more than another."""
    return long.groupBy(*by, "kind", "response", session).agg(F.avg("value").alias("value"))


def contrasts(means: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Event minus control of the session means, with sizes and whether both sides have enough sessions."""
    side = lambda kind, agg: agg(F.when(F.col("kind") == kind, F.col("value")))
    out = means.groupBy(*by, "response").agg(
        side("event", F.count).alias("event_sessions"), side("control", F.count).alias("control_sessions"),
        side("event", F.avg).alias("event_mean"), side("control", F.avg).alias("control_mean"),
        side("event", F.stddev_samp).alias("event_sd"), side("control", F.stddev_samp).alias("control_sd"),
    )
    gap = F.col("event_mean") - F.col("control_mean")
    se = F.sqrt(F.pow("event_sd", 2) / F.col("event_sessions") + F.pow("control_sd", 2) / F.col("control_sessions"))
    return out.select(
        *by, "response", "event_sessions", "control_sessions", "event_mean", "control_mean", gap.alias("difference"),
        F.try_divide("event_mean", F.nullif("control_mean", F.lit(0.0))).alias("ratio"), F.when(se > 0, gap / se).alias("welch_t"),
        ((F.col("event_sessions") >= least) & (F.col("control_sessions") >= least)).alias("eligible"),
    )


@lru_cache(maxsize=8)
def _words(draws: int, seed: int, count: int) -> np.ndarray:
    """The first 32-bit outputs of each draw's generator, one row per draw."""
    raw = (random.Random(seed + i).getrandbits(32 * count).to_bytes(4 * count, "little") for i in range(draws))
    return np.frombuffer(b"".join(raw), "<u4").reshape(draws, count)


def _block_starts(n: int, blocks: int, draws: int, seed: int) -> np.ndarray:
    """Where each block of each draw starts, one row per draw: what ``randrange(n)`` of its seeded generator gives.

    ``randrange`` takes the top bits of each output and skips those from n on; here for all draws at once.
    """
    bits = n.bit_length()
    width = int(blocks * 2**bits / n + 6 * blocks**0.5) + 8
    while True:
        at = _words(draws, seed, 1 << (width - 1).bit_length())[:, :width] >> (32 - bits)
        taken = at < n
        nth = taken.cumsum(axis=1, dtype=np.int32)
        if nth[:, -1].min() >= blocks:
            return at[taken & (nth <= blocks)].reshape(draws, blocks)
        width *= 2


def draw_means(rows: np.ndarray, draws: int, block: int, seed: int) -> np.ndarray:
    """Means of circular block resamples of sequences of one length, a row each, with one seeded generator per draw.

    A draw is the sum of the windows that start where its blocks do, so all sequences times all draws are one
    product with the counts of the starts.
    """
    n = rows.shape[1]
    size = min(block, n)
    blocks = -(-n // size)
    wrapped = np.concatenate([rows, rows[:, : size - 1]], axis=1)
    starts = _block_starts(n, blocks, draws, seed)
    whole = np.zeros(rows.shape)  # sums of the first values from each start; the last block may be shorter
    for k in range(size):
        whole += wrapped[:, k : k + n]
        if k + 1 == n - (blocks - 1) * size:
            total = whole[:, starts[:, -1]]
    starts = starts[:, :-1].astype(np.int64)
    if len(rows) < 4 or not np.isfinite(whole).all():
        for row, out in zip(whole, total, strict=True):
            out += row[starts].sum(axis=1)
        return total / n
    part = max(1, 4_000_000 // n)
    for at in range(0, draws, part):
        some = starts[at : at + part]
        counts = np.bincount((some + np.arange(len(some))[:, None] * n).ravel(), minlength=len(some) * n)
        total[:, at : at + part] += whole @ counts.reshape(len(some), n).T.astype(float)
    return total / n


def block_draws(values: list[float], draws: int, block: int, seed: int) -> list[float]:
    """Means of circular block resamples of a sequence, one seeded generator per draw."""
    return draw_means(np.asarray([values], float), draws, block, seed)[0].tolist()


def _quantile(ordered: list[float], q: float) -> float:
    at = q * (len(ordered) - 1)
    low = int(at)
    high = min(low + 1, len(ordered) - 1)
    return ordered[low] + (ordered[high] - ordered[low]) * (at - low)


def mean_interval(values: list[float], draws: int = DRAWS, seed: int = SEED) -> tuple[float | None, float | None]:
    """95 % interval of a mean by resampling single values with one seeded generator; none for fewer than two values.

    For the values of one small group; a group of records is summed by session first.
    """
    n = len(values)
    if n < 2:
        return None, None
    pick = random.Random(seed)
    at = np.array([[pick.randrange(n) for _ in range(n)] for _ in range(draws)])
    means = sorted(np.asarray(values, float)[at].mean(axis=1).tolist())
    return _quantile(means, 0.025), _quantile(means, 0.975)


def study_window(df: DataFrame, day: str, start: object = None, end: object = None) -> DataFrame:
    """Rows of the days from start to end, both inside; an open end does not bound."""
    if start is not None:
        df = df.filter(F.col(day) >= F.lit(start))
    return df if end is None else df.filter(F.col(day) <= F.lit(end))


#: Rows and contrasts that a task resamples at a time: some 100 MB.
_ROWS, _CONTRASTS = 500_000, 4_000


def _by_length(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(lengths, kind="stable")
    found, first = np.unique(lengths[order], return_index=True)
    return [(int(n), at) for n, at in zip(found, np.split(order, first[1:]), strict=True)]


class _Side:
    """The session means of all contrasts of one kind, end to end: how many each has, where it starts."""

    def __init__(self, values: list[np.ndarray], sizes: list[np.ndarray]) -> None:
        self.values, self.sizes = np.concatenate(values), np.concatenate(sizes)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def means(self) -> np.ndarray:
        out = np.full(len(self.sizes), np.nan)
        some = np.flatnonzero(self.sizes)
        if len(some):
            out[some] = np.add.reduceat(self.values, self.starts[some]) / self.sizes[some]
        return out

    def drawn(self, contrasts: np.ndarray, draws: int, block: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(which of the contrasts, their draws), by length."""
        for n, same in _by_length(self.sizes[contrasts]):
            for which in np.array_split(same, -(-len(same) * n // _ROWS)):
                at = self.starts[contrasts[which]]
                yield which, draw_means(self.values[at[:, None] + np.arange(n)], draws, block, seed)


def _intervals(event: _Side, control: _Side, contrasts: np.ndarray, draws: int, block: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.empty(len(contrasts)), np.empty(len(contrasts))
    ends = [int(q * (draws - 1)) for q in (0.025, 0.975)]
    ranks = sorted({min(k, draws - 1) for e in ends for k in (e, e + 1)})
    for first in range(0, len(contrasts), _CONTRASTS):
        some = contrasts[first : first + _CONTRASTS]
        drawn = np.empty((len(some), draws))
        for which, means in event.drawn(some, draws, block, seed):
            drawn[which] = means
        for which, means in control.drawn(some, draws, block, seed + CONTROL_SEED):
            gaps = np.partition(drawn[which] - means, ranks, axis=1)
            low[first + which], high[first + which] = _quantile(gaps.T, 0.025), _quantile(gaps.T, 0.975)
    return low, high


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each value differs from the one before; the first does."""
    column = column.combine_chunks()
    a, b = column[1:], column[:-1]
    other = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    return np.concatenate([[True], other | (a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False))])


def _resampled(rows: pa.Table, keys: list[str], responses: list[str], draws: int, block: int, seed: int) -> pa.Table:
    """The contrasts of all groups in rows that are ordered by keys and session."""
    new = np.zeros(len(rows), bool)
    new[0] = True
    for c in keys:
        new |= _changes(rows[c])
    group, groups = np.cumsum(new) - 1, int(new.sum())
    session = np.cumsum(new | _changes(rows["_session"]))
    is_event = rows["_event"].to_numpy()
    sides = []
    for want in (True, False):
        values, sizes = [], []
        for r in responses:
            at = np.flatnonzero((is_event == want) & rows[r].is_valid().to_numpy())
            value, g, s = rows[r].to_numpy()[at], group[at], session[at]
            first = np.flatnonzero(np.diff(s, prepend=-1))
            if len(first) < len(s):  # several rows of a session
                value, g = np.add.reduceat(value, first) / np.diff(first, append=len(s)), g[first]
            values.append(value)
            sizes.append(np.bincount(g, minlength=groups))
        sides.append(_Side(values, sizes))
    event, control = sides
    there = np.flatnonzero(event.sizes + control.sizes)
    enough = np.minimum(event.sizes, control.sizes)[there] >= 2
    low, high = np.full(len(there), np.nan), np.full(len(there), np.nan)
    low[enough], high[enough] = _intervals(event, control, there[enough], draws, block, seed)
    heads = rows.select(keys).take(np.flatnonzero(new)[there % groups])
    out = {c: heads[c] for c in keys}
    out.setdefault("response", pa.array([responses[k] for k in there // groups], pa.string()))
    numbers = {"difference": (event.means() - control.means())[there], "low": low, "high": high}
    return pa.table(out | {c: pa.array(v, pa.float64(), mask=~enough) for c, v in numbers.items()})


def bootstrap_differences(means: DataFrame, session: str, by: list[str], draws: int = DRAWS, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """95 % interval of event minus control by circular block bootstrap over sessions in order; null for a side of fewer than two.

    ``means`` has ``response`` and ``value``, or a column for each response; rows of one session are averaged
    first. A task holds the session means of some groups, of one at least: one number per session.
    """
    keys = [*by, *(["response"] if "response" in means.columns else [])]
    responses = ["value"] if "response" in keys else [c for c in means.columns if c not in (*by, "kind", session)]
    fields = "".join(f"{c} {means.schema[c].dataType.simpleString()}, " for c in by)
    schema = f"{fields}response string, difference double, low double, high double"

    def resample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> list[pa.RecordBatch]:
            return _resampled(rows, keys, responses, draws, block, seed).to_batches(10_000) if len(rows) else []

        held: list[pa.RecordBatch] = []
        size, most = 0, _ROWS
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < most:
                continue
            rows = pa.Table.from_batches(held)
            new = np.zeros(len(rows), bool)
            for c in keys:
                new |= _changes(rows[c])
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            yield from done(rows[:cut])
            held = rows[cut:].to_batches()
            size -= cut
            most = max(_ROWS, 2 * size)  # a group that is larger is not looked through for every batch
        if held:
            yield from done(pa.Table.from_batches(held))

    rows = means.filter(F.col("kind").isin("event", "control")).select(
        *keys, F.col(session).alias("_session"), (F.col("kind") == "event").alias("_event"), *(F.col(r).cast("double").alias(r) for r in responses)
    )
    rows = rows.repartition(*keys) if keys else rows.repartition(1)
    return rows.sortWithinPartitions(*keys, "_session").mapInArrow(resample, schema)


def bootstrap_contrasts(wide: DataFrame, session: str, member: str, responses: list[str], draws: int = DRAWS) -> DataFrame:
    """(``member``, response, difference, low, high): the pooled contrasts, where ``member`` is null, and those of each member.

    ``wide`` has a column for each response; a missing one is left out.
    """
    pooled = wide.groupBy("kind", session).agg(*(F.avg(r).alias(r) for r in responses))
    each = wide.filter(F.col(member).isNotNull()).select(member, "kind", session, *responses)
    return bootstrap_differences(each, session, [member], draws).unionByName(
        bootstrap_differences(pooled, session, [], draws).withColumn(member, F.lit(None).cast(wide.schema[member].dataType))
    )


def median_split(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with ``out``: low at or below the median of ``value``, high above it, null without a value."""
    middle = exact_medians(df.withColumn("_all", F.lit(1)), ["_all"], value).select(F.col("median").alias("_m"))
    side: Column = F.when(F.col(value).isNull(), None).when(F.col(value) <= F.col("_m"), "low").otherwise("high")
    return df.join(F.broadcast(middle), F.lit(True), "left").withColumn(out, side).drop("_m")
