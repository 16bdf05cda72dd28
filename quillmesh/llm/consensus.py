"""Consensus from several annotators' labels: a mean-field variational confusion model.

Items have a hidden class; every annotator has one row of label probabilities
per class. Classes and rows carry Dirichlet priors. A round computes the items'
posteriors from the expected log probabilities of their labels (digammas of the
current counts) and sums them again by annotator and label. Rounds go on until
no posterior moves by more than the tolerance.

While the annotators are few enough to be broadcast (they are counted first), a
round is one pass over items packed with their labels and one group-by of
partial sums, 16 numbers an annotator. Beyond that, or when one item holds very
many labels, a round is two group-bys over skew-safe joins. Both compute the
same sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import dense_index, join_counted
from quillmesh.functions.text import squash
from quillmesh.lineage import Workspace

CLASSES = 4
#: Dirichlet priors: of the classes, and of a row's own and other labels.
CLASS_PRIOR, OWN_PRIOR, OTHER_PRIOR = 1.0, 1.5, 0.6
#: The largest change of a posterior that ends the rounds, and the round by which a model must be there.
TOLERANCE, MOST_ROUNDS = 1e-3, 1000
#: Annotators whose 16 counts may be broadcast, and labels of one item that may stand in one row; both are counted first.
BROADCAST_ANNOTATORS, PACKED_LABELS = 25_000, 10_000
#: Annotators with fewer items are not judged.
LEAST_ITEMS = 6
#: Labels follow the class to a fair degree from this correlation on, by convention a medium one.
FAIR = 0.3
#: Draws from an annotator's posterior, and the ends of its interval.
DRAWS, ENDS = 2000, (0.025, 0.5, 0.975)


def digamma(x: Column) -> Column:
    """Digamma of a positive column: six steps of the recurrence, then the asymptotic series."""
    low = sum((1.0 / (x + k) for k in range(1, 6)), 1.0 / x)
    y = x + 6.0
    inv = 1.0 / (y * y)
    series = F.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240)))
    return series - low


def valid_labels(annotations: DataFrame) -> DataFrame:
    """(item, annotator, label): each annotator's latest label of each item, where it is valid.

    Annotators are compared trimmed and in lower case. The latest completion
    counts even if its label is null or out of range, and then leaves no label;
    of equal times the greater label stands. Null identifiers are left out.
    """
    rows = annotations.select(
        F.col("article_id").alias("item"), squash(F.col("annotator_id")).alias("annotator"),
        F.col("relevance_label").cast("long").alias("label"), F.col("annotation_completed_at").cast("string").alias("at"),
    ).filter(F.col("item").isNotNull() & F.col("annotator").isNotNull())
    last = rows.groupBy("item", "annotator").agg(
        F.max_by(F.struct("label"), F.struct(F.coalesce("at", F.lit("")), "label"))["label"].alias("label")
    )
    return last.filter(F.col("label").between(0, CLASSES - 1)).select("item", "annotator", F.col("label").cast("int").alias("label"))


def _k(name: str) -> list[str]:
    return [f"{name}{k}" for k in range(CLASSES)]


def _digamma(x: np.ndarray) -> np.ndarray:
    """`digamma` of an array."""
    low = sum(1.0 / (x + k) for k in range(6))
    y = x + 6.0
    inv = 1.0 / (y * y)
    return np.log(y) - 0.5 / y - inv * (1 / 12 - inv * (1 / 120 - inv * (1 / 252 - inv / 240))) - low


_PRIORS = np.where(np.eye(CLASSES) > 0, OWN_PRIOR, OTHER_PRIOR)


class _Terms:
    """What a packed round needs to know: evidence by code (annotator, label) and class, and the class terms.

    Without them posteriors are the shares of an item's labels, the start.
    """

    def __init__(self, sums: np.ndarray | None = None, classes: np.ndarray | None = None) -> None:
        self.evidence = self.prior = None
        if sums is not None:
            cells = sums.reshape(-1, CLASSES, CLASSES) + _PRIORS
            self.evidence = (_digamma(cells) - _digamma(cells.sum(1, keepdims=True))).reshape(-1, CLASSES)
            self.prior = _digamma(classes + CLASS_PRIOR) - _digamma((classes + CLASS_PRIOR).sum())

    def posteriors(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """One row of class probabilities per item; every item has at least one code."""
        if self.evidence is None:
            return np.add.reduceat(np.eye(CLASSES)[codes % CLASSES], starts, axis=0) / sizes[:, None]
        logs = np.add.reduceat(self.evidence[codes], starts, axis=0) + self.prior
        weights = np.exp(logs - logs.max(1, keepdims=True))
        return weights / weights.sum(1, keepdims=True)


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flat codes of a column of lists, where each list starts, and its size."""
    ends = column.offsets.to_numpy()
    return column.flatten().to_numpy(), ends[:-1] - ends[0], np.diff(ends)


def _packed_round(now: _Terms, before: _Terms | None, codes_in_all: int) -> Callable:
    """Function over batches of packed items that sums posteriors by code; code -1 sums the classes and holds the largest change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, classes, change = np.zeros((codes_in_all, CLASSES)), np.zeros(CLASSES), 0.0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes, starts, sizes = _lists(batch.column(0))
            q = now.posteriors(codes, starts, sizes)
            if before is not None:
                change = max(change, float(np.abs(q - before.posteriors(codes, starts, sizes)).max()))
            classes += q.sum(0)
            each = np.repeat(q, sizes, axis=0)
            for k in range(CLASSES):
                sums[:, k] += np.bincount(codes, weights=each[:, k], minlength=codes_in_all)
        seen = np.flatnonzero(sums.any(1))
        table = np.vstack((sums[seen], classes))
        columns = [pa.array(np.append(seen, -1).astype(np.int32)), *(pa.array(table[:, k]) for k in range(CLASSES))]
        moved = pa.array(np.append(np.zeros(len(seen)), change))
        yield pa.RecordBatch.from_arrays([*columns, moved], names=["code", *_k("s"), "moved"])

    return run


class Consensus:
    """The fitted model of a label table; one row per item and annotator, as `valid_labels` gives.

    ``rounds`` and ``change`` say how many rounds it took and by how much the
    last one moved a posterior, which is less than ``tolerance``; a model that
    does not settle raises. ``broadcast`` and ``packed`` bound what may be held
    in memory and choose the plan, not the result.
    """

    def __init__(
        self, labels: DataFrame, tolerance: float = TOLERANCE, broadcast: int = BROADCAST_ANNOTATORS, packed: int = PACKED_LABELS
    ) -> None:
        self.ws = Workspace(labels.sparkSession, "consensus")
        self.labels = self.ws.write(labels, "labels")
        self.tolerance, self.rounds, self.change = tolerance, 0, float("inf")
        self.sizes = self.ws.write(self.labels.groupBy("item").agg(F.count(F.lit(1)).alias("n")), "sizes")
        self.given = self.ws.write(self.labels.groupBy("annotator").agg(F.count(F.lit(1)).alias("given")), "annotators")
        most, total = self.sizes.agg(F.max("n"), F.sum("n")).first()
        self.total = int(total or 0)
        annotators = self.given.count()
        self.few = annotators <= broadcast
        if self.few and (most or 0) <= packed:
            self._fit_packed(annotators)
        else:
            self._fit_joined()

    def _settled(self, change: float) -> bool:
        self.rounds += 1
        self.change = change
        if change >= self.tolerance and self.rounds >= MOST_ROUNDS:
            raise RuntimeError(f"the consensus model moves by {change} after {self.rounds} rounds")
        return change < self.tolerance

    # --- annotators few: one pass over packed items a round ---

    def _fit_packed(self, annotators: int) -> None:
        spark = self.labels.sparkSession
        numbered = self.ws.write(dense_index(self.given, "annotator", "a"), "numbered")
        code = (F.col("a") * CLASSES + F.col("label")).cast("int")
        coded = join_counted(self.labels, numbered, ["annotator"], "given", self.total).select("item", code.alias("code"))
        items = self.ws.write(coded.groupBy("item").agg(F.collect_list("code").alias("codes")), "packed")
        now, before, size = _Terms(), None, annotators * CLASSES
        schema = ", ".join(["code int", *(f"{c} double" for c in _k("s")), "moved double"])
        while True:
            parts = items.select("codes").mapInArrow(_packed_round(now, before, size), schema)
            rows = parts.groupBy("code").agg(*(F.sum(c).alias(c) for c in _k("s")), F.max("moved").alias("moved")).toPandas()
            lead = rows[rows["code"] == -1]
            if before is not None and self._settled(float(lead["moved"].iloc[0]) if len(lead) else 0.0):
                break
            sums = np.zeros((size, CLASSES))
            cells = rows[rows["code"] >= 0]
            sums[cells["code"].to_numpy()] = cells[_k("s")].to_numpy()
            now, before = _Terms(sums, lead[_k("s")].to_numpy(float).sum(0)), now
        fitted = now

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    q = fitted.posteriors(*_lists(batch.column(1)))
                    yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(q[:, k]) for k in range(CLASSES))], names=["item", *_k("q")])

        self.items = self.ws.write(items.mapInArrow(place, ", ".join(["item string", *(f"{c} double" for c in _k("q"))])), "items")
        table = pd.DataFrame(fitted.evidence if size else np.zeros((0, CLASSES)), columns=_k("e"))
        table.insert(0, "code", np.arange(size, dtype=np.int64))
        rows = spark.createDataFrame(table, ", ".join(["code long", *(f"{c} double" for c in _k("e"))]))
        named = numbered.select("annotator", F.explode(F.sequence(F.col("a") * CLASSES, F.col("a") * CLASSES + CLASSES - 1)).alias("code"))
        self.evidence = self.ws.write(
            named.join(rows, "code").select("annotator", (F.col("code") % CLASSES).cast("int").alias("label"), *_k("e")), "evidence"
        )

    # --- annotators many or an item with very many labels: two joins and group-bys a round ---

    def _fit_joined(self) -> None:
        share = [F.avg((F.col("label") == k).cast("double")).alias(f"q{k}") for k in range(CLASSES)]
        self.items = self.ws.write(self.labels.groupBy("item").agg(*share), "items")
        self.evidence = self.ws.write(self._terms(), "evidence")
        while True:
            later = self.ws.write(self._expect(), "items")
            settled = self._settled(self._moved(later))
            self.ws.drop(self.items)
            self.items = later
            evidence = self.ws.write(self._terms(), "evidence") if not settled else self.evidence
            if settled:
                break
            self.ws.drop(self.evidence)
            self.evidence = evidence

    def _moved(self, later: DataFrame) -> float:
        old = self.items.select("item", *(F.col(f"q{k}").alias(f"o{k}") for k in range(CLASSES)))
        gap = F.greatest(*(F.abs(F.col(f"q{k}") - F.col(f"o{k}")) for k in range(CLASSES)))
        return later.join(old, "item").agg(F.max(gap)).first()[0] or 0.0

    def _with_items(self) -> DataFrame:
        """Labels with their item's posteriors; a hot item is broadcast."""
        return join_counted(self.labels, self.items.join(self.sizes, "item"), ["item"], "n", self.total).drop("n")

    def _with_evidence(self, labels: DataFrame) -> DataFrame:
        """Labels with their evidence; hot annotators are broadcast, all of them while they are few."""
        if self.few:
            return labels.join(F.broadcast(self.evidence), ["annotator", "label"])
        return join_counted(labels, self.evidence.join(self.given, "annotator"), ["annotator", "label"], "given", self.total).drop("given")

    def _terms(self) -> DataFrame:
        """(annotator, label, e0..): expected log probability of the label under each class.

        All of an annotator's cells come from one aggregation, so labels it
        never gave are there with their prior weight.
        """
        grid = [(label, k) for label in range(CLASSES) for k in range(CLASSES)]
        sums = self._with_items().groupBy("annotator").agg(
            *(F.sum(F.when(F.col("label") == label, F.col(f"q{k}")).otherwise(0.0)).alias(f"s{label}{k}") for label, k in grid)
        )
        cell = lambda label, k: F.col(f"s{label}{k}") + float(_PRIORS[label, k])
        total = [digamma(sum((cell(label, k) for label in range(1, CLASSES)), cell(0, k))) for k in range(CLASSES)]
        rows = F.array(*(
            F.struct(F.lit(label).alias("label"), *((digamma(cell(label, k)) - total[k]).alias(f"e{k}") for k in range(CLASSES)))
            for label in range(CLASSES)
        ))
        return sums.select("annotator", F.inline(rows))

    def _expect(self) -> DataFrame:
        """Items' posteriors from the expected log probabilities of their labels."""
        prior = self.items.agg(
            *((F.coalesce(F.sum(f"q{k}"), F.lit(0.0)) + CLASS_PRIOR).alias(f"c{k}") for k in range(CLASSES))
        )
        total = sum((F.col(f"c{k}") for k in range(1, CLASSES)), F.col("c0"))
        prior = prior.select(*((digamma(F.col(f"c{k}")) - digamma(total)).alias(f"c{k}") for k in range(CLASSES)))
        sums = self._with_evidence(self.labels).groupBy("item").agg(*(F.sum(f"e{k}").alias(f"e{k}") for k in range(CLASSES)))
        logs = sums.crossJoin(F.broadcast(prior)).select("item", *((F.col(f"e{k}") + F.col(f"c{k}")).alias(f"l{k}") for k in range(CLASSES)))
        top = F.greatest(*_k("l"))
        weights = [F.exp(F.col(f"l{k}") - top) for k in range(CLASSES)]
        return logs.select("item", *((w / sum(weights[1:], weights[0])).alias(f"q{k}") for k, w in enumerate(weights)))

    # --- results ---

    def agreed(self) -> DataFrame:
        """(article_id, label, confidence, labels): one agreed label per item, ties to the lower label."""
        best = F.greatest(*_k("q"))
        label = F.coalesce(*(F.when(F.col(f"q{k}") == best, F.lit(k)) for k in range(CLASSES))).cast("long")
        return self.items.join(self.sizes, "item").select(F.col("item").alias("article_id"), label.alias("label"), best.alias("confidence"), F.col("n").alias("labels"))

    def reliability(self) -> DataFrame:
        """One row per annotator: items, and the posterior of its accuracy and of how far its labels follow the class.

        The posterior is a Dirichlet over the 16 cells of label and class: a
        flat prior of weight one plus the annotator's labels spread over the
        classes as the other annotators' labels and the model expect them, its
        own evidence taken out. Accuracy is the mass on equal label and class,
        ``follow`` the correlation of label and class; each comes as median and
        95 % interval.
        """
        own = self._with_evidence(self._with_items())
        freed = [F.col(f"q{k}") * F.exp(-F.col(f"e{k}")) for k in range(CLASSES)]
        mass = sum(freed[1:], freed[0])
        shares = own.select("annotator", "label", *((freed[k] / F.when(mass > 0, mass).otherwise(1.0)).alias(f"f{k}") for k in range(CLASSES)))
        grid = [(label, k) for label in range(CLASSES) for k in range(CLASSES)]
        cells = shares.groupBy("annotator").agg(
            F.count(F.lit(1)).alias("items"),
            F.array(*(F.sum(F.when(F.col("label") == label, F.col(f"f{k}")).otherwise(0.0)) for label, k in grid)).alias("cells"),
        )
        names = ["reliability_low", "reliability", "reliability_high", "follow_low", "follow", "follow_high"]
        schema = ", ".join(["annotator_id string", "items long", *(f"{c} double" for c in names)])

        def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [_posterior(who, np.asarray(c, float)) for who, c in zip(batch["annotator"], batch["cells"], strict=True)]
                out = pd.DataFrame(np.reshape(rows, (len(batch), len(names))), columns=names)
                yield pd.concat([batch[["annotator", "items"]].rename(columns={"annotator": "annotator_id"}).reset_index(drop=True), out], axis=1)

        return cells.mapInPandas(draw, schema)

    def unreliable(self) -> DataFrame:
        """(annotator_id) of those with enough items whose labels more likely than not follow the class less than fairly.

        That is, the posterior gives less than even odds to a correlation of
        FAIR or more: labels that tell nothing stand near 0, opposed ones below.
        """
        judged = self.reliability()
        return judged.filter((F.col("items") >= LEAST_ITEMS) & (F.col("follow") < FAIR)).select("annotator_id")


def _posterior(annotator: str, cells: np.ndarray) -> np.ndarray:
    """Low end, median and high end of accuracy and of correlation, by draws seeded by the annotator's name."""
    rng = np.random.default_rng(int.from_bytes(sha256(annotator.encode()).digest()[:8], "big"))
    joint = rng.dirichlet(np.maximum(0.0, cells) + 1.0 / cells.size, DRAWS).reshape(-1, CLASSES, CLASSES)
    k = np.arange(CLASSES)
    label, known = joint.sum(2), joint.sum(1)
    mean_label, mean_known = label @ k, known @ k
    shared = np.einsum("dij,i,j->d", joint, k, k) - mean_label * mean_known
    spread = (label @ (k * k) - mean_label**2) * (known @ (k * k) - mean_known**2)
    follow = np.where(spread > 1e-12, shared / np.sqrt(np.maximum(spread, 1e-12)), 0.0)
    return np.concatenate((np.quantile(np.einsum("dii->d", joint), ENDS), np.quantile(follow, ENDS)))


def krippendorff(labels: DataFrame) -> DataFrame:
    """One row (metric, items, pairable, alpha) for the nominal, ordinal and interval measures of agreement.

    Items with one label pair with nothing. With no disagreement possible
    (fewer than two labels in use) alpha is null.
    """
    counts = [F.sum((F.col("label") == k).cast("long")).alias(f"m{k}") for k in range(CLASSES)]
    per_item = labels.groupBy("item").agg(F.count(F.lit(1)).alias("m"), *counts).filter("m > 1")
    cells = {
        f"o{c}{k}": F.sum(F.col(f"m{c}") * (F.col(f"m{k}") - (1 if c == k else 0)) / (F.col("m") - 1))
        for c in range(CLASSES)
        for k in range(CLASSES)
    }
    row = per_item.agg(F.count(F.lit(1)).alias("items"), *(F.coalesce(v, F.lit(0.0)).alias(n) for n, v in cells.items()))
    margin = [sum((F.col(f"o{c}{k}") for k in range(1, CLASSES)), F.col(f"o{c}0")) for c in range(CLASSES)]
    n = sum(margin[1:], margin[0])

    def between(c: int, k: int, metric: str) -> Column:
        if metric == "nominal":
            return F.lit(1.0)
        if metric == "interval":
            return F.lit(float((c - k) ** 2))
        low, high = min(c, k), max(c, k)
        inner = sum((margin[g] for g in range(low + 1, high + 1)), margin[low]) - (margin[low] + margin[high]) / 2
        return inner * inner

    def alpha(metric: str) -> Column:
        pairs = [(c, k) for c in range(CLASSES) for k in range(CLASSES) if c != k]
        seen = sum((F.col(f"o{c}{k}") * between(c, k, metric) for c, k in pairs), F.lit(0.0))
        chance = sum((margin[c] * margin[k] * between(c, k, metric) for c, k in pairs), F.lit(0.0))
        return F.when(chance > 0, 1.0 - (n - 1.0) * seen / chance)

    metrics = [F.struct(F.lit(m).alias("metric"), "items", n.alias("pairable"), alpha(m).alias("alpha")) for m in ("nominal", "ordinal", "interval")]
    return row.select(F.inline(F.array(*metrics)))
