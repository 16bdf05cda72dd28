"""Drawing a sample that matches target category proportions, by swap repair over signature counts.

Records of a frame are grouped by category signature (their language or their
set of roles). A random sample that satisfies the floors is held as counts per
signature only; exchanging counts between two signatures repairs the deviation
from the targets until no exchange lowers it. The records are drawn last, by
hash order within each signature.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import bounded_broadcast, hash_bucket, take_ranked
from quillmesh.functions.text import language_code, squash
from quillmesh.lineage import Workspace

#: Signatures tried against one another at once.
BLOCK = 256
#: Records up to which splits of a draw follow the exact hypergeometric law.
EXACT_DRAW = 10**9
_PLAN = (
    "request_id string, category_kind string, category string, signature string, take long, "
    "available long, wanted long, floor long, share double, reached double, met boolean, reachable boolean"
)


def frame_units(units: DataFrame, articles: DataFrame) -> DataFrame:
    """(frame_id, article_id, language, roles), one row per frame and article.

    Roles are trimmed, lower-cased, split at ``|`` and united over repeated
    rows; an article unknown to ``articles`` or without a language is ``und``.
    Rows without a frame or an article are left out.
    """
    split = F.split(F.array_join("sample_roles", "|"), r"\|")
    roles = F.array_sort(F.array_distinct(F.filter(F.transform(split, squash), lambda x: x != "")))
    whole = (
        units.filter(F.col("frame_id").isNotNull() & F.col("article_id").isNotNull())
        .groupBy("frame_id", "article_id")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.coalesce(roles, F.array().cast("array<string>")))))).alias("roles"))
    )
    code = language_code(F.col("language"))
    languages = articles.groupBy("article_id").agg(F.min(F.struct(code == "und", code.alias("code")))["code"].alias("language"))
    return whole.join(languages, "article_id", "left").withColumn("language", F.coalesce("language", F.lit("und")))


def _seed(text: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))


def swap_repair(
    sizes: np.ndarray, member: np.ndarray, goal: np.ndarray, floor: np.ndarray, total: int, rng: np.random.Generator
) -> np.ndarray:
    """Counts per signature, summing to ``total``, that no single exchange brings nearer to ``goal``.

    ``member[c, s]`` says whether signature s belongs to category c. The start
    is a random sample that meets the floors as far as ``total`` allows. Missing
    floors weigh more than any deviation, so they are never given up for it. An
    exchange moves as many records as lower the cost most; the signatures that
    gain most alone are tried first, all of them, in blocks, before the repair ends.
    """
    take = start_sample(sizes, member, floor, total, rng)
    if not len(goal):
        return take
    heavy = 4.0 * (float(total) ** 2 * len(goal) + 1.0)

    def moves(counts: np.ndarray, step: int) -> np.ndarray:
        """What ``step`` more records of each category add to the cost; differences, so that large counts stay exact."""
        return step * (2 * (counts - goal) + step) + heavy * (np.maximum(0, floor - counts - step) - np.maximum(0, floor - counts))

    def cost(counts: np.ndarray) -> int:
        whole = [(int(c), int(g), int(f)) for c, g, f in zip(counts, goal, floor, strict=True)]
        return sum((c - g) ** 2 + int(heavy) * max(0, f - c) for c, g, f in whole)

    def best_of(sources: np.ndarray, targets: np.ndarray, step: int) -> tuple[float, int, int]:
        """The exchange of ``step`` records from one of ``sources`` to one of ``targets`` that lowers the cost most."""
        sources, targets = sources[take[sources] >= step], targets[room[targets] >= step]
        if not len(sources) or not len(targets):
            return 0.0, -1, -1
        # A category of both keeps its count, so what it would gain and lose is taken out again.
        change = lose[sources][:, None] + gain[targets][None, :] - (member[:, sources] * both[:, None]).T @ member[:, targets]
        at = int(change.argmin())
        return float(change.flat[at]), int(sources[at // len(targets)]), int(targets[at % len(targets)])

    step = max(1, int(min(take.max(initial=0), (sizes - take).max(initial=0))))
    while True:
        counts, room = (member @ take).astype(float), sizes - take
        more, less = moves(counts, step), moves(counts, -step)
        both, gain, lose = more + less, member.T @ more, member.T @ less
        best, move = -0.5, None
        change, i, j = best_of(np.argsort(lose, kind="stable")[:BLOCK], np.argsort(gain, kind="stable")[:BLOCK], step)
        if change < best:
            best, move = change, (i, j)
        # The cost is convex in the size of an exchange: where no single record's exchange helps, none does.
        if move is None and step == 1 and len(sizes) > BLOCK:
            for first in range(0, len(sizes), BLOCK):
                change, i, j = best_of(np.arange(first, min(first + BLOCK, len(sizes))), np.arange(len(sizes)), step)
                if change < best:
                    best, move = change, (i, j)
        if move is not None:
            later = take.copy()
            later[move[0]] -= step
            later[move[1]] += step
            # Compared in whole numbers, so that every exchange lowers the cost and the repair ends.
            if cost(member @ later) < cost(counts):
                take = later
                continue
        if step == 1:
            return take
        step //= 2


def start_sample(sizes: np.ndarray, member: np.ndarray, floor: np.ndarray, total: int, rng: np.random.Generator) -> np.ndarray:
    """Random counts per signature that sum to ``total``: scarce categories' floors first, the rest from all that is left."""
    take = np.zeros(len(sizes), np.int64)
    spare = member @ sizes - floor if len(floor) else floor
    for c in np.argsort(spare, kind="stable"):
        short = min(int(floor[c] - member[c] @ take), total - int(take.sum()))
        if short > 0:
            take += random_counts((sizes - take) * member[c], short, rng)
    return take + random_counts(sizes - take, total - int(take.sum()), rng)


def random_counts(sizes: np.ndarray, total: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each kind a random draw of ``total`` without replacement holds, for any number of records.

    The kinds are halved and the draw is split between the halves. A split of
    more records than the generator's exact law takes is drawn with its mean
    and variance, which at that size nobody can tell from it.
    """
    out = np.zeros(len(sizes), np.int64)
    todo = [(0, len(sizes), int(min(total, sizes.sum())))]
    ends = np.concatenate(([0], np.cumsum(sizes)))
    while todo:
        first, stop, n = todo.pop()
        if n <= 0:
            continue
        if stop - first == 1:
            out[first] = n
            continue
        half = (first + stop) // 2
        left, right = int(ends[half] - ends[first]), int(ends[stop] - ends[half])
        if left + right < EXACT_DRAW:
            k = int(rng.hypergeometric(left, right, n))
        else:
            share = left / (left + right)
            spread = np.sqrt(n * share * (1 - share) * max(0.0, (left + right - n) / (left + right - 1)))
            k = int(np.clip(round(rng.normal(n * share, spread)), max(0, n - right), min(n, left)))
        todo += [(first, half, k), (half, stop, n - k)]
    return out


def _plan_request(key: tuple, pool: pd.DataFrame, targets: pd.DataFrame) -> pd.DataFrame:
    """Allocation rows (with a signature) and report rows (with a category) of one request."""
    request = str(key[0])
    out = []
    targets = targets.sort_values(["category_kind", "category"]).reset_index(drop=True)
    pool = pool.sort_values("signature").reset_index(drop=True)
    asked = int(pool["sample_size"].iloc[0] if len(pool) else targets["sample_size"].iloc[0])
    names = [set(x) for x in pool["categories"]] if len(pool) else []
    wanted = list(zip(targets["category_kind"], targets["name"], strict=True))
    member = np.array([[f"{kind}:{name}" in s for s in names] for kind, name in wanted], dtype=np.int64)
    member = member.reshape(len(wanted), len(names))
    sizes = pool["n"].to_numpy(np.int64) if len(pool) else np.zeros(0, np.int64)
    total = int(min(max(asked, 0), sizes.sum()))
    share = targets["target_share"].fillna(0.0).to_numpy(float)
    minimum = targets["min_count"].fillna(0).to_numpy(np.int64)
    goal = np.array([int(round(x)) for x in share * asked], dtype=np.int64)
    have = member @ sizes if len(names) else np.zeros(len(wanted), np.int64)
    take = swap_repair(sizes, member, goal.astype(float), np.minimum(minimum, have), total, _seed(request))
    got = member @ take if len(names) else np.zeros(len(wanted), np.int64)
    for i, row in targets.iterrows():
        need = int(max(goal[i], minimum[i]))
        out.append((request, row["category_kind"], row["category"], None, int(got[i]), int(have[i]), int(goal[i]),
                    int(minimum[i]), float(share[i]), float(got[i]) / total if total else 0.0,
                    bool(got[i] >= need), bool(have[i] >= need)))
    out += [(request, None, None, s, int(t), int(n), None, None, None, None, None, None)
            for s, t, n in zip(pool.get("signature", []), take, sizes, strict=True)]
    names = [c.split()[0] for c in _PLAN.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    return frame.astype({"take": "Int64", "available": "Int64", "wanted": "Int64", "floor": "Int64",
                         "met": "boolean", "reachable": "boolean"})


def _signed(units: DataFrame) -> DataFrame:
    """Units with every category they belong to, and the signature those categories form."""
    names = F.concat(
        F.array(F.concat(F.lit("language:"), "language")),
        F.transform("roles", lambda r: F.concat(F.lit("sample_role:"), r)),
    )
    return units.withColumn("categories", names)


def _by_kind(signed: DataFrame, requests: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests with the categories they name, and the pool of signatures over just those categories."""
    name = squash(F.col("category"))
    named = targets.filter(F.col("category").isNotNull() & F.col("request_id").isNotNull()).select(
        "request_id", "category_kind", "category", "target_share", "min_count", name.alias("name")
    )
    wanted = named.groupBy("request_id").agg(
        F.array_sort(F.collect_set(F.concat_ws(":", "category_kind", "name"))).alias("wanted")
    )
    asked = requests.select("request_id", "frame_id", F.col("sample_size").cast("long").alias("sample_size")).distinct()
    asked = asked.join(wanted, "request_id", "left").withColumn(
        "wanted", F.coalesce("wanted", F.array().cast("array<string>"))
    )
    per_frame = signed.groupBy("frame_id", "categories").agg(F.count(F.lit(1)).alias("n"))
    pool = (
        bounded_broadcast(asked).join(per_frame, "frame_id")
        .withColumn("categories", F.array_sort(F.array_intersect("categories", "wanted")))
        .groupBy("request_id", "sample_size", "categories")
        .agg(F.sum("n").alias("n"))
        .withColumn("signature", F.array_join("categories", "|"))
    )
    return asked, pool, named.join(asked.select("request_id", "sample_size"), "request_id")


def plan_samples(units: DataFrame, requests: DataFrame, targets: DataFrame) -> DataFrame:
    """Counts to draw per request and signature, and one report row per target.

    Report rows carry a category, allocation rows a signature. ``wanted`` is
    target_share x sample_size, rounded; ``reachable`` says whether the frame
    holds the greater of that and the minimum at all, ``met`` whether the
    sample does. A frame smaller than the request is taken whole; a request
    without targets is drawn at random; a request of an empty frame reports
    zeros. One task holds one request's signature counts, never its records.
    """
    _, pool, named = _by_kind(_signed(units), requests, targets)
    left = pool.select("request_id", "sample_size", "categories", "signature", "n").groupBy("request_id")
    right = named.select(
        *(F.col(c).alias(c) for c in ("request_id", "sample_size", "category_kind", "category", "name")),
        F.col("target_share").cast("double").alias("target_share"), F.col("min_count").cast("long").alias("min_count"),
    ).distinct().groupBy("request_id")
    return left.cogroup(right).applyInPandas(_plan_request, _PLAN)


def report(plan: DataFrame) -> DataFrame:
    """One row per target: what was wanted, available and drawn."""
    return plan.filter(F.col("category").isNotNull()).drop("signature").withColumnRenamed("take", "drawn")


def draw(units: DataFrame, requests: DataFrame, targets: DataFrame) -> DataFrame:
    """(request_id, article_id) of every sample, drawn by hash order within each signature."""
    ws = Workspace(units.sparkSession, "proportions")
    signed = ws.write(_signed(units).select("frame_id", "article_id", "language", "roles", "categories"), "units")
    asked, _, _ = _by_kind(signed, requests, targets)
    plan = ws.write(plan_samples(signed, requests, targets), "plan")
    quota = plan.filter(F.col("signature").isNotNull() & (F.col("take") > 0)).select("request_id", "signature", "take")
    picked = (
        signed.join(bounded_broadcast(asked), "frame_id")
        .withColumn("signature", F.array_join(F.array_sort(F.array_intersect("categories", "wanted")), "|"))
        .select("request_id", "article_id", "signature")
        .join(bounded_broadcast(quota), ["request_id", "signature"])
        .withColumn("_h", F.xxhash64("request_id", "article_id"))
    )
    rank = [F.col("_h"), F.col("article_id")]
    drawn = take_ranked(picked, ["request_id", "signature"], "take", rank, hash_bucket(F.col("_h")))
    return drawn.select("request_id", "article_id")
