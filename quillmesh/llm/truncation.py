"""Text cut off by field limits, by a backward character n-gram model.

The model counts, for contexts of several lengths read backward from a
position and never past the start of its line, how often the text breaks there
(line or text end) and how often it goes on. Counts come from every position of
every value; only contexts that end some value are kept, found through one
bitmap per length that is sized by their number. Where even the largest fills
up, more counts are moved, none is lost. The likelihood of ending over that of going on,
backed off from the longest known context, gives each value's log-odds, and
values below the threshold of their language are truncated.

Characters are read as a stream in which names are one symbol and numbers are
one digit, so that contexts generalise. A value's own end is left out of the
counts it is judged by.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.skew import join_counted
from quillmesh.functions.text import language_code, site
from quillmesh.lineage import Workspace

#: Context lengths in symbols, shortest first.
ORDERS = (3, 5, 8, 12, 20)
#: Weight of the shorter context's estimate, in observations.
BACKOFF = 3.0
#: Where a threshold is looked for, the middle of equally empty stretches, and the weight, in values, of all languages' histogram.
SEARCH, DEFAULT, POOLED_VALUES = (-6.0, -1.75), -3.75, 500.0
#: Log-odds taken from a value that carries a sign of the cut.
MARK_COST = 12.0
#: Symbols handled at once per Python worker; longer texts are read in pieces.
PIECE = 1 << 20
#: Most slots of a bitmap of wanted contexts, as a power of two, and the slots of one part of it.
MOST_BITS, PART_BITS = 28, 20
#: Distinct contexts a worker counts before it passes the counts on.
HELD_CONTEXTS = 1 << 21
#: Characters at the end of a value that surely hold its final context.
TAIL = 700
# Signs that a cut leaves behind, at the very end of a value.
MARKS = re.compile(
    r"(?:\s*(?:\[(?:\.\.\.|…)\]|\.\.\.|…|\((?:more|mehr|más|suite)\)|�|&(?:#\d*|[a-z]{0,6})"
    r"|<(?:/?[a-zA-Z][^<>]*)?|\[\+\d+ chars\]))+$"
)
# Characters after which a number stands free.
_BEFORE_NUMBER = "(（£$€:年于"
_SENTINEL, _FEED, _SPACE, _ZERO, _NAME = 1, 10, 32, ord("0"), ord("X")
_UPPER, _WORD, _WHITE, _DIGIT, _OPENS = 1, 2, 4, 8, 16


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bit set of classes of every code point."""
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    kinds = {"Lu": _UPPER | _WORD, "Lt": _UPPER | _WORD, "Ll": _WORD, "Mn": _WORD, "Mc": _WORD, "Nd": _DIGIT}
    for point in range(sys.maxunicode + 1):
        char = chr(point)
        table[point] = kinds.get(unicodedata.category(char), 0) | (_WHITE if char.isspace() or char in "\u200b\ufeff" else 0)
    for char in "’'-":
        table[ord(char)] |= _WORD
    for char in _BEFORE_NUMBER:
        table[ord(char)] |= _OPENS
    return table


def _symbols(codes: np.ndarray) -> np.ndarray:
    """The symbol stream of code points: white space around a line feed is one line feed, a name is ``X``
    except at a line's start, a free number is one ``0`` and every other digit is ``0``."""
    codes = codes.copy()
    kind = _classes()[codes]
    keep = np.ones(len(codes), bool)
    white = (kind & _WHITE) != 0
    begins = white & ~np.concatenate(([False], white[:-1]))
    at = np.flatnonzero(begins)
    if len(at):
        run = np.cumsum(begins) - 1
        feeds = np.bincount(run[codes == _FEED], minlength=len(at)) > 0
        in_feed = white & feeds[np.maximum(run, 0)]
        keep &= ~in_feed | begins
        codes[white] = _SPACE
        codes[in_feed] = _FEED
    before = np.concatenate(([_FEED], codes[:-1]))
    word = (kind & _WORD) != 0
    begins = word & ~np.concatenate(([False], word[:-1]))
    if begins.any():
        folded = ((kind & _UPPER) != 0)[begins] & (before[begins] != _FEED)
        in_name = word & folded[np.maximum(np.cumsum(begins) - 1, 0)]
        keep &= ~in_name | begins
        codes[in_name] = _NAME
    digit = (kind & _DIGIT) != 0
    if digit.any():
        point = (codes == ord(".")) | (codes == ord(","))
        inner = point & np.concatenate(([False], digit[:-1])) & np.concatenate((digit[1:], [False]))
        number = digit | inner
        begins = number & ~np.concatenate(([False], number[:-1]))
        opens = np.concatenate(([True], ((kind & (_OPENS | _WHITE)) != 0)[:-1]))
        free = number & opens[begins][np.maximum(np.cumsum(begins) - 1, 0)]
        keep &= ~free | begins
        codes[digit] = _ZERO
    return codes[keep]


_P = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2**64


class _Hasher:
    """Hashes of the contexts that end at given places of a code point array."""

    def __init__(self) -> None:
        self._up = self._down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._up) < n:
            size = max(n, PIECE + 64)
            inverse = pow(_P, -1, 1 << 64)
            for name, base in (("_up", _P), ("_down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def __call__(self, codes: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
        """One array of hashes per order, for the places ``at``."""
        self._powers(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * self._up[: len(codes)], out=sums[1:])
        line = np.maximum.accumulate(np.where(codes == _FEED, np.arange(len(codes)), 0))[at]
        upto = sums[at + 1]
        for order in ORDERS:
            first = np.maximum(at - (order - 1), line)
            h = (upto - sums[first]) * self._down[first]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            yield h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _finals(codes: np.ndarray, events: np.ndarray) -> np.ndarray:
    """Index, among the events, of the last one before each sentinel but the first."""
    stops = np.append(np.flatnonzero(codes == _SENTINEL)[1:], len(codes))
    return np.searchsorted(events, stops) - 1


def _events(codes: np.ndarray) -> np.ndarray:
    return np.flatnonzero((codes != _FEED) & (codes != _SPACE) & (codes != _SENTINEL))


def final_core(tail: str, whole: bool) -> tuple[str, bool]:
    """The end of a value without outer white space and signs of a cut, and whether it had such a sign."""
    text = tail.strip().strip("\u200b\ufeff").strip()
    sign = MARKS.search(text, max(0, len(text) - 200))
    if sign:
        text = text[: sign.start()].rstrip()
    return ("\n" if whole else "") + text, sign is not None


def _hash_tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last two columns, a value's end and whether it is all of it, by ``marked`` and ``contexts``."""
    hasher = _Hasher()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = [final_core(t, w) for t, w in zip(*(c.to_pylist() for c in batch.columns[-2:]), strict=True)]
        # A stand-in symbol makes sure that every value has a final place.
        codes = _symbols(_codes("".join(f"\x01{text or chr(0)}" for text, _ in ends)))
        events = _events(codes)
        hashes = np.stack(list(hasher(codes, events[_finals(codes, events)])), axis=1).view(np.int64)
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(0, hashes.size + 1, len(ORDERS), dtype=np.int32)), pa.array(hashes.ravel())
        )
        marked = pa.array([m for _, m in ends])
        names = [*batch.schema.names[:-2], "marked", "contexts"]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], marked, lists], names=names)


def _pieces(texts: Iterator[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols, places of events) of about PIECE characters; a text's last place is no event."""
    joined: list[str] = []
    size = 0
    for text in texts:
        if len(text) > PIECE:
            yield from _long(text)
            continue
        joined.append(text)
        size += len(text)
        if size >= PIECE:
            yield _joined(joined)
            joined, size = [], 0
    if joined:
        yield _joined(joined)


def _long(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of one text, each cut after white space and led in by the end of the piece before."""
    text = "\n" + text.rstrip()
    at = 0
    while at < len(text):
        gap = re.compile(r"\s+").search(text, at + PIECE, at + 2 * PIECE)
        stop = gap.end() if gap else min(len(text), at + 2 * PIECE)
        lead = _symbols(_codes(text[max(0, at - TAIL) : at])) if at else np.zeros(0, np.uint32)
        codes = _symbols(_codes(text[max(0, at - TAIL) : stop]))
        events = _events(codes)
        events = events[(events >= len(lead)) & (events < len(codes) - 1)]
        yield codes, events
        at = stop


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    codes = _symbols(_codes("".join(f"\x01\n{t}" for t in texts)))
    events = _events(codes)
    last = _finals(codes, events)
    return codes, np.delete(events, last[last >= 0]) if len(events) else events


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return every, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def _counter(packed: list[bytes], bits: int):
    """Function over Arrow batches of texts that counts breaks and continuations of the marked contexts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = [np.frombuffer(p, np.uint8) for p in packed]
        hasher, shift = _Hasher(), np.uint64(64 - bits)
        keys = [[] for _ in ORDERS]
        counts = [[] for _ in ORDERS]
        total = [0, 0]

        def rows(k: int) -> pa.RecordBatch:
            key, n = _merged(keys[k], counts[k])
            keys[k], counts[k] = [], []
            return _count_rows(np.full(len(key), k), key.view(np.int64), n)

        texts = (t for batch in batches for t in batch.column(0).to_pylist() if t)
        for codes, at in _pieces(texts):
            if not len(at):
                continue
            breaks = codes[at + 1] == _FEED
            total[0] += int(breaks.sum())
            total[1] += len(at)
            for k, h in enumerate(hasher(codes, at)):
                slot = h >> shift
                hit = (wanted[k][(slot >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1 == 1
                # The lowest bit of a key says whether the text broke there.
                key = np.sort((h[hit] & ~np.uint64(1)) | breaks[hit].astype(np.uint64))
                if len(key):
                    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                    keys[k].append(key[first])
                    counts[k].append(np.diff(np.concatenate((first, [len(key)]))))
                if len(keys[k]) >= 24:
                    merged = _merged(keys[k], counts[k])
                    keys[k], counts[k] = [merged[0]], [merged[1]]
                    if len(merged[0]) >= HELD_CONTEXTS:
                        yield rows(k)
        yield _count_rows(np.array([-1, -1]), np.array([0, 1]), np.array(total))
        for k in range(len(ORDERS)):
            if keys[k]:
                yield rows(k)

    return count


def _count_rows(order: np.ndarray, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (order, key, n)], names=["order", "key", "n"])


def _bitmaps(tuples: DataFrame, bits: int) -> list[bytes]:
    """One bitmap per order of the contexts that end a value: 2**bits bits.

    Every part of a bitmap is filled by one task from its distinct slots; the
    driver puts the parts together.
    """
    part = min(bits, PART_BITS)
    places = tuples.select(F.posexplode("contexts").alias("k", "h")).select("k", F.shiftrightunsigned("h", 64 - bits).alias("slot"))
    parts = places.distinct().groupBy("k", F.shiftright("slot", part).alias("part"))

    def mark(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(1 << part, bool)
        flags[rows["slot"].to_numpy() & ((1 << part) - 1)] = True
        return pd.DataFrame({"k": [key[0]], "part": [key[1]], "bits": [np.packbits(flags).tobytes()]})

    out, size = np.zeros((len(ORDERS), (1 << bits) // 8), np.uint8), (1 << part) // 8
    for row in parts.applyInPandas(mark, "k int, part long, bits binary").toLocalIterator():
        out[row["k"], row["part"] * size : (row["part"] + 1) * size] = np.frombuffer(row["bits"], np.uint8)
    return [m.tobytes() for m in out]


def _cells(scores: list[tuple[float, int]]) -> np.ndarray:
    """Values per quarter unit of the searched range of log-odds, and at the end all of them."""
    cells = np.zeros(int((SEARCH[1] - SEARCH[0]) * 4) + 1)
    for score, n in scores:
        cells[-1] += n
        if SEARCH[0] <= score < SEARCH[1]:
            cells[int((score - SEARCH[0]) * 4)] += n
    return cells


def _threshold(own: np.ndarray, pooled: np.ndarray) -> float:
    """Middle of the emptiest stretch of the searched range, by a language's histogram and all languages'.

    All languages together weigh as much as POOLED_VALUES values, whatever
    their number, so that a language's own values prevail smoothly as they grow.
    """
    cells = own[:-1] + pooled[:-1] * (POOLED_VALUES / max(1.0, pooled[-1]))
    weight = np.convolve(cells, [0.5, 1.0, 0.5], mode="same")
    centre = SEARCH[0] + 0.25 * (np.arange(len(cells)) + 0.5)
    # Of equally empty cells the one nearest the default stands.
    return float(centre[np.lexsort((np.abs(centre - DEFAULT), weight))[0]])


class TruncationModel:
    """Log-odds of a text column's values, fitted on all of them.

    Null and blank values are never truncated and are left out. Republished
    and re-delivered values count once as ends.
    """

    def __init__(self, rows: DataFrame, text: str = "body") -> None:
        self.ws = Workspace(rows.sparkSession, "truncation")
        value = F.col(text)
        kept = rows.filter(value.isNotNull() & value.rlike(r"\S"))
        tails = kept.select(
            "article_id", site(F.coalesce(F.col("domain"), F.lit(""))).alias("site"), F.xxhash64(value).alias("doc"),
            F.hash(value).alias("doc2"), language_code(F.col("language")).alias("lang"),
            F.right(value, F.lit(TAIL)).alias("tail"), (F.length(value) <= TAIL).alias("whole"),
        )
        schema = "article_id string, site string, doc long, doc2 int, lang string, marked boolean, contexts array<long>"
        hashed = tails.mapInArrow(_hash_tails, schema)
        self.values = self.ws.write(hashed.withColumn("key", F.xxhash64("lang", "marked", "contexts")), "values")
        ends = self.values.dropDuplicates(["doc", "doc2"]).groupBy("key").agg(F.count(F.lit(1)).alias("ends"))
        tuples = self.values.groupBy("key").agg(
            F.first("lang").alias("lang"), F.first("marked").alias("marked"), F.first("contexts").alias("contexts"),
            F.count(F.lit(1)).alias("rows"),
        )
        self.tuples = self.ws.write(
            tuples.join(ends, "key", "left").withColumn("ends", F.coalesce("ends", F.lit(0))), "tuples"
        )
        self.scored = self.ws.write(self._score(kept.select(value)), "scored")
        self.thresholds = self._thresholds()

    def _score(self, texts: DataFrame) -> DataFrame:
        n = self.tuples.count()
        bits = int(min(MOST_BITS, max(16, np.ceil(np.log2(16 * max(1, n))))))
        counter = _counter(_bitmaps(self.tuples, bits), bits) if n else _counter([b"\0" * (1 << bits >> 3)] * len(ORDERS), bits)
        counted = texts.mapInArrow(counter, "order long, key long, n long")
        isbreak = F.col("key").bitwiseAND(F.lit(1)) == 1
        counts = self.ws.write(
            counted.groupBy("order", F.col("key").bitwiseAND(F.lit(-2)).alias("context")).agg(
                F.sum(F.when(isbreak, F.col("n")).otherwise(0)).alias("breaks"),
                F.sum(F.when(~isbreak, F.col("n")).otherwise(0)).alias("runs"),
            ),
            "counts",
        )
        total = counts.filter("order = -1").first()
        # The totals row holds (breaks, events): its even key 0 and odd key 1 land in runs and breaks.
        breaks, places_all = (total["runs"], total["breaks"]) if total else (0, 0)
        base = (breaks + 1.0) / (places_all + 2.0)
        places = self.tuples.select(
            "key", "ends", "marked", F.posexplode("contexts").alias("order", "h")
        ).select("key", "ends", "marked", F.col("order").cast("long"), F.col("h").bitwiseAND(F.lit(-2)).alias("context"))
        known = (
            places.groupBy("order", "context")
            .agg(F.sum(F.when(~F.col("marked"), F.col("ends")).otherwise(0)).alias("own"), F.count(F.lit(1)).alias("tuples"))
            .join(counts, ["order", "context"], "left")
        )
        seen = join_counted(places, known, ["order", "context"], "tuples", max(1, n * len(ORDERS)))
        # The value's own end is one of those counted, unless it carries a mark.
        ended = F.coalesce("breaks", F.lit(0)) + F.greatest(
            F.lit(0), F.col("own") - F.when(F.col("marked"), 0).otherwise(1)
        )
        steps = seen.groupBy("key").agg(
            F.array_sort(
                F.collect_list(
                    F.struct("order", ended.cast("double").alias("b"), F.coalesce("runs", F.lit(0)).cast("double").alias("c"))
                )
            ).alias("steps")
        )
        p = F.aggregate(
            "steps", F.lit(float(base)), lambda acc, x: (x["b"] + BACKOFF * acc) / (x["b"] + x["c"] + BACKOFF)
        )
        bounded = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-9), p))
        odds = F.log(F.col("p") / (1 - F.col("p"))) - F.when(F.col("marked"), MARK_COST).otherwise(0.0)
        joined = steps.select("key", bounded.alias("p")).join(self.tuples.drop("contexts"), "key")
        return joined.select("key", "lang", "marked", "rows", "ends", odds.alias("log_odds"))

    def _thresholds(self) -> dict[str, float]:
        cell = (F.floor(F.col("log_odds") * 8) / 8).alias("cell")
        rows = self.scored.filter(~F.col("marked")).groupBy("lang", cell).agg(F.sum("ends").alias("n")).collect()
        by: dict[str, list[tuple[float, int]]] = {}
        for r in rows:
            by.setdefault(r["lang"], []).append((r["cell"], r["n"]))
        cells = {lang: _cells(scores) for lang, scores in by.items()}
        pooled = sum(cells.values(), np.zeros(int((SEARCH[1] - SEARCH[0]) * 4) + 1))
        return {lang: _threshold(own, pooled) for lang, own in cells.items()}

    def judged(self) -> DataFrame:
        """(article_id, site, lang, log_odds, threshold, truncated) of every value."""
        cut = F.lit(DEFAULT)
        for lang, limit in sorted(self.thresholds.items()):
            cut = F.when(F.col("lang") == lang, F.lit(limit)).otherwise(cut)
        scored = self.scored.select("key", "log_odds", "rows")
        total = self.values.count()
        out = join_counted(self.values.select("article_id", "site", "lang", "key"), scored, ["key"], "rows", max(1, total))
        out = out.withColumn("threshold", cut)
        return out.select(
            "article_id", "site", "lang", "log_odds", "threshold", (F.col("log_odds") < F.col("threshold")).alias("truncated")
        )


def truncated_articles(articles: DataFrame) -> DataFrame:
    """(article_id) of the articles of which a delivered body breaks off."""
    judged = TruncationModel(articles.filter(F.col("article_id").isNotNull())).judged()
    return judged.filter("truncated").select("article_id").distinct()


def site_rates(articles: DataFrame) -> DataFrame:
    """(domain, articles, truncated, share): how many different articles each site truncates."""
    judged = TruncationModel(articles.filter(F.col("article_id").isNotNull())).judged()
    each = judged.groupBy("site", "article_id").agg(F.max(F.col("truncated").cast("long")).alias("t"))
    return each.groupBy(F.col("site").alias("domain")).agg(
        F.count(F.lit(1)).alias("articles"), F.sum("t").alias("truncated"), F.avg("t").alias("share")
    )
