"""Encoding a corpus with a public byte-level BPE vocabulary.

A text is split into words by the vocabulary's pattern; each distinct word is
merged once per Python worker and remembered. The merge holds a contiguous
array of part boundaries with the rank of each adjacent pair, scans it for the
least rank, deletes that boundary and refreshes the two neighbouring ranks.
Texts reach Python, and ids leave it, as Arrow batches.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words longer than this are merged through a heap, whose cost does not grow with the square of the length.
SCAN_BYTES = 256
#: Distinct words remembered per worker; the memory is emptied when full.
MEMO_WORDS = 400_000
_NO_RANK = 1 << 62
# The Unicode white space property, as a character class.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Path of a public vocabulary file; ``folder`` overrides the installed place."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, which is also the token's id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _class_of(categories: tuple[str, ...]) -> str:
    """Ranges, for a character class, of all code points in some Unicode categories."""
    out, start, last = [], None, None
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(chr(point)) in categories:
            if start is None:
                start = point
            last = point
        elif start is not None:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = None
    return "".join(out)


@lru_cache(maxsize=1)
def word_pattern() -> re.Pattern[str]:
    """The vocabulary's splitting pattern for the standard ``re`` module.

    ``re`` has no Unicode categories: a word character is a letter, a number or
    the underscore, so letters are word characters without decimal digits, the
    other numbers and the underscore. White space is the Unicode property,
    which lacks the four information separators that ``\\s`` adds.
    """
    other = _class_of(("Nl", "No"))
    letter = rf"[^\W\d_{other}]"
    number = rf"[\d{other}]"
    rest, solid = rf"[^\w{_SPACE}]", rf"[^{_SPACE}]"
    return re.compile(
        rf"'(?:[sdmt]|ll|ve|re)| ?{letter}+| ?{number}+| ?(?:{rest}|_)+|[{_SPACE}]+(?!{solid})|[{_SPACE}]+"
    )


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: the adjacent pair of least rank is joined, leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > SCAN_BYTES:
        return _merge_long(word, ranks)
    get = ranks.get
    bounds = list(range(len(word) + 1))
    pair = [get(word[i : i + 2], _NO_RANK) for i in range(len(word) - 1)]
    while pair:
        least = min(pair)
        if least == _NO_RANK:
            break
        at = pair.index(least)
        del bounds[at + 1]
        del pair[at]
        if at < len(pair):
            pair[at] = get(word[bounds[at] : bounds[at + 2]], _NO_RANK)
        if at:
            pair[at - 1] = get(word[bounds[at - 1] : bounds[at + 1]], _NO_RANK)
    return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges in the same order through linked parts and a heap of (rank, place)."""
    size = len(word)
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    get = ranks.get
    heap = [(r, i, i + 2) for i in range(size - 1) if (r := get(word[i : i + 2])) is not None]
    heapify(heap)
    alive = [True] * size
    while heap:
        _, at, end = heappop(heap)
        if not alive[at] or after[at] >= size or after[after[at]] != end:
            continue
        gone = after[at]
        alive[gone] = False
        after[at] = end
        if end < size:
            before[end] = at
            if (r := get(word[at : after[end]])) is not None:
                heappush(heap, (r, at, after[end]))
        if before[at] >= 0 and (r := get(word[before[at] : end])) is not None:
            heappush(heap, (r, before[at], end))
    out, at = [], 0
    while at < size:
        out.append(ranks[word[at : after[at]]])
        at = after[at]
    return out


class _Memo(dict):
    """Word to its ids, or to their number, merging what is not yet known."""

    def __init__(self, ranks: dict[bytes, int], shape: Callable[[list[int]], object]) -> None:
        super().__init__()
        self._ranks, self._shape = ranks, shape

    def __missing__(self, word: str) -> object:
        value = self._shape(merge_word(word.encode("utf-8"), self._ranks))
        if len(self) >= MEMO_WORDS:
            self.clear()
        if len(word) <= SCAN_BYTES:
            self[word] = value
        return value


def encode_text(text: str, path: str | None = None) -> list[int]:
    """Ids of one text; for tests and single texts."""
    ranks = load_ranks(path or vocabulary_path())
    return [i for w in word_pattern().findall(text) for i in merge_word(w.encode("utf-8"), ranks)]


def encode_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None
) -> DataFrame:
    """(``id_col``, ids array<int>): an empty list for an empty text, null for a null text.

    Strings that look like special tokens are ordinary text. Other columns are
    left out; repeated rows give repeated results.
    """
    path = vocabulary or vocabulary_path()
    schema = T.StructType([documents.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memo = word_pattern().findall, _Memo(load_ranks(path), tuple)
        for batch in batches:
            parts, sizes, null = [], [], []
            for text in batch.column(1).to_pylist():
                ids = list(chain.from_iterable(map(memo.__getitem__, find(text)))) if text else []
                parts.append(np.array(ids, dtype=np.int32))
                sizes.append(len(ids))
                null.append(text is None)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            values = pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(null, pa.bool_()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(encode, schema)


def count_tokens(
    documents: DataFrame, keep: list[str], text_col: str = "text", vocabulary: str | None = None, name: str = "tokens"
) -> DataFrame:
    """The ``keep`` columns and the number of tokens of each text; null and empty texts have none."""
    path = vocabulary or vocabulary_path()
    schema = T.StructType([*(documents.schema[c] for c in keep), T.StructField(name, T.LongType(), False)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, memo = word_pattern().findall, _Memo(load_ranks(path), len)
        for batch in batches:
            sizes = [sum(map(memo.__getitem__, find(t))) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64())], names=[*keep, name])

    return documents.select(*keep, text_col).mapInArrow(count, schema)
