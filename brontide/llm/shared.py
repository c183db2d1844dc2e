"""Helpers shared by the corpus operators: intermediate tables and vectorised word hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, remove_table, shared_path

__all__ = ["as_bytes", "chunks_by_bytes", "fresh", "let", "materialize", "mix64", "prefix_sums", "remove_table", "shared_path", "word_hashes", "word_spans"]

#: ASCII white space as the word contracts use it: space, tab, LF, VT, FF, CR.
NOT_SPACE = r"[^\x20\x09-\x0D]+"
#: Bytes of text hashed at once; bounds the temporary arrays to about 25 MB.
PIECE_BYTES = 1 << 19


def fresh(columns: Iterable[str], *wanted: str) -> list[str]:
    """Names near ``wanted`` that do not clash (in any letter case) with ``columns``."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` refers to it, inside loops too."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


#: Numbers of a run in prefix_sums.
PREFIX_RUN = 1024


def prefix_sums(df: DataFrame, key: str, order: str, value: str, out: str) -> DataFrame:
    """``df`` with ``out``, the sum of ``value`` over the rows of its key with a smaller ``order`` (whole numbers from 0, each once a key).

    Sums go by runs of numbers first and then inside each run, so that a task
    sorts a run or one row for each run, not all rows of a key.
    """
    run = F.expr(f"{order} div {PREFIX_RUN}")
    runs = df.withColumn("_run", run)
    upto = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    before = runs.groupBy(key, "_run").agg(F.sum(value).alias("_s")).select(key, "_run", F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return runs.join(before, [key, "_run"]).withColumn(out, F.col("_before") + F.col("_in")).drop("_run", "_before", "_in")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads the bits of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        made = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[:] = made
    return _powers


def _hash_piece(buffer: bytes, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of ``buffer``, where each starts and where it ends."""
    a = np.frombuffer(buffer, np.uint8)
    if not len(a):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~parts[a]
    edge = np.flatnonzero(np.diff(word.view(np.int8), prepend=0, append=0))
    start, end = edge[0::2], edge[1::2]
    power, inverse = _power_tables(len(a) + 1)
    total = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[a] * power[: len(a)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix64(h + (end - start).astype(np.uint64)), start, end


def _cut(text: bytes) -> Iterator[bytes]:
    """Pieces of at most PIECE_BYTES, cut at white space (a longer word stays whole)."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        to = at + PIECE_BYTES
        while to < len(text) and not _IS_SPACE[text[to]]:
            to += 1
        yield text[at:to]
        at = to
    yield text[at:] if at else text


def word_spans(texts: list[bytes], parts: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, offsets, starts, ends): 64-bit hashes of all words, where each text's words begin (n + 1 offsets), and the words' bytes in their text.

    Words are runs of bytes that ``parts``, a table of 256, does not mark; it must mark the space.
    """
    hashes: list[np.ndarray] = [np.zeros(0, np.uint64)]
    starts: list[np.ndarray] = [np.zeros(0, np.int64)]
    ends: list[np.ndarray] = [np.zeros(0, np.int64)]
    counts = np.zeros(len(texts), np.int64)
    for part in chunks_by_bytes([len(t) for t in texts]):
        batch = texts[part]
        base, pieces = 0, _cut(batch[0]) if len(batch) == 1 else [b" ".join(batch)]
        for piece in pieces:
            h, start, end = _hash_piece(piece, parts)
            if len(batch) == 1:
                counts[part.start] += len(h)
                move: np.ndarray | int = base
            else:
                begin = np.cumsum([0] + [len(t) + 1 for t in batch])
                at = np.searchsorted(start, begin)
                counts[part] += np.diff(at)
                move = -np.repeat(begin[:-1], np.diff(at))
            hashes.append(h)
            starts.append(start + move)
            ends.append(end + move)
            base += len(piece)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    return np.concatenate(hashes), offsets, np.concatenate(starts), np.concatenate(ends)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and offsets of ``word_spans`` for words parted by ASCII white space."""
    return word_spans(texts)[:2]


def as_bytes(texts: Iterable[str | None], ascii_lower: bool = False) -> list[bytes]:
    """UTF-8 of each text, null as empty; ``ascii_lower`` lower-cases A-Z alone."""
    out = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    return [t.lower() for t in out] if ascii_lower else out


def chunks_by_bytes(lengths: list[int], limit: int = PIECE_BYTES) -> Iterator[slice]:
    """Slices of consecutive items of at most ``limit`` bytes each (or one item)."""
    at, held = 0, 0
    for i, n in enumerate(lengths):
        if i > at and held + n > limit:
            yield slice(at, i)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield slice(at, len(lengths))
