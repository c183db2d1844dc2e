"""Removal of repeated word sequences by recompression.

A text is a row of symbols, at first its words. Rounds rename it: maximal runs of one
symbol become one symbol, then symbols are dealt to a left and a right side and every
neighbouring pair (left, right) becomes one symbol. A name is a hash of what it stands
for, so the same run or pair has the same name everywhere in the corpus. How a round
deals symbols to sides is settled by counting, in a Spark job over all texts, how many
pairs each of SIDES ways would join. After some rounds a symbol stands for three words
or so, and equal sequences have equal symbols inside: only at their ends can names
depend on what lies around. Each symbol carries the stretch of words that its name
depends on. So a symbol that occurs once in the corpus proves every window of words
that holds its stretch to occur once; windows that no such symbol rules out are
candidates, and those alone are compared, by hashes of their words.

Counting and comparing go by shards of hashes. A task first settles what it can among
its own texts and sends each symbol and each window once; what it learns comes back
in a file for each home, the texts that one task wrote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import mapped, write_file
from .shared import as_bytes, chunks_by_bytes, materialize, mix64, shared_path, word_hashes

WINDOW = 20
#: r: runs become symbols; p: pairs become symbols.
ROUNDS = "rpprpp"
#: Ways to deal symbols to sides that a pair round chooses from.
SIDES = 6
#: Characters of text that a task renames at once, those of a home, and those for each shard.
SLICE_CHARS, HOME_CHARS, SHARD_CHARS = 3_000_000, 64_000_000, 8_000_000
_FAR = 1 << 40
_A, _B, _C = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_PLACES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Stands for a null doc_id inside, so that ids stay whole numbers in tasks.
_NULL_ID = (1 << 63) - 1


@dataclass
class Symbols:
    """Symbols of some texts end to end; ``since`` and ``until`` bound the words that a name depends on (beyond the text: -_FAR, _FAR)."""

    name: np.ndarray
    since: np.ndarray
    until: np.ndarray
    text: np.ndarray

    def beside(self) -> np.ndarray:
        """Whether a symbol and the next one stand in one text."""
        out = np.zeros(len(self.name), bool)
        out[:-1] = self.text[1:] == self.text[:-1]
        return out


def words_as_symbols(h: np.ndarray, at: np.ndarray) -> Symbols:
    i = np.arange(len(h))
    return Symbols(h, i, i + 1, np.repeat(np.arange(len(at) - 1), np.diff(at)))


def name_runs(s: Symbols) -> Symbols:
    """Maximal runs of a symbol as one. Each name depends on the neighbours too, as they end the run."""
    if not len(s.name):
        return s
    near = s.beside()
    new = np.ones(len(s.name), bool)
    new[1:] = ~((s.name[1:] == s.name[:-1]) & near[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(new)) - 1
    name, many = s.name[first], last > first
    name[many] = mix64(name[many] * _A + (last - first + 1)[many].astype(np.uint64) * _B + _C)
    since = np.where((first > 0) & near[first - 1], s.since[first - 1], -_FAR)
    until = np.where(near[last], s.until[np.minimum(last + 1, len(new) - 1)], _FAR)
    return Symbols(name, since, until, s.text[first])


def right_side(name: np.ndarray, way: int) -> np.ndarray:
    return (mix64(name ^ np.uint64(way)) & np.uint64(1)).astype(bool)


def pairs_joined(s: Symbols, way: int) -> int:
    """How many neighbours a way to deal symbols would join."""
    right = right_side(s.name, way)
    return int((~right[:-1] & right[1:] & s.beside()[:-1]).sum()) if len(right) else 0


def name_pairs(s: Symbols, way: int) -> Symbols:
    """Every left symbol and the right one after it as one. A name depends on the words of its symbols, and on a neighbour that might have joined."""
    if not len(s.name):
        return s
    right, near = right_side(s.name, way), s.beside()
    joined = np.zeros(len(right), bool)
    joined[:-1] = ~right[:-1] & right[1:] & near[:-1]
    name, since, until = s.name.copy(), s.since.copy(), s.until.copy()
    i = np.flatnonzero(right)
    since[i] = np.where((i > 0) & near[i - 1], s.since[i - 1], -_FAR)
    i = np.flatnonzero(~right)
    until[i] = np.where(near[i], s.until[np.minimum(i + 1, len(right) - 1)], _FAR)
    i = np.flatnonzero(joined)
    name[i] = mix64(s.name[i] * _A + s.name[i + 1] * _B + np.uint64(way))
    keep = np.ones(len(right), bool)
    keep[1:] = ~joined[:-1]
    return Symbols(name[keep], since[keep], until[keep], s.text[keep])


def renamed(h: np.ndarray, at: np.ndarray, ways: list[int]) -> Symbols:
    """Symbols after the rounds that ``ways`` settles, and the runs before the next pairs."""
    s, left = words_as_symbols(h, at), list(ways)
    for kind in ROUNDS:
        if kind == "r":
            s = name_runs(s)
        elif left:
            s = name_pairs(s, left.pop(0))
        else:
            break
    return s


def provable(s: Symbols, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first, last): symbols whose stretch fits into a window of their text, and where the windows that hold it start."""
    first, last = np.maximum(s.until - window, at[s.text]), np.minimum(s.since, at[s.text + 1] - window)
    fits = first <= last
    return s.name[fits], first[fits], last[fits]


def _slot(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _slices(batches: Iterator[pd.DataFrame], chars: int) -> Iterator[pd.DataFrame]:
    """Rows of one home, so many characters at a time (or one text)."""
    for b in batches:
        for _, of_home in b.groupby("home", sort=False):
            for part in chunks_by_bytes([len(t) for t in of_home["text"]], chars):
                yield of_home.iloc[part].reset_index(drop=True)


def _homes(slice_chars: int, home_chars: int):
    """Texts with their home and their row in it, and the counts of the first pair round as a row of their own."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base, chars, row, home = TaskContext.get().partitionId() << 24, 0, 0, -1  # type: ignore[union-attr]
        counts = np.zeros(SIDES, np.int64)
        for b in batches:
            b["text"] = b["text"].fillna("")
            n = b["text"].map(len).to_numpy()
            homes, rows = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
            for i in range(len(b)):
                if home != base + chars // home_chars:
                    home, row = base + chars // home_chars, 0
                homes[i], rows[i] = home, row
                row, chars = row + 1, chars + int(n[i])
            b["home"], b["row"], b["counts"] = homes, rows, None
            for part in _slices(iter([b]), slice_chars):
                h, at = word_hashes(as_bytes(part["text"]))
                s = renamed(h, at, [])
                counts += [pairs_joined(s, _way(0, i)) for i in range(SIDES)]
            yield b[["home", "row", "doc_id", "key", "text", "counts"]]
        yield pd.DataFrame({"home": [base], "row": [-1], "doc_id": [None], "key": [None], "text": [None], "counts": [counts]})

    return run


def _way(number: int, i: int) -> int:
    return (number + 1) * 1000 + i


def _count_ways(ways: list[int], chars: int):
    """The counts of the next pair round, one row for a task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SIDES, np.int64)
        for part in _slices(batches, chars):
            h, at = word_hashes(as_bytes(part["text"]))
            s = renamed(h, at, ways)
            counts += [pairs_joined(s, _way(len(ways), i)) for i in range(SIDES)]
        yield pd.DataFrame({"counts": [counts]})

    return run


def _chosen(counts: DataFrame, number: int) -> int:
    """The way that joins most pairs of the whole corpus, the first of equals."""
    row = counts.agg(*[F.coalesce(F.sum(F.get("counts", F.lit(i))), F.lit(0)) for i in range(SIDES)]).first()
    return _way(number, max(range(SIDES), key=lambda i: (row[i], -i)))


def _dealt(shard: np.ndarray, home: int, shards: int, **columns: np.ndarray) -> pd.DataFrame:
    """A row for each shard that has entries, its columns packed as bytes."""
    order = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[order], np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edge))
    out: dict = {"shard": full, "home": np.full(len(full), home)}
    for name, x in columns.items():
        x = x[order]
        out[name] = [x[edge[s] : edge[s + 1]].tobytes() for s in full]
    return pd.DataFrame(out)


def _send_symbols(ways: list[int], window: int, shards: int, chars: int):
    """Distinct symbols of each slice, those that occur once in it and those that occur more often."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches, chars):
            h, at = word_hashes(as_bytes(part["text"]))
            name, n = np.unique(provable(renamed(h, at, ways), at, window)[0], return_counts=True)
            yield _dealt(_slot(name, shards), int(part["home"].iloc[0]), shards, name=name, more=n > 1)

    return run


def _packed(frame: pd.DataFrame, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(frame[name]), kind)


def _shared_symbols(frame: pd.DataFrame) -> pd.DataFrame:
    """For each home, its symbols of a shard that occur elsewhere too and only once in one of its slices."""
    name, more = _packed(frame, "name", np.uint64), _packed(frame, "more", bool)
    home = np.repeat(frame["home"].to_numpy(), [len(x) // 8 for x in frame["name"]])
    _, of, n = np.unique(name, return_inverse=True, return_counts=True)
    told = (n[of] > 1) & ~more
    pairs = pd.DataFrame({"home": home[told], "name": name[told]}).drop_duplicates()
    return pd.DataFrame([{"home": k, "name": v["name"].to_numpy().tobytes()} for k, v in pairs.groupby("home")], columns=["home", "name"])


def _write_shared(path: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        home = int(frame["home"].iloc[0])
        write_file(f"{path}/shared-{home}", np.unique(_packed(frame, "name", np.uint64)).tobytes())
        return pd.DataFrame({"home": [home]})

    return run


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    """Hash of the window that starts at each word (meaningless in the last window - 1)."""
    out = np.zeros(len(h), np.uint64)
    for j in range(min(window, len(h))):
        out[: len(h) - j] += h[j:] * _PLACES[j % 256] * np.uint64(2 * (j // 256) + 1)
    return mix64(out)


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start) of runs of consecutive starts, by row."""
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] > start[:-1] + 1)
    first = np.flatnonzero(new)
    return row[first], start[first], start[np.append(first[1:], len(row)) - 1] if len(row) else start


_WINDOWS = "shard long, home long, hash binary, doc binary, key binary, row binary, start binary, runs binary"


def _send_windows(path: str, ways: list[int], window: int, shards: int, chars: int):
    """Candidate windows of each slice, the first of equal ones alone; the others repeat for certain, and their runs go along."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in _slices(batches, chars):
            home = int(part["home"].iloc[0])
            h, at = word_hashes(as_bytes(part["text"]))
            name, first, last = provable(renamed(h, at, ways), at, window)
            _, of, n = np.unique(name, return_inverse=True, return_counts=True)
            once = np.flatnonzero(n[of] == 1)
            known = mapped(f"{path}/shared-{home}")
            known = np.zeros(0, np.uint64) if known is None else known.view(np.uint64)
            if len(known):
                i = np.minimum(np.searchsorted(known, name[once]), len(known) - 1)
                once = once[known[i] != name[once]]
            out = np.zeros(len(h) + 1, np.int64)  # windows that a symbol of one occurrence rules out
            np.add.at(out, first[once], 1)
            np.add.at(out, last[once] + 1, -1)
            text = np.repeat(np.arange(len(part)), np.diff(at))
            start = np.flatnonzero((np.cumsum(out[:-1]) == 0) & (np.arange(len(h)) + window <= at[text + 1]))
            if not len(start):
                continue
            hashes, text = window_hashes(h, window)[start], text[start]
            doc = part["doc_id"].to_numpy(np.int64)[text]
            key, row = part["key"].to_numpy(np.int64)[text], part["row"].to_numpy(np.int64)[text]
            start = start - at[text]
            order = np.lexsort((row, start, key, doc, hashes))
            hashes, doc, key, row, start = (x[order] for x in (hashes, doc, key, row, start))
            new = np.ones(len(order), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            same = (doc == doc[head]) & (key == key[head]) & (start == start[head])  # the first, and the same place in rows that repeat it
            send = np.flatnonzero(same)
            send = send[np.lexsort((start[send], row[send]))]
            sent = _dealt(_slot(hashes[send], shards), home, shards, hash=hashes[send], doc=doc[send], key=key[send], row=row[send].astype(np.uint32), start=start[send].astype(np.uint32))
            sent["runs"] = None
            yield sent
            if not same.all():
                runs = np.stack(_runs(row[~same], start[~same])).astype(np.int64)
                yield pd.DataFrame({"shard": [home % shards], "home": [home], "hash": [b""], "doc": [b""], "key": [b""], "row": [b""], "start": [b""], "runs": [runs.T.tobytes()]})

    return run


def _repeated_windows(frame: pd.DataFrame) -> pd.DataFrame:
    """For each home, the windows of a shard that start earlier elsewhere, as runs; runs that came along stay."""
    hashes, doc, key = (_packed(frame, c, k) for c, k in (("hash", np.uint64), ("doc", np.int64), ("key", np.int64)))
    row, start = _packed(frame, "row", np.uint32).astype(np.int64), _packed(frame, "start", np.uint32).astype(np.int64)
    home = np.repeat(frame["home"].to_numpy(), [len(x) // 8 for x in frame["hash"]])
    order = np.lexsort((start, key, doc, hashes))
    hashes, doc, key, row, start, home = (x[order] for x in (hashes, doc, key, row, start, home))
    new = np.ones(len(order), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    later = ~((doc == doc[head]) & (key == key[head]) & (start == start[head]))
    home, row, start = home[later], row[later], start[later]
    out = []
    for k in np.unique(home):
        mine = home == k
        out.append({"home": int(k), "runs": np.stack(_runs(row[mine], start[mine])).T.tobytes()})
    kept = frame[frame["runs"].notna()]
    out += [{"home": int(k), "runs": v} for k, v in zip(kept["home"], kept["runs"])]
    return pd.DataFrame(out, columns=["home", "runs"])


def _write_runs(path: str):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        home = int(frame["home"].iloc[0])
        runs = _packed(frame, "runs", np.int64).reshape(-1, 3)
        runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        write_file(f"{path}/runs-{home}", np.ascontiguousarray(runs.T).tobytes())
        return pd.DataFrame({"home": [home]})

    return run


def _kept(path: str, window: int, texts: bool):
    """Each text without the words that runs of its home cover."""
    from hashlib import sha256
    from itertools import compress

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            words_of, removed, digest, kept = [], [], [], []
            runs_of = {}
            for home in b["home"].unique():
                raw = mapped(f"{path}/runs-{home}")
                runs_of[home] = np.zeros((3, 0), np.int64) if raw is None else raw.view(np.int64).reshape(3, -1)
            for home, row, text in zip(b["home"], b["row"], as_bytes(b["text"])):
                words = text.split()  # bytes split at ASCII white space alone
                runs = runs_of[home]
                i, j = np.searchsorted(runs[0], [row, row + 1])
                gone = 0
                if i < j:
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, runs[1, i:j], 1)
                    np.add.at(cover, runs[2, i:j] + window, -1)
                    stay = np.cumsum(cover[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    left = b" ".join(compress(words, stay.tolist()))
                else:
                    left = b" ".join(words)
                words_of.append(len(words))
                removed.append(gone)
                digest.append(sha256(left).hexdigest())
                if texts:
                    kept.append(left.decode("utf-8", "surrogatepass"))
            out = pd.DataFrame({"doc_id": b["doc_id"], "n_words": words_of, "n_removed": removed, "kept_sha256": digest})
            yield out.assign(kept=kept) if texts else out

    return run


def repeated_substrings(docs: DataFrame, window: int = WINDOW, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of ``docs`` (doc_id, text); with ``texts`` also ``kept``, the words that stay.

    Words are runs of characters other than ASCII white space, unchanged. Every word that
    lies in a window of ``window`` consecutive words whose sequence also starts earlier
    (in a smaller doc_id, or earlier in the same document) is removed; windows are judged
    on the input. Null and empty texts have no words, texts of fewer words than a
    window lose none, texts of any length are read whole. Rows of one doc_id with equal
    texts are one document and get equal results; those with different texts count one after the other, by a hash of
    their texts. Rows without doc_id come after all others. Other columns are not read; an empty table gives no rows.
    """
    if window < 1:
        raise ValueError("a window holds at least one word")
    spark = docs.sparkSession
    slim = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), "text")
    held = materialize(slim.mapInPandas(_homes(SLICE_CHARS, HOME_CHARS), "home long, row long, doc_id long, key long, text string, counts array<long>"), "homes", "zstd")
    rows = held.where("counts IS NULL").drop("counts")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards, path = max(1, size // SHARD_CHARS), shared_path(spark, "repeats")

    ways = [_chosen(held.where("counts IS NOT NULL"), 0)]
    slim = rows.select("home", "text")
    while len(ways) < ROUNDS.count("p"):
        ways.append(_chosen(slim.mapInPandas(_count_ways(ways, SLICE_CHARS), "counts array<long>"), len(ways)))

    sent = slim.mapInPandas(_send_symbols(ways, window, shards, SLICE_CHARS), "shard long, home long, name binary, more binary")
    told = sent.groupBy("shard").applyInPandas(_shared_symbols, "home long, name binary")
    materialize(told.groupBy("home").applyInPandas(_write_shared(path), "home long"), "told")
    sent = rows.mapInPandas(_send_windows(path, ways, window, shards, SLICE_CHARS), _WINDOWS)
    told = sent.groupBy("shard").applyInPandas(_repeated_windows, "home long, runs binary")
    materialize(told.groupBy("home").applyInPandas(_write_runs(path), "home long"), "told")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if texts else "")
    out = rows.select("home", "row", "doc_id", "text").mapInPandas(_kept(path, window, texts), schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL_ID)))


#: DuckDB SQL for windows of 20 words.
SUBSTRINGS_SQL = r"""
            WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
            g AS (
              SELECT doc_id, x.i AS i, x.s AS s
              FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {'i': i, 's': array_to_string(w[i:i + 19], ' ')})) AS x FROM w WHERE len(w) >= 20)),
            m AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
            c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM m),
            k AS (
              SELECT u.doc_id, count(*) AS n, string_agg(u.word, ' ' ORDER BY u.j) AS kept
              FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM w) u ANTI JOIN c ON c.doc_id = u.doc_id AND c.j = u.j
              GROUP BY u.doc_id)
            SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
            FROM w LEFT JOIN k ON k.doc_id = w.doc_id"""
