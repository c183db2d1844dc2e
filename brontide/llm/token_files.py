"""Token ids in binary files: frequency-ranked ids, one to four bytes each, with the lengths in separate control bytes.

A file holds consecutive documents: counts, doc_ids, tokens of each document,
then two bits for each token (four to a control byte) and the tokens' data
bytes. Ids are replaced by their rank by frequency over the corpus, so the
commonest 256 take one byte. Decoding looks each control byte up in a table of
lengths and gathers all tokens of one length at once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .files import read_file, write_file
from .shared import as_bytes, chunks_by_bytes, materialize, shared_path, word_spans

END_ID = 2
#: Bytes of text for each range of doc_ids, about; a range is one task.
RANGE_CHARS = 8_000_000
#: Characters encoded at once, a row of the intermediate table.
RUN_CHARS = 8_000_000
#: Words kept with their ids by a worker.
CACHE_WORDS = 1_200_000
#: Words that the tokenizer gets in one line, and what parts them there.
LINE_WORDS, _MARK = 512, "\x01"
#: Bytes of text whose words are looked up at once, new words cut out of it at once; they bound what a worker takes.
ENCODE_BYTES, ENCODE_WORDS = 1 << 20, 1 << 14
MAGIC = b"BTOK0001"
_LENGTHS = np.stack([(np.arange(256) >> s & 3) + 1 for s in (0, 2, 4, 6)], 1).astype(np.uint8)


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = values.astype(np.uint32, copy=False)
    size = np.ones(len(values), np.uint8)
    for limit in (0xFF, 0xFFFF, 0xFFFFFF):
        size += values > limit
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    code = code.reshape(-1, 4)
    control = code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    data = np.empty(int(end[-1]) if len(values) else 0, np.uint8)
    data[at] = values & np.uint32(0xFF)
    for k in (1, 2, 3):
        i = np.flatnonzero(size > k)
        if len(i):
            data[at[i] + k] = values[i] >> np.uint32(8 * k) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_values(control: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Inverse of ``encode_values``, from arrays of bytes."""
    size = _LENGTHS[control].reshape(-1)[:n]
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(n, np.uint32)
    out[:] = data[at] if n else 0
    for k in (1, 2, 3):
        i = np.flatnonzero(size > k)
        if len(i):
            out[i] |= data[at[i] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def pack(doc_ids: np.ndarray, missing: np.ndarray, counts: np.ndarray, ranks: np.ndarray) -> bytes:
    control, data = encode_values(ranks)
    head = np.array([len(doc_ids), len(ranks), len(data)], "<i8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), missing.astype(np.uint8).tobytes(), counts.astype("<u4").tobytes(), control, data])


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, missing, counts, ranks) of a file."""
    if raw[:8] != MAGIC:
        raise ValueError("not a token file")
    docs, tokens, size = np.frombuffer(raw, "<i8", 3, 8)
    at = 32
    ids = np.frombuffer(raw, "<i8", docs, at)
    missing = np.frombuffer(raw, np.uint8, docs, at := at + 8 * docs).astype(bool)
    counts = np.frombuffer(raw, np.uint8, 4 * docs, at := at + docs).view("<u4")
    control = np.frombuffer(raw, np.uint8, -(-tokens // 4), at := at + 4 * docs)
    data = np.frombuffer(raw, np.uint8, size, at + len(control))
    return ids, missing, counts, decode_values(control, data, tokens)


@lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class _Known:
    """Ids of the words a worker has met, by the words' 64-bit hash; emptied when there are more than CACHE_WORDS."""

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.clear()

    def clear(self) -> None:
        # Sorted hashes and their rows: arrays, as millions of small objects would keep a worker's memory torn after they are gone.
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.used = 0
        self.flat = np.zeros(1 << 16, np.uint32)
        self.size = np.zeros(1 << 14, np.int32)
        self.begin = np.zeros(1 << 14, np.int64)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, how many of each word). Words go through the tokenizer in lines, a mark between them; a line that holds the mark otherwise goes word by word."""
        flat, sizes = [], []
        for i in range(0, len(words), LINE_WORDS):
            some = words[i : i + LINE_WORDS]
            line = f" {_MARK} ".encode().join(some).decode("utf-8", "replace")
            if self.mark is None or line.count(_MARK) != len(some) - 1:
                got = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)]
                flat.append(np.array([x for ids in got for x in ids], np.uint32))
                sizes.append(np.array([len(ids) for ids in got], np.int64))
                continue
            ids = np.array(self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            mark = ids == self.mark
            flat.append(ids[~mark])
            sizes.append(np.diff(np.flatnonzero(mark), prepend=-1, append=len(ids)) - 1)
        return np.concatenate(flat), np.concatenate(sizes)

    def rows(self, hashes: np.ndarray, text: bytes, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Rows of sorted distinct hashes, whose words are text[begin:stop]."""
        if len(self.keys) + len(hashes) > CACHE_WORDS:
            self.clear()
        n = len(self.keys)
        at = np.searchsorted(self.keys, hashes)
        held = np.zeros(len(hashes), bool)
        inside = np.flatnonzero(at < n)
        held[inside] = self.keys[at[inside]] == hashes[inside]
        got = np.zeros(len(hashes), np.int64)
        got[held] = self.place[at[held]]
        new = np.flatnonzero(~held)
        if len(new):
            got[new] = np.arange(n, n + len(new))
            self.size, self.begin = _grown(self.size, n + len(new)), _grown(self.begin, n + len(new))
            for first in range(0, len(new), ENCODE_WORDS):
                some = new[first : first + ENCODE_WORDS]
                ids, size = self.encode([text[b:e] for b, e in zip(begin[some].tolist(), stop[some].tolist())])
                self.flat = _grown(self.flat, self.used + len(ids))
                self.flat[self.used : self.used + len(ids)] = ids
                self.size[got[some]] = size
                self.begin[got[some]] = self.used + np.cumsum(size) - size
                self.used += len(ids)
            self.keys, self.place = np.insert(self.keys, at[new], hashes[new]), np.insert(self.place, at[new], got[new])
        return got


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


@lru_cache(1)
def _known(path: str) -> _Known:
    return _Known(path)


def encode_texts(texts: list[str | None], tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids, tokens of each text) with END_ID after each text.

    The tokenizer drops white space and splits there, so a text's ids are those
    of its white-space-parted words end to end; each distinct word is encoded once.
    """
    data = as_bytes(texts)
    if not data:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    known = _known(tokenizer)
    ids, n = zip(*(_encoded(data[at], known) for at in chunks_by_bytes([len(t) for t in data], ENCODE_BYTES)))
    return np.concatenate(ids), np.concatenate(n)


def _encoded(data: list[bytes], known: _Known) -> tuple[np.ndarray, np.ndarray]:
    h, at, start, end = word_spans(data)
    n_words = np.diff(at)
    base = np.repeat(np.cumsum([0] + [len(t) + 1 for t in data])[:-1], n_words)
    whole = b" ".join(data)
    distinct, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    row = known.rows(distinct, whole, (start + base)[first], (end + base)[first])[inverse]
    # The end id is one more piece behind each text's words.
    ends = np.cumsum(n_words + 1) - 1
    is_end = np.zeros(len(h) + len(data), bool)
    is_end[ends] = True
    sizes, source = np.ones(len(is_end), np.int64), np.zeros(len(is_end), np.int64)
    sizes[~is_end], source[~is_end] = known.size[row], known.begin[row]
    to = np.cumsum(sizes)
    out = known.flat[np.arange(int(to[-1])) + np.repeat(source - (to - sizes), sizes)]
    out[to[ends] - 1] = END_ID
    return out, np.add.reduceat(sizes, ends - n_words)


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as 16 bits where they all fit, else as 32; the first byte says which."""
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 1 << 16 else b"\4" + ids.astype("<u4").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if raw[0] == 2 else "<u4", offset=1).astype(np.uint32)


def write_tokens(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, str]:
    """Write ``docs`` (doc_id, text) as token files; (table of files, their folder).

    The table: part, seq (of the file's first document in its range), file,
    n_docs, n_ids. Documents stand in ascending doc_id order, nulls first, rows of
    one doc_id by their text's hash; files by (part, seq).
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = rows.agg(F.sum(F.length("text")), F.count(F.lit(1))).first()
    parts = max(1, ((size[0] or 0) + 100 * size[1]) // RANGE_CHARS)
    rows = rows.withColumn("_tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "_tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_tie")
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")

    def tokenize(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seq = 0
        for b in batches:
            texts = b["text"].tolist()
            for at in chunks_by_bytes([len(t or "") for t in texts], RUN_CHARS):
                ids, n = encode_texts(texts[at], tokenizer)
                ids_of = b["doc_id"].iloc[at]
                yield pd.DataFrame([{
                    "part": int(b["part"].iloc[0]), "seq": seq, "doc_ids": ids_of.fillna(0).astype("int64").to_numpy().tobytes(),
                    "missing": ids_of.isna().to_numpy().tobytes(), "counts": n.astype("<u4").tobytes(), "ids": _narrow(ids),
                }])
                seq += len(n)

    # A row for each run of consecutive documents.
    encoded = rows.mapInPandas(tokenize, "part int, seq long, doc_ids binary, missing binary, counts binary, ids binary")
    path = shared_path(spark, "ids")
    encoded.write.option("compression", "zstd").parquet(path)
    encoded = spark.read.schema(encoded.schema).parquet(path)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["ids"]:
                n = np.bincount(_wide(raw))
                yield pd.DataFrame({"id": np.flatnonzero(n), "n": n[n > 0]})

    # As many rows as the vocabulary has at most.
    frequency = encoded.select("ids").mapInPandas(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").toPandas()
    ids = frequency["id"].to_numpy(np.uint32)
    rank = np.zeros(int(ids.max()) + 1 if len(ids) else 1, np.uint32)
    rank[ids] = np.arange(len(ids))
    folder = shared_path(spark, "tokens")
    write_file(f"{folder}/ranked", ids.astype("<u4").tobytes())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                doc_ids, missing, n = np.frombuffer(r.doc_ids, "<i8"), np.frombuffer(r.missing, bool), np.frombuffer(r.counts, "<u4")
                ranks = rank[_wide(r.ids)]
                file = f"{folder}/{r.part:08d}-{r.seq:012d}"
                write_file(file, pack(doc_ids, missing, n, ranks))
                yield pd.DataFrame([{"part": r.part, "seq": r.seq, "file": file, "n_docs": len(n), "n_ids": len(ranks)}])

    files = materialize(encoded.mapInPandas(encode, "part int, seq long, file string, n_docs long, n_ids long"), "files")
    return files, folder


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the files, decoded."""
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    ranges = files.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = ranges.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    placed = files.withColumn("_in", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(before, "part")
    placed = placed.select("file", (F.col("_in") + F.col("_base")).alias("start"))
    placed = placed.repartition(max(1, files.count() // 4), "file")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ranked = np.frombuffer(read_file(f"{folder}/ranked"), "<u4")
        for b in batches:
            for r in b.itertuples():
                doc_ids, missing, counts, ranks = unpack(read_file(r.file))
                ids = ranked[ranks].astype("<u4")
                end = np.cumsum(counts, dtype=np.int64)
                begin = end - counts
                raw = memoryview(ids.view(np.uint8))
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(begin, end)]
                yield pd.DataFrame({"doc_id": pd.Series(doc_ids).astype("Int64").mask(missing), "start": r.start + begin, "n_tokens": counts.astype(np.int64), "ids_crc32": np.array(crc, np.int64)})

    return placed.mapInPandas(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row of ``docs``, read back from the token files.

    Null and empty texts have the end id alone. start counts the ids of all
    documents before. Texts are encoded whole, whatever their length; rows that repeat follow each other,
    each with its own ids; other columns are not read, whatever their names.
    An empty table gives an empty result.
    """
    return read_tokens(*write_tokens(docs, tokenizer))
