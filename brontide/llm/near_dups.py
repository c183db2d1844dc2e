"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature is SYMBOLS values of 16 bits, one per hash function. It is split
into CHUNKS of SYMBOLS / CHUNKS symbols. If two signatures differ in at most
2 * CHUNKS - 1 symbols, one chunk differs in at most one symbol (pigeonhole), so
indexing every chunk under each of its "all but one symbol" keys finds every
such pair. At a similarity of 0.8 a pair escapes all keys with probability
0.18 ** CHUNKS (1e-6 for 8 chunks).

Texts with equal shingle sets are one class before anything is joined. Links are
confirmed on full sets. In a key's bucket every member is first linked to the
smallest one; only in buckets that the components of these links leave apart are
members then compared with each other, block by block and each pair under the
first key it shares, on sets that the rows carry. So a bucket of copies costs its
size, only links leave a task, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import NOT_SPACE, as_bytes, chunks_by_bytes, fresh, materialize, mix64, word_hashes

SYMBOLS, CHUNKS = 32, 8
PER_CHUNK = SYMBOLS // CHUNKS
#: Members of a bucket that one block holds.
BLOCK = 512
#: Runs up to this long are compared many at a time; pairs compared at once.
SMALL_RUN, PAIRS_AT_ONCE = 64, 1 << 18
_rng = np.random.default_rng(7)
_MULTIPLY = _rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_PLACES = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(index of the first text, sorted distinct shingle hashes of some texts end to end, offsets), batch by batch."""
    data = as_bytes(texts, ascii_lower=True)
    for part in chunks_by_bytes([len(t) for t in data]):
        h, at = word_hashes(data[part])
        n = np.diff(at)
        doc = np.repeat(np.arange(len(n)), n)
        out = np.zeros(len(h), np.uint64)
        for j in range(min(k, len(h))):
            out[: len(h) - j] += h[j:] * _PLACES[j] if j else h * _PLACES[0]
        keep = np.arange(len(h)) <= at[doc + 1] - k if len(h) else np.zeros(0, bool)
        out = mix64(out)
        for i in np.flatnonzero((n > 0) & (n < k)):  # too short for a shingle: the whole sequence is one
            words = h[at[i] : at[i + 1]]
            out[at[i]] = mix64((words * _PLACES[: len(words)]).sum(keepdims=True) + _PLACES[40 + len(words) : 41 + len(words)])[0]
            keep[at[i]] = True
        out, doc = out[keep], doc[keep]
        order = np.lexsort((out, doc))
        out, doc = out[order], doc[order]
        new = np.ones(len(out), bool)
        new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        out, doc = out[new], doc[new]
        yield part.start, out, np.searchsorted(doc, np.arange(len(n) + 1))


def _signatures(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, s, at in shingle_sets(batch["text"].tolist(), k):
                n = np.diff(at)
                sig = np.zeros((len(n), SYMBOLS), np.uint16)
                h1, h2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    begin = at[:-1][full]
                    for j in range(SYMBOLS):
                        low = np.minimum.reduceat((s * _MULTIPLY[j] + _ADD[j]) >> np.uint64(32), begin)
                        sig[full, j] = mix64(low) & np.uint64(0xFFFF)
                    h1[full] = np.add.reduceat(mix64(s ^ _ADD[0]), begin)
                    h2[full] = np.add.reduceat(mix64(s ^ _ADD[1]), begin)
                ids = batch["doc_id"].iloc[first : first + len(n)]
                yield pd.DataFrame({"doc_id": pd.Series(ids.to_numpy(), dtype=object), "n_shingles": n, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "sig": [x.tobytes() for x in sig]})

    return run


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, node): every chunk with each of its symbols left out."""
    for batch in batches:
        if len(batch):
            sig = np.frombuffer(b"".join(batch["sig"]), np.uint16).reshape(-1, CHUNKS, PER_CHUNK).astype(np.uint64)
            for c in range(CHUNKS):
                for out in range(PER_CHUNK):
                    key = np.full(len(sig), c * PER_CHUNK + out + 1, np.uint64)
                    for x in range(PER_CHUNK):
                        if x != out:
                            key = key * np.uint64(1 << 16) + sig[:, c, x]
                    yield pd.DataFrame({"key": key.view(np.int64), "node": pd.Series(batch["node"].to_numpy(), dtype=object)})


def _sets(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            for first, s, at in shingle_sets(batch["text"].tolist(), k):
                s = s.view(np.int64)
                cut = [s[a:b] for a, b in zip(at, at[1:])]
                yield pd.DataFrame({"node": pd.Series(ids[first : first + len(cut)], dtype=object), "shingles": cut})

    return run


def confirmed(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    sizes = nodes.select("node", "n")
    fits = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b").where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    both = fits.select("a", "b").join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    same = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * same >= percent * (F.size("sa") + F.size("sb") - same)).select("a", "b")


def _pairs_of_runs(edges: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (x, y) of all pairs inside runs of at most ``most`` rows, for all runs of one length together."""
    size = np.diff(edges)
    for m in np.unique(size[(size > 1) & (size <= most)]):
        begin = edges[:-1][size == m]
        x, y = np.triu_indices(m, 1)
        for part in np.array_split(begin, max(1, len(begin) * len(x) // PAIRS_AT_ONCE + 1)):
            yield (part[:, None] + x).ravel(), (part[:, None] + y).ravel()


def _first_shared(sig: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of the first key that two signatures share, 0 if they share none."""
    out = np.zeros(len(x), np.int64)
    for c in range(CHUNKS - 1, -1, -1):
        other = sig[x, c * PER_CHUNK : (c + 1) * PER_CHUNK] != sig[y, c * PER_CHUNK : (c + 1) * PER_CHUNK]
        n = other.sum(1)
        out = np.where(n <= 1, c * PER_CHUNK + np.where(n == 1, other.argmax(1), 0) + 1, out)
    return out


def _links(percent: int):
    """Confirmed links (a, b) of different components, for each run of (key, i, j); runs may cross batches.

    Every pair is looked at once, under the first key that it shares, and compared
    on the full sets that the rows carry, however far apart its signatures are.
    """

    def found(frame: pd.DataFrame) -> pd.DataFrame:
        code = frame[["key", "i", "j"]].to_numpy()
        edges = np.concatenate([[0], np.flatnonzero((code[1:] != code[:-1]).any(1)) + 1, [len(frame)]])
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(-1, SYMBOLS)
        node, component, block = (frame[c].to_numpy() for c in ("node", "component", "block"))
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in frame["shingles"]]
        size = np.array([len(x) for x in sets])

        def checked(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
            fits = (component[x] != component[y]) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = x[fits], y[fits]
            k = _first_shared(sig, x, y) == code[x, 0] >> 48
            out = []
            for p, q in zip(x[k].tolist(), y[k].tolist()):
                a, b = (sets[p], sets[q]) if size[p] <= size[q] else (sets[q], sets[p])
                same = int((b[np.minimum(b.searchsorted(a), len(b) - 1)] == a).sum()) if len(a) else 0
                if 100 * same >= percent * (len(a) + len(b) - same):
                    out.append((node[p], node[q]))
            return out

        got: list[tuple[int, int]] = []
        for x, y in _pairs_of_runs(edges, SMALL_RUN):
            got += checked(x, y)
        for s, e in zip(edges[:-1], edges[1:]):
            if e - s > SMALL_RUN:  # a block, or two that meet
                rows = np.arange(s, e)
                left, right = rows[block[rows] == code[s, 1]], rows[block[rows] == code[s, 2]]
                for some in np.array_split(left, max(1, len(left) * len(right) // PAIRS_AT_ONCE + 1)):
                    x, y = np.repeat(some, len(right)), np.tile(right, len(some))
                    once = x < y if code[s, 1] == code[s, 2] else np.ones(len(x), bool)
                    got += checked(x[once], y[once])
        pairs = sorted({(min(g), max(g)) for g in got})
        return pd.DataFrame({"a": pd.Series([a for a, _ in pairs], dtype=object), "b": pd.Series([b for _, b in pairs], dtype=object)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            if len(batch):
                frame = batch if held is None else pd.concat([held, batch], ignore_index=True)
                last = frame[["key", "i", "j"]].iloc[-1]
                same = (frame["key"] == last["key"]) & (frame["i"] == last["i"]) & (frame["j"] == last["j"])
                held = frame[same].reset_index(drop=True)
                if not same.all():
                    yield found(frame[~same].reset_index(drop=True))
        if held is not None:
            yield found(held)

    return run


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    A text's set holds the distinct k-word shingles of its words (A-Z lower-cased,
    words parted by ASCII white space); a text of fewer words has its whole
    sequence as one; null and empty texts have the empty set and link with
    nothing. Documents with 100 * intersection >= percent * union are linked.
    component_id is the smallest doc_id reachable; kept is doc_id = component_id.
    Rows that share a doc_id are one document: the links of any of them count.
    Rows without doc_id get their shingle count, a null component and null kept.
    doc_id is of any type that has an order. Texts are read whole, whatever their
    length; other columns are not read; an empty table gives an empty one.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_shingles bigint, h1 bigint, h2 bigint, sig binary"
    base = materialize(docs.mapInPandas(_signatures(k), schema), "signatures")
    some = base.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = some.groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("node"), F.first("sig").alias("sig"))
    nodes = materialize(nodes.select("node", F.col("n_shingles").alias("n"), "h1", "h2", "sig"), "nodes")
    members = some.join(nodes.select("h1", "h2", F.col("n").alias("n_shingles"), "node"), ["h1", "h2", "n_shingles"]).select("doc_id", "node")

    keys = nodes.select("node", "sig").mapInPandas(_keys, f"key bigint, node {kind}")
    keys = materialize(keys, "keys")
    # Keys with the same members need one bucket only, the first one's.
    heads = keys.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("_last"), F.count(F.lit(1)).alias("_n"), F.expr("bit_xor(xxhash64(node))").alias("_x"), F.expr("bit_xor(xxhash64(node, 1L))").alias("_y"))
    heads = heads.where("head < _last").groupBy("head", "_last", "_n", "_x", "_y").agg(F.min("key").alias("key"))
    buckets = materialize(keys.join(heads.select("key", "head", F.col("_n").alias("members")), "key"), "buckets")
    # Sets of all members of buckets, made once. A shuffle join at any size, so that costs grow evenly.
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct()
    sets = materialize(docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInPandas(_sets(k), f"node {kind}, shingles array<bigint>"), "sets")
    star = materialize(buckets.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "star")
    # Rows of one doc_id in several classes tie those classes together.
    several = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("_hi")).where("a < _hi").drop("_hi")
    tied = members.distinct().join(several, "doc_id").select("a", F.col("node").alias("b")).where("a <> b").distinct()
    links = materialize(confirmed(star, nodes, sets, percent).unionByName(tied), "confirmed")
    found = materialize(connected_components(links), "components")

    named = buckets.select("key", "node", "members").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = materialize(named, "named")
    open_keys = named.groupBy("key").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).where("_lo < _hi").select("key")
    rest = named.join(open_keys, "key").withColumn("_blocks", F.expr(f"(members - 1) div {BLOCK} + 1"))
    rest = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("_blocks"))).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    rest = rest.select("key", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "node", "component")
    carried = sets.join(nodes.select("node", "sig").dropDuplicates(["node"]), "node")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # much work for few rows: not to be coalesced by size
    rest = rest.join(carried, "node").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "block", "node", "component", "sig", "shingles")
    more = materialize(rest.mapInPandas(_links(percent), f"a {kind}, b {kind}").distinct(), "confirmed")
    found = connected_components(links.unionByName(more))

    named = members.select("doc_id", "node").distinct().join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    named = named.groupBy("doc_id").agg(F.min(F.coalesce("component", "node")).alias("_component"))
    out = base.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def without_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; rows without words stay.

    Rows without doc_id come after all that have one, by a hash of their text: they
    stay only if their group has no other row. Of several rows with the kept doc_id, or
    the kept text of a group without ids, one stays. doc_id is of any integer type or a string.
    """
    stand_in, known = fresh(docs.columns, "_id", "_known")
    text = F.coalesce("text", F.lit(""))
    if isinstance(docs.schema["doc_id"].dataType, T.StringType):  # above all other strings
        of_text = F.concat(F.lit(chr(0x10FFFF)), F.sha2(text.cast("binary"), 256))
    else:
        of_text = F.xxhash64(text).bitwiseOR(F.lit(1 << 62)).bitwiseAND(F.lit((1 << 63) - 1))
    all_rows = docs.withColumn(stand_in, F.coalesce(F.col("doc_id").cast(_id_type(docs)), of_text))
    drop = near_duplicates(all_rows.select(F.col(stand_in).alias("doc_id"), "text"), k, percent).where("NOT kept").select(F.col("doc_id").alias(known)).distinct()
    out = all_rows.join(drop, F.col(stand_in) == F.col(known), "left_anti")
    empty = out.where(F.col("doc_id").isNull() & ~text.rlike(NOT_SPACE))
    rest = out.where(F.col("doc_id").isNotNull() | text.rlike(NOT_SPACE))
    return rest.dropDuplicates([stand_in]).unionByName(empty).select(*docs.columns)


def _id_type(docs: DataFrame) -> str:
    return "string" if isinstance(docs.schema["doc_id"].dataType, T.StringType) else "long"
