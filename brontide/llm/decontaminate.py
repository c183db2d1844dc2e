"""Benchmark decontamination by winnowing, in DataFrame operations only.

Of every WINDOW - GRAM + 1 consecutive GRAM-word hashes the smallest is kept, in
documents and in benchmark items alike; a shared span of WINDOW words therefore
shares a fingerprint. Texts whose fingerprints join those of the benchmark, first by a
bitmap inside the scan, are hits, and only their windows are then extended to whole
spans, by the windows' full 128-bit hashes. Items
shorter than a window are looked up by hashes of their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .privacy import TermBits
from .shared import fresh, let, materialize

WINDOW, GRAM = 10, 5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(exact: bool) -> Column:
    """Words of text. exact: A-Z alone lower-cased; else all letters, which takes less time and keeps equal what was equal."""
    if exact:
        low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    else:
        low = F.replace(F.lower("text"), F.lit("ς"), F.lit("σ"))  # which of them lower() makes depends on what follows
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _starts(items: Column, n: int) -> Column:
    """0-based starts of all runs of n entries of an array."""
    return F.when(F.size(items) >= n, F.sequence(F.lit(0), F.size(items) - n)).otherwise(F.array().cast("array<int>"))


def _grams(hashes: Column, n: int) -> Column:
    return F.transform(_starts(hashes, n), lambda i: F.xxhash64(F.lit(n), *[F.get(hashes, i + j) for j in range(n)]))


def _winnowed(grams: Column) -> Column:
    span = WINDOW - GRAM + 1
    return F.transform(_starts(grams, span), lambda i: F.array_min(F.slice(grams, i + 1, span)))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _fingerprints(words: Column, short: list[int]) -> Column:
    """Distinct winnowed hashes of an array of words, and the hashes of all runs of each length of ``short``."""
    of = lambda h: F.array_distinct(F.concat(let(_grams(h, GRAM), _winnowed), *[_grams(h, m) for m in short]))
    return let(_hashes(words), of)


def _cut(words: Column, m: int) -> Column:
    return F.transform(_starts(words, m), lambda i: F.struct(F.lit(m).alias("_len"), i.alias("_at"), F.array_join(F.slice(words, i + 1, m), " ").alias("_s")))


def _windows(df: DataFrame, lengths: list[int]) -> DataFrame:
    """Explodes the array column _words into (_len, _at, _x, _y): length, start and 128-bit hash of each window."""
    df = df.withColumn("_win", F.explode(let(F.col("_words"), lambda w: F.concat(*[_cut(w, m) for m in lengths]))))
    text = F.col("_win._s")
    return df.select("*", "_win._len", "_win._at", F.xxhash64(text).alias("_x"), F.xxhash64(F.lit(17), text).alias("_y")).drop("_win", "_words")


def _whole(m: int):
    return lambda h: _grams(h, m)


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[int]]:
    """(windows, fingerprints, lengths below WINDOW that items have)."""
    items = benchmark.where("item_id IS NOT NULL").select("item_id", "text")
    exact = items.select("item_id", _words(True).alias("_words")).where(F.size("_words") > 0)
    short = [r[0] for r in exact.select(F.size("_words").alias("n")).where(F.col("n") < WINDOW).distinct().orderBy("n").collect()]  # nine lengths at most
    whole = _windows(exact.where(F.size("_words") >= WINDOW), [WINDOW])
    parts = [_windows(exact.where(F.size("_words") == m), [m]) for m in short]
    for p in parts:
        whole = whole.unionByName(p)
    windows = materialize(whole.select("item_id", "_len", "_x", "_y").distinct(), "windows")
    loose = items.select(_words(False).alias("_words")).where(F.size("_words") > 0)
    prints = loose.where(F.size("_words") >= WINDOW).select(_fingerprints(F.col("_words"), []).alias("_f"))
    for m in short:
        own = loose.where(F.size("_words") == m)
        prints = prints.unionByName(own.select(let(_hashes(F.col("_words")), _whole(m)).alias("_f")))
    prints = materialize(prints.select(F.explode("_f").alias("_f")).distinct(), "prints")
    return windows, prints, short


def _keys() -> list[Column]:
    """128 bits of the text."""
    return [F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit(29), "text").alias("_k2")]


def _marked(docs: DataFrame, prints: DataFrame, short: list[int]) -> DataFrame:
    """(doc_id, _k1, _k2, n_words, _text) of every row of ``docs``; _text only where fingerprints say that the text may hold a window.

    The scan looks fingerprints up in a bitmap of bounded size, at two places for
    each. It passes every text with a window, and a few others that the windows then
    rule out; only the texts that pass leave the scan.
    """
    second = lambda f: F.xxhash64(F.lit(31), f)
    bits = TermBits(prints.select(F.explode(F.array("_f", second(F.col("_f")))).alias("term")))
    may = lambda f: bits.may_hold(f) & bits.may_hold(second(f))
    both = let(_words(False), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.exists(_fingerprints(w, short), may).alias("hit")))
    seen = bits.beside(docs.select("doc_id", "text")).select("doc_id", *_keys(), "text", both.alias("_s"))
    return materialize(seen.select("doc_id", "_k1", "_k2", F.col("_s.n").alias("n_words"), F.when(F.col("_s.hit"), F.col("text")).alias("_text")), "marked")


def _spans(marked: DataFrame, windows: DataFrame, short: list[int]) -> DataFrame:
    """(_k1, _k2, _at, _len, _x, _y): the occurrences of windows in each distinct text."""
    texts = marked.where("_text IS NOT NULL").groupBy("_k1", "_k2").agg(F.min("_text").alias("text"))
    spans = _windows(texts.select("_k1", "_k2", _words(True).alias("_words")), [WINDOW, *short])
    return materialize(spans.join(windows.select("_len", "_x", "_y").distinct(), ["_len", "_x", "_y"], "left_semi"), "spans")


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of ``docs`` (doc_id, text).

    Words are runs of [a-z0-9] and non-ASCII characters after lower-casing A-Z.
    A window is WINDOW consecutive words of an item, or all words of a shorter
    one. A word inside an occurrence of a window is hit; an item counts if one of
    its windows occurs. Null and empty texts have no words; items without words
    or item_id take no part; rows of one item_id are one item. Equal texts get
    equal results, so hits are found once for each distinct text; rows that repeat get
    equal results. Texts are read whole, whatever their length; other columns
    are not read; an empty table gives an empty one.
    """
    windows, prints, short = benchmark_windows(benchmark)
    marked = _marked(docs, prints, short)
    spans = _spans(marked, windows, short)
    covered = F.size(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("_at"), F.col("_at") + F.col("_len") - 1)))))
    words = spans.groupBy("_k1", "_k2").agg(covered.cast("long").alias("n_hit"))
    items = spans.select("_k1", "_k2", "_len", "_x", "_y").distinct().join(windows, ["_len", "_x", "_y"]).select("_k1", "_k2", F.col("item_id").cast("string").alias("_item"))
    items = items.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("_item")).alias("_items"))
    found = words.join(items, ["_k1", "_k2"])
    rows = marked.select("doc_id", "_k1", "_k2", "n_words", F.col("_text").isNotNull().alias("_may"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    shown = lambda df: df.select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce(F.size("_items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("_items", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
    clear = rows.where("NOT _may").withColumns({"n_hit": F.lit(None).cast("long"), "_items": F.lit(None).cast("array<string>")})
    return shown(clear).unionByName(shown(rows.where("_may").join(found, ["_k1", "_k2"], "left")))  # most rows meet no shuffle


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents whose text holds a window of ``benchmark``: all rows of their doc_id go, and all rows without doc_id that have such a text."""
    windows, prints, short = benchmark_windows(benchmark)
    marked = _marked(docs, prints, short)
    texts = _spans(marked, windows, short).select("_k1", "_k2").distinct()
    bad = marked.where("_text IS NOT NULL").join(texts, ["_k1", "_k2"], "left_semi")
    gone, a, b = fresh(docs.columns, "_gone", "_g1", "_g2")
    named = bad.where("doc_id IS NOT NULL").select(F.col("doc_id").alias(gone)).distinct()
    nameless = bad.where("doc_id IS NULL").select(F.col("_k1").alias(a), F.col("_k2").alias(b)).distinct()
    kept = docs.where("doc_id IS NOT NULL").join(named, F.col("doc_id") == F.col(gone), "left_anti")
    one, two = F.xxhash64("text"), F.xxhash64(F.lit(29), "text")
    rest = docs.where("doc_id IS NULL").join(nameless, (one == F.col(a)) & (two == F.col(b)), "left_anti")
    return kept.select(*docs.columns).unionByName(rest.select(*docs.columns))
