"""Mixing of sources to target weights, in DataFrame operations only.

Texts are packed into fixed-length blocks of words, source by source, in a
pseudorandom order of documents. The output is a row of shards of SHARD_SLOTS
slots. For each shard the number of slots of every source is drawn from the
multinomial law of the targets. All shards together seldom meet the targets to
the word, so the draws a source has too many, chosen by a keyed permutation of
its draws, go to the sources that have too few. Slot k of a source reads block
perm(k mod B) of its B blocks, perm being a keyed permutation of the block
numbers. Blocks and slots meet in a join on (source, block).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import NOT_SPACE, fresh, let, materialize, prefix_sums

#: Weights by rank of source, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times over.
MOST = 3
BLOCK_WORDS = 256
SHARD_SLOTS = 1024
ROUNDS = 20
#: Documents per packing bucket, on average; a bucket is what one window sorts.
BUCKET_DOCS = 4096
#: Slots of one task, on average, up to as many tasks as shuffles have.
TASK_SLOTS = 1 << 14


def _source_key() -> Column:
    """A source as a join key that is never null."""
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source_key, source, source_size, target) from (source_key, source, size).

    Sharing by weight with a ceiling of ``most`` times the size, the excess shared
    again by weight, ends where target = min(ceiling, level * weight) for the one
    level at which the targets add up to the whole. Sources ordered by
    ceiling/weight fill up first, so the level follows from running sums over
    the table of sources (one row each).
    """
    by_rank = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    fill = Window.orderBy("_ratio", "source_key")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(by_rank) - 1) % len(weights) + 1)
    t = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    t = t.withColumn("_w", w).withColumn("_cap", (most * F.col("source_size")).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    t = t.withColumns({
        "_all": F.sum("source_size").over(whole),
        "_rest_w": F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
        "_full": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
    })
    # The level if exactly the sources before this one are at their ceiling; the first that stays under its ceiling sets it.
    t = t.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest_w"))
    t = t.withColumn("_at", F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "source_key", "_level"))).over(whole))
    target = F.when(F.col("_at").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_at._level") * F.col("_w")))
    return t.select("source_key", "source", "source_size", target.alias("target"))


def permuted(k: Column, n: Column, key: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Keyed permutation of 0 .. n-1 by swap-or-not rounds, for any n."""

    def swap(at, r):
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), key, r), n) + n - at, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed + 1), key, r, F.greatest(at, partner)), F.lit(2)) == 0, at).otherwise(partner)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), k.cast("long"), swap)


def mix_plan(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces).

    documents: doc_id, size, source_key, source_size, target, start (of the
    document in its source's packed words). slots: shard, slot, source_key,
    block, words (fewer than the block's for a source's last slot). pieces: the
    part of each block that a document fills: source_key, block, start, at (in
    the block), skip (words of the document before), n.

    Null text has size 0; null source is a source of its own, ranked last; an
    empty table gives empty ones. Rows that repeat are documents of their own.
    """
    base = docs.select(F.col("doc_id"), F.col("source"), F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)).cast("long").alias("size"))
    base = base.withColumn("source_key", _source_key()).withColumn("_order", F.xxhash64(F.lit(seed), "doc_id"))
    base = materialize(base, "sizes")
    buckets = max(1, base.count() // BUCKET_DOCS)
    base = base.withColumn("_bucket", F.pmod(F.shiftright("_order", 20), F.lit(buckets)))
    targets = materialize(source_targets(base, weights, most), "targets")

    filled = base.where("size > 0")
    sums = filled.groupBy("source_key", "_bucket").agg(F.sum("size").alias("_sum"))
    sums = prefix_sums(sums, "source_key", "_bucket", "_sum", "_base").select("source_key", "_bucket", "_base")
    inside = Window.partitionBy("source_key", "_bucket").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    packed = filled.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["source_key", "_bucket"])
    packed = packed.select("doc_id", "source_key", "size", (F.col("_base") + F.col("_in")).alias("start"))
    placed = packed.unionByName(base.where("size = 0").select("doc_id", "source_key", "size", F.lit(None).cast("long").alias("start")))
    placed = materialize(placed.join(targets.drop("source"), "source_key"), "placed")

    n = F.lit(block_words)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))))
    left = F.greatest(F.col("start"), F.col("block") * n)
    right = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n)
    pieces = pieces.select("source_key", "block", "start", "doc_id", (left - F.col("block") * n).alias("at"), (left - F.col("start")).alias("skip"), (right - left).alias("n"))

    return placed, _slots(targets, block_words, seed), pieces


def _owners(shares: DataFrame, first: str, count: str) -> tuple[DataFrame, int]:
    """(_cell, then the columns of ``shares``) and the cells' width: who owns which numbers when row after row owns ``count`` of them from ``first`` on.

    Joined on number div width and then held to the bounds, it finds a number's
    owner among a few rows. It has at most five rows for each of ``shares``.
    """
    n, numbers = shares.agg(F.count(F.lit(1)), F.coalesce(F.sum(count), F.lit(0))).first()
    width = numbers // (4 * n + 1) + 1
    cells = F.sequence(F.expr(f"{first} div {width}"), F.expr(f"({first} + {count} - 1) div {width}"))
    return materialize(shares.where(F.col(count) > 0).withColumn("_cell", F.explode(cells)), "owners"), width


def _tasks(targets: DataFrame, slots: int) -> int:
    return max(1, min(slots // TASK_SLOTS, int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def shard_counts(targets: DataFrame, seed: int = 1, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """(shard, source_key, n): slots of each output shard by source, from ``targets`` (source_key, _first, _count), as drawn.

    Every slot draws one of all slots that the targets ask for (numbered source
    after source from _first on), and so its source: multinomial counts.
    """
    total = targets.agg(F.coalesce(F.sum("_count"), F.lit(0))).first()[0]
    owners, width = _owners(targets.select("source_key", "_first", "_count"), "_first", "_count")
    slots = targets.sparkSession.range(0, total, 1, _tasks(targets, total))
    drawn = slots.select(F.expr(f"id div {shard_slots}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed + 6), "id"), F.lit(max(total, 1))).alias("_u"))
    drawn = drawn.withColumn("_cell", F.expr(f"_u div {width}")).join(owners, "_cell").where("_u >= _first AND _u < _first + _count")
    return drawn.groupBy("shard", "source_key").agg(F.count(F.lit(1)).alias("n"))


def _slots(targets: DataFrame, block_words: int, seed: int) -> DataFrame:
    """Slots of every source: whole passes over its blocks, then blocks until the target is met, the last one cut short.

    The short last block of a source ends every pass over it, so that a pass is
    always the source's size.
    """
    n = F.lit(block_words)
    t = targets.withColumn("_take", F.least(F.round("target").cast("long"), MOST * F.col("source_size"))).where("source_size > 0 AND _take > 0")
    t = t.withColumn("_blocks", F.expr(f"(source_size + {block_words - 1}) div {block_words}"))
    t = t.withColumn("_passes", F.expr("_take div source_size")).withColumn("_left", F.expr("_take % source_size"))
    # A further pass reads permuted blocks until _left words are met; the short block comes last in it, so all others are full.
    t = t.withColumn("_count", F.col("_passes") * F.col("_blocks") + F.expr(f"(_left + {block_words - 1}) div {block_words}"))
    upto = Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)  # one row a source, as in source_targets
    t = materialize(t.withColumn("_first", F.coalesce(F.sum("_count").over(upto), F.lit(0))), "slot-targets")

    counts = materialize(shard_counts(t, seed), "shard-counts")
    runs = prefix_sums(counts, "source_key", "shard", "n", "_begin")
    drawn = counts.groupBy("source_key").agg(F.sum("n").alias("_drawn"))
    t = t.join(drawn, "source_key", "left").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    t = t.withColumns({"_over": F.greatest(F.col("_drawn") - F.col("_count"), F.lit(0)), "_under": F.greatest(F.col("_count") - F.col("_drawn"), F.lit(0))})
    t = t.withColumns({c + "_first": F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in ("_over", "_under")})
    t = materialize(t.select("source_key", "source_size", "_blocks", "_passes", "_left", "_count", "_drawn", "_over_first", "_under", "_under_first"), "drawn-targets")
    moved, total = t.agg(F.coalesce(F.sum("_under"), F.lit(0)), F.coalesce(F.sum("_count"), F.lit(0))).first()

    inside = Window.partitionBy("shard")
    before = inside.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns({"_in": F.coalesce(F.sum("n").over(before), F.lit(0)), "_slots": F.sum("n").over(inside)})
    # Few rows that become many: dealt out by number, so that they are not put together again for their size.
    one = runs.join(t.select("source_key", "_count", "_drawn", "_over_first"), "source_key").repartition(_tasks(t, total), "shard", "source_key").withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    k = permuted(F.col("_begin") + F.col("_j"), F.col("_drawn"), F.col("source_key"), seed + 8)
    slot = permuted(F.col("_in") + F.col("_j"), F.col("_slots"), F.col("shard").cast("string"), seed + 4)
    one = materialize(one.select("source_key", "shard", slot.alias("slot"), k.alias("_k"), "_count", "_over_first"), "draws")
    kept = one.where("_k < _count").select("source_key", "shard", "slot", "_k")
    owners, width = _owners(t.select(F.col("source_key"), "_under", "_under_first", "_drawn"), "_under_first", "_under")
    extra = one.where("_k >= _count").select("shard", "slot", permuted(F.col("_over_first") + F.col("_k") - F.col("_count"), F.lit(max(moved, 1)), F.lit("moved"), seed + 10).alias("_e"))
    extra = extra.withColumn("_cell", F.expr(f"_e div {width}")).join(owners, "_cell").where("_e >= _under_first AND _e < _under_first + _under")
    one = kept.unionByName(extra.select("source_key", "shard", "slot", (F.col("_drawn") + F.col("_e") - F.col("_under_first")).alias("_k")))

    one = one.join(t.select("source_key", "source_size", "_blocks", "_passes", "_left"), "source_key")
    one = one.withColumn("_pass", F.expr("_k div _blocks")).withColumn("_j", F.expr("_k % _blocks"))
    full = F.expr(f"source_size div {block_words}")
    short = F.col("_j") >= full
    block = F.when(short, F.col("_j")).otherwise(permuted(F.col("_j"), F.greatest(full, F.lit(1)), F.concat_ws("/", "source_key", F.col("_pass").cast("string")), seed + 2))
    words = F.when(short, F.col("source_size") - F.col("_j") * n).otherwise(n.cast("long"))
    words = F.when(F.col("_pass") < F.col("_passes"), words).otherwise(F.least(words, F.col("_left") - F.col("_j") * n))
    return materialize(one.select("shard", "slot", "source_key", block.alias("block"), words.alias("words")), "slots")


def taken_words(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs``.

    A document without words takes none. Each source takes its target rounded
    to whole words; no document is taken more than ``most`` times over. Texts of any
    length are read whole and lie in as many blocks as they need; rows that repeat are each a
    document; null sources are one source, null doc_ids stay null; other columns are not
    read, whatever their names; an empty table gives an empty one.
    """
    placed, slots, pieces = mix_plan(docs, weights, most, block_words, seed)
    got = slots.join(pieces, ["source_key", "block"]).withColumn("_got", F.greatest(F.least(F.col("n"), F.col("words") - F.col("at")), F.lit(0)))
    got = got.groupBy("source_key", "start").agg(F.sum("_got").alias("taken"))
    return placed.join(got, ["source_key", "start"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS, seed: int = 1) -> DataFrame:
    """``docs`` as the mix takes them: each document with words taken, its text made of the taken spans in output order.

    Columns are those of ``docs``; n_chars, where it is there, is counted anew.
    Spans keep their own white space; a space parts two spans.
    """
    placed, slots, pieces = mix_plan(docs, weights, most, block_words, seed)
    got = slots.join(pieces, ["source_key", "block"]).withColumn("_n", F.least(F.col("n"), F.col("words") - F.col("at"))).where("_n > 0")
    spans = got.groupBy("source_key", "start").agg(F.sort_array(F.collect_list(F.struct("shard", "slot", "skip", F.col("_n").alias("n")))).alias("spans"))
    # Rows that share id, source and size are told apart by their turn: one shuffle of the texts, by that key, for the join and the turn.
    name, spans_of, turn = fresh(docs.columns, "_name", "_spans", "_turn")
    named = lambda size: F.concat_ws("/", F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("n")), size.cast("string"), _source_key())
    of = Window.partitionBy("doc_id", "source_key", "size").orderBy("start")
    keys = placed.where("size > 0").withColumn("_t", F.row_number().over(of)).join(spans, ["source_key", "start"], "left")
    key = F.concat_ws("/", F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("n")), F.col("size").cast("string"), "source_key")
    keys = keys.groupBy(key.alias(name)).agg(F.transform(F.sort_array(F.collect_list(F.struct("_t", "spans"))), lambda x: x["spans"]).alias(spans_of))
    out = docs.withColumn(name, named(F.coalesce(F.regexp_count("text", F.lit(NOT_SPACE)), F.lit(0)))).join(keys, name)
    out = out.withColumn(turn, F.row_number().over(Window.partitionBy(name).orderBy("text")))
    out = out.withColumn(spans_of, F.get(spans_of, F.col(turn) - 1)).where(F.col(spans_of).isNotNull())
    words = F.regexp_extract_all("text", F.lit(NOT_SPACE + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = let(words, lambda w: F.array_join(F.transform(F.col(spans_of), lambda s: F.array_join(F.slice(w, (s["skip"] + 1).cast("int"), s["n"].cast("int")), "")), " "))
    out = out.withColumn("text", cut)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
