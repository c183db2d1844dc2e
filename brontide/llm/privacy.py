"""Personal data and the terms that give it away, in DataFrame operations only.

Patterns find the base spans. Then corpus co-occurrence tells how much a term
discloses. All counts are of documents: with n in all, n_t that hold term t, n_e
that hold a protected entity e (one value of one kind) and n_te in which t stands
near e, PMI(t; e) = log2(n_te n / (n_t n_e)) is at most the entity's information
content IC(e) = log2(n / n_e). A term whose PMI reaches the share REMOVE of IC(e) for
some e is removed, from GENERALISE on it is generalised, wherever it stands. A pair
counts only if it stands in SUPPORT distinct contexts, so copies disclose nothing
by themselves.

Terms and entities are 64-bit hashes. Documents are counted where they are read and
only sums are shuffled, at most the vocabulary of each task. A bitmap of bounded
size tells inside the scan which words can be disclosing terms; an exact join drops
the others that it lets pass.
Texts of any length: places are running sums in blocks and contexts are cut from
pages of the text, so work grows with the length and not with its square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import NOT_SPACE, fresh, let, materialize

KINDS = ("email", "ip", "card", "phone")
#: Characters on either side of an entity whose whole words are its context.
CONTEXT = 80
#: Distinct contexts in which a term must stand with an entity.
SUPPORT = 3
GENERALISE, REMOVE = 0.5, 0.8
#: Bits for each term, and the smallest and the largest bitmap: half a MB and 8 MB.
TERM_BITS, LEAST_BITS, MOST_BITS = 256, 1 << 22, 1 << 26
#: Characters of a page; a context reaches over two at most.
PAGE = 1024
#: Running sums copy at most so many values for each.
RUN = 64

# Each pattern, with possessive repeats where what follows cannot match inside the
# repeat, and starts only where an earlier start could not have been tried; they
# find the same spans without backtracking, deep recursion or repeated scans.
_LOCAL = "[A-Za-z0-9._%+-]"
_PATTERN = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for the pattern to be tried.
_HINT = {"email": r"[A-Za-z0-9._%+-]@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_SPAN = "array<struct<kind:int,start:int,end:int>>"
_FOUND = "array<struct<kind:int,start:int,end:int,value:string>>"


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total, i):
        d = F.substring(back, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def running(values: Column, add: Callable[[Column, Column], Column], levels: int = 2) -> Column:
    """Running results of ``add`` over an array of int, from the first value to each; RUN values at a time, then over the results of the runs."""

    def simple(xs: Column) -> Column:
        def step(acc, x):
            return let(F.coalesce(add(acc["at"], x), x), lambda t: F.struct(t.alias("at"), F.concat(acc["got"], F.array(t)).alias("got")))

        start = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("got"))
        return F.aggregate(xs, start, step, lambda acc: acc["got"])

    if not levels:
        return simple(values)

    def joined(runs: Column, before: Column) -> Column:
        return F.flatten(F.transform(runs, lambda r, i: F.when(i == 0, r).otherwise(F.transform(r, lambda v: add(F.get(before, i - 1), v)))))

    def whole(xs: Column) -> Column:
        numbers = F.sequence(F.lit(0), ((F.greatest(F.size(xs), F.lit(1)) - 1) / RUN).cast("int"))
        runs = F.transform(numbers, lambda i: simple(F.slice(xs, i * RUN + 1, F.lit(RUN))))
        return let(runs, lambda r: let(running(F.transform(r, lambda x: F.try_element_at(x, F.lit(-1))), add, levels - 1), lambda t: joined(r, t)))

    return let(values, whole)


def _ends(values: Column, gaps: Column) -> Column:
    """Where each value ends, from the values and the pieces of text before each (and one after the last)."""
    lengths = F.zip_with(values, F.slice(gaps, F.lit(1), F.size(values)), lambda v, g: F.length(v) + F.length(g))
    return running(lengths, lambda a, b: a + b)


def _found(text: Column, kind: str) -> Column:
    """Spans of one kind: the text's pieces between matches and the matches give the places."""
    pattern, code, none = F.lit(_PATTERN[kind]), KINDS.index(kind), F.array().cast(_FOUND)

    def placed(values: Column) -> Column:
        spans = F.zip_with(values, _ends(values, F.split(text, pattern, -1)), lambda v, e: F.struct(F.lit(code).alias("kind"), (e - F.length(v)).alias("start"), e.alias("end"), v.alias("value")))
        return F.filter(spans, lambda s: _valid(kind, s["value"]))

    found = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda v: F.when(F.exists(v, lambda x: _valid(kind, x)), placed(v)).otherwise(none))
    return F.when(text.rlike(_HINT[kind]), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value): leftmost non-overlapping matches of each kind that pass its test, kinds in order."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(*[_found(text, k) for k in KINDS])


def _keys() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("_k1"), F.xxhash64(F.lit(31), text).alias("_k2")]


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _pages(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PAGE}}}"), F.lit(0))


def _contexts(text: Column, spans: Column) -> Column:
    """For each span its entity and the hashes of the whole words with a letter within CONTEXT characters on either side."""

    def cut(pages: Column, start: Column, n: Column) -> Column:
        page = (start / PAGE).cast("int")
        both = F.concat(F.coalesce(F.get(pages, page), F.lit("")), F.coalesce(F.get(pages, page + 1), F.lit("")))
        return F.substring(both, start - page * PAGE + 1, n)

    def around(pages: Column, s: Column) -> Column:
        # One character more on each side tells whether the word at the edge is whole; at the ends of the text it is.
        left = cut(pages, F.greatest(s["start"] - CONTEXT - 1, F.lit(0)), F.least(s["start"], F.lit(CONTEXT + 1)))
        left = F.when(s["start"] > CONTEXT, F.regexp_replace(left, r"^" + NOT_SPACE, "")).otherwise(left)
        right = cut(pages, s["end"], F.lit(CONTEXT + 1))
        right = F.when(F.length(right) > CONTEXT, F.regexp_replace(right, NOT_SPACE + r"\z", "")).otherwise(right)
        words = F.filter(F.regexp_extract_all(F.concat_ws(" ", left, right), F.lit(NOT_SPACE), F.lit(0)), lambda w: w.rlike(r"\p{L}"))
        return F.struct(F.xxhash64(s["kind"], s["value"]).alias("entity"), F.array_sort(F.transform(words, _term)).alias("words"))

    return let(_pages(text), lambda pages: F.transform(spans, lambda s: around(pages, s)))


class TermBits:
    """A bitmap of terms of a size bounded by MOST_BITS; every term is in it, other words now and then."""

    def __init__(self, terms: DataFrame):
        n, bits = terms.count(), LEAST_BITS
        while bits < min(TERM_BITS * n, MOST_BITS):
            bits *= 2
        self.bits = bits
        place = self._place(F.col("term"))
        words = terms.withColumn("_p", place).select(F.shiftright("_p", 6).alias("_at"), F.expr("shiftleft(1L, cast(_p & 63 as int))").alias("_w"))
        words = words.groupBy("_at").agg(F.bit_or("_w").alias("_w"))
        dense = terms.sparkSession.range(bits // 64).withColumnRenamed("id", "_at").join(words, "_at", "left")
        self.table = materialize(dense.agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("_w", F.lit(0)).alias("_w")))), lambda x: x["_w"]).alias("_bits")), "bits")

    def _place(self, term: Column) -> Column:
        return term.bitwiseAND(F.lit(self.bits - 1))

    def beside(self, df: DataFrame) -> DataFrame:
        """``df`` with the bitmap in column _bits."""
        return df.withColumn("_bits", self.table.scalar())

    def may_hold(self, term: Column) -> Column:
        place = self._place(term)
        return F.bit_get(F.get(F.col("_bits"), F.shiftright(place, 6).cast("int")), place.bitwiseAND(F.lit(63)).cast("int")) == 1


def term_shares(pairs: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(term, share) of ``pairs`` (term, _ne, _nte) and ``terms`` (term, _nt): the largest PMI(t; e) / IC(e) of each term; an entity of all documents has no content."""
    content = F.log2(F.lit(float(n)) / F.col("_ne"))
    pmi = F.log2(F.col("_nte") * F.lit(float(n)) / (F.col("_nt").cast("double") * F.col("_ne")))
    return pairs.join(terms, "term").groupBy("term").agg(F.max(F.when(content > 0, pmi / content).otherwise(0.0)).alias("share"))


def disclosing_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """(term, share): the largest share PMI(t; e) / IC(e) of each term, where it reaches ``generalise``.

    ``found`` holds the _context array of each row of ``docs``. Documents are
    counted for every term of the corpus: in a large corpus most terms stand near
    some entity, so a filter before the count would let them all pass.
    """
    n = max(found.count(), 1)
    near = found.where("_context IS NOT NULL").select("_context")

    def rows(values: Column, name: str, count: str) -> DataFrame:
        """In how many rows each of ``values`` is."""
        return near.select(F.explode(F.array_distinct(values)).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias(count))

    contexts = near.select(F.explode("_context").alias("_c")).select("_c.*")
    contexts = contexts.select("entity", F.xxhash64("words").alias("_h"), "words").dropDuplicates(["entity", "_h"])
    several = contexts.groupBy("entity").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= support).select("entity")
    held = contexts.join(several, "entity").select("entity", F.explode(F.array_distinct("words")).alias("term"))
    held = held.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= support)
    held = held.select("entity", "term", F.xxhash64("entity", "term").alias("_pair"))
    entities = rows(F.transform("_context", lambda c: c["entity"]), "entity", "_ne")
    together = rows(F.flatten(F.transform("_context", lambda c: F.transform(c["words"], lambda w: F.xxhash64(c["entity"], w)))), "_pair", "_nte")
    pairs = materialize(held.join(together, "_pair").join(entities, "entity").groupBy("term", "_ne").agg(F.max("_nte").alias("_nte")), "pairs")
    words = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(NOT_SPACE), F.lit(0)), _term))
    seen = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_nt"))
    return term_shares(pairs, seen, n).where(F.col("share") >= generalise)


def _term_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_k1, _k2, _more): for each distinct text that holds some of ``terms``, their spans; kind 4 is removed, 5 generalised."""
    bits = TermBits(terms)
    text = F.col("text")

    def placed(words: Column, hashes: Column) -> Column:
        ends = _ends(words, F.split(text, NOT_SPACE, -1))
        spans = F.transform(ends, lambda e, i: F.struct(F.get(hashes, i).alias("term"), (e - F.length(F.get(words, i))).alias("start"), e.alias("end")))
        return F.filter(spans, lambda s: bits.may_hold(s["term"]))

    hits = let(F.regexp_extract_all(text, F.lit(NOT_SPACE), F.lit(0)), lambda w: let(F.transform(w, _term), lambda h: F.when(F.exists(h, bits.may_hold), placed(w, h))))
    one = bits.beside(docs.select(*_keys(), "text")).select("_k1", "_k2", F.explode(hits).alias("_x")).select("_k1", "_k2", "_x.*").join(terms, "term")
    kind = F.when(F.col("share") >= REMOVE, 4).otherwise(5)
    return one.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set(F.struct(kind.alias("kind"), "start", "end"))).cast(_SPAN).alias("_more"))


_NAMES = (*KINDS, "removed", "generalised")


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in _NAMES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_spans(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, _k1, _k2, _base, _all (arrays of spans) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    found = docs.select("doc_id", "text", *_keys(), base_spans(text).alias("_found"))
    places = F.transform("_found", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    found = found.select("doc_id", "_k1", "_k2", places.alias("_base"), F.when(F.size("_found") > 0, _contexts(text, F.col("_found"))).alias("_context"))
    found = materialize(found, "spans")
    terms = materialize(disclosing_terms(docs, found, support, generalise), "disclosing")
    out = found.select("doc_id", "_k1", "_k2", "_base").join(_term_spans(docs, terms), ["_k1", "_k2"], "left")
    return out.select("doc_id", "_k1", "_k2", "_base", F.concat("_base", F.coalesce("_more", F.array().cast(_SPAN))).alias("_all"))


def _count(kind: int) -> Column:
    return F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row of ``docs``.

    Spans are kind:start:end in code points, end exclusive, by kind and then
    start; spans adds the removed and generalised terms to the base ones. Null
    text counts as empty: no spans. Rows that repeat get equal results, a null
    doc_id stays null, an empty table gives an empty one, other columns are not
    read, and texts of any length are read whole.
    """
    found = personal_spans(docs, support, generalise)
    counts = [_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("_all")).alias("spans"))


def sanitised(docs: DataFrame, support: int = SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets, generalised terms by [TERM] and removed terms gone.

    Spans that overlap are one region, replaced by the mark of the one that starts
    first, of those the longest. A null text stays null; an empty table gives an empty one.
    """
    k1, k2, spans = fresh(docs.columns, "_a1", "_a2", "_spans")
    found = personal_spans(docs, support, generalise).where(F.size("_all") > 0).dropDuplicates(["_k1", "_k2"])
    # Regions: spans by start, a new one wherever a span starts at or after the largest end so far.
    ordered = F.array_sort(F.transform("_all", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("_longest"), s["kind"].alias("kind"), s["end"].alias("end"))))
    found = found.select(F.col("_k1").alias(k1), F.col("_k2").alias(k2), ordered.alias("_o"))
    found = found.withColumn("_e", running(F.transform("_o", lambda s: s["end"]), lambda a, b: F.greatest(a, b)))
    before = lambda i: F.when(i > 0, F.get("_e", i - 1)).otherwise(0)
    marks = F.array(*[F.lit(x) for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "", "[TERM]")])
    first = F.filter(F.transform("_o", lambda s, i: F.struct(s["start"].alias("start"), before(i).alias("before"), F.element_at(marks, s["kind"] + 1).alias("mark"))), lambda x: x["start"] >= x["before"])
    found = found.withColumn("_r", first).withColumn("_last", F.element_at("_e", -1))
    ends = F.concat(F.slice(F.transform("_r", lambda x: x["before"]), 2, F.greatest(F.size("_r") - 1, F.lit(0))), F.array("_last"))
    found = found.select(k1, k2, F.zip_with("_r", ends, lambda r, e: F.struct(r["start"].alias("start"), e.alias("end"), r["mark"].alias("mark"))).alias(spans))
    one, two = _keys()
    text = F.col("text")

    def page(here: Column, number: Column) -> Column:
        """A page without its regions; a mark stands on the page on which its region starts."""
        low, high = number * PAGE, number * PAGE + F.length(here)

        def cut(mine: Column) -> Column:
            def piece(r, i):
                at = F.when(i > 0, F.greatest(F.get(mine, i - 1)["end"], low)).otherwise(low)
                kept = F.substring(here, at - low + 1, F.greatest(r["start"] - at, F.lit(0)))
                return F.concat(kept, F.when(r["start"] >= low, r["mark"]).otherwise(""))

            last = F.greatest(F.element_at(mine, -1)["end"], low)
            return F.concat(F.array_join(F.transform(mine, piece), ""), F.substring(here, last - low + 1, F.greatest(high - last, F.lit(0))))

        return let(F.filter(spans, lambda r: (r["start"] < high) & (r["end"] > low)), lambda mine: F.when(F.size(mine) > 0, cut(mine)).otherwise(here))

    done = F.array_join(F.transform(_pages(text), page), "")
    named = docs.withColumns({"_x" + k1: one, "_x" + k2: two})
    out = named.join(found, (F.col("_x" + k1) == F.col(k1)) & (F.col("_x" + k2) == F.col(k2)), "left")
    return out.withColumn("text", F.when(F.col(spans).isNull(), text).otherwise(done)).select(*docs.columns)
