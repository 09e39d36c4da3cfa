"""Order MinHash fingerprints of whole texts, in Spark expressions only.

A text's k-mers are its runs of ``K`` words (white space apart; a shorter text is one k-mer), each with its
occurrence number, so that repeats count one by one. Each of ``SIZE`` orders of all of them takes its ``TUPLE``
smallest k-mers, puts them back into text order, and hashes them as one tuple. Two fingerprints are alike in the
share of equal tuples: moved or changed text loses tuples even where the set of k-mers stays.

An order's values are spread evenly, so a bound under which ``NEAR`` times ``TUPLE`` of them are expected holds the
smallest ones nearly always; only those are sorted. Where it holds too few, all are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annoframe.llm import runtime

K = 3
SIZE = 32
TUPLE = 2
#: Values of an order expected below its bound, for each k-mer of a tuple.
NEAR = 5
#: Bits of an order's value that carry the k-mer's place.
_PLACE = 24


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and in whichever loop it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _kmers(text: Column, k: int) -> Column:
    words = F.transform(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"\s+"), lambda w: F.xxhash64(w))

    def joined(h: Column) -> Column:
        run = F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(F.size(h) >= k, run).otherwise(F.array(F.xxhash64(h)))

    return _let(words, joined)


def _numbered(kmers: Column) -> Column:
    """The hash of each k-mer with its occurrence number, in text order."""

    def with_numbers(b: Column) -> Column:
        pairs = F.sort_array(F.transform(b, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

        def of(p: Column) -> Column:
            n = F.size(p)
            firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda r: (r == 0) | (F.get(p, r)["x"] != F.get(p, r - 1)["x"]))
            number = lambda fs: F.flatten(F.transform(fs, lambda f, q: F.sequence(F.lit(0), F.coalesce(F.get(fs, q + 1), n) - f - 1)))
            hashed = lambda o: F.transform(p, lambda e, r: F.struct(e["i"].alias("i"), F.xxhash64(e["x"], F.get(o, r).cast("long")).alias("h")))
            return F.sort_array(_let(_let(firsts, number), hashed))["h"]

        return _let(pairs, of)

    once = lambda b: F.transform(b, lambda x: F.xxhash64(x, F.lit(0).cast("long")))
    return _let(kmers, lambda b: F.when(F.size(F.array_distinct(b)) == F.size(b), once(b)).otherwise(with_numbers(b)))


def signature(text: Column, *, k: int = K, base: int | None = None, size: int = SIZE, width: int = TUPLE) -> Column:
    """``array<bigint>`` of ``size`` tuple hashes; a null text is empty.

    With a ``base``, only the k-mers whose hash is among that many smallest different ones of the text count.
    """

    def based(kmers: Column) -> Column:
        top = F.get(F.reverse(F.slice(F.sort_array(F.array_distinct(kmers)), 1, base)), F.lit(0))
        return _let(top, lambda t: F.filter(kmers, lambda x: x <= t))

    kmers = _kmers(F.coalesce(text, F.lit("")), k)
    near = NEAR * width

    def tuples(e: Column, bound: Column) -> Column:
        def of(j: Column, some: Column) -> Column:
            order = F.transform(some, lambda x, i: F.shiftleft(F.shiftright(F.xxhash64(x, j), _PLACE), _PLACE) + i)
            place = F.transform(F.slice(F.sort_array(order), 1, width), lambda v: v.bitwiseAND(F.lit((1 << _PLACE) - 1)).cast("int"))
            return F.xxhash64(F.transform(F.sort_array(place), lambda i: F.get(some, i)))

        def one(j: Column) -> Column:
            # The bound has no place bits, so no k-mer at or above it can come before one below.
            below = _let(F.filter(e, lambda x: F.xxhash64(x, j) < bound), lambda s: F.when(F.size(s) >= width, s).otherwise(e))
            return _let(F.when(F.size(e) > 2 * near, below).otherwise(e), lambda s: of(j, s))

        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), one)

    def bounded(e: Column) -> Column:
        bound = F.floor(F.lit(-(2.0**63)) + F.lit(2.0**64) * near / F.greatest(F.size(e), F.lit(2 * near)))
        return _let(F.shiftleft(F.shiftright(bound.cast("long"), _PLACE), _PLACE), lambda b: tuples(e, b))

    return _let(_numbered(kmers if base is None else _let(kmers, based)), bounded)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal tuples, 0 to 1."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def next_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id) for each different id: the next larger one; after the largest comes the smallest."""
    ids = docs.select("doc_id").distinct()
    ids = runtime.table(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()))
    later = ids.withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id")))
    # One row for each range: a range's last id is followed by the next range's first.
    heads = ids.groupBy("part").agg(F.min("doc_id").alias("head"))
    order = Window.orderBy("part")
    heads = heads.select("part", F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).alias("after"))
    return later.join(heads, "part").select("doc_id", F.coalesce("next_id", "after").alias("next_id"))


def half_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_id, edited): the last half of each text replaced by the beginning of the next document's."""
    following = runtime.table(next_ids(docs))
    wanted = docs.select("doc_id", F.char_length("text").alias("n")).groupBy("doc_id").agg(F.floor(F.max("n") / 2).cast("int").alias("half"), F.count("*").alias("rows"))
    wanted = runtime.table(wanted.join(following, "doc_id"))
    repeated = not wanted.filter("`rows` > 1").isEmpty()
    asked = wanted.select(F.col("doc_id").alias("asker"), "half", F.col("next_id").alias("doc_id"))
    heads = docs.join(asked, "doc_id").select("asker", F.expr("left(text, half)").alias("head"))
    if repeated:
        heads = heads.groupBy("asker").agg(F.min("head").alias("head"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("head", F.lit(1), half))
    joined = docs.join(heads.withColumnRenamed("asker", "doc_id"), "doc_id").withColumn("edited", edited)
    return joined.join(wanted.select("doc_id", "next_id"), "doc_id").select("doc_id", "text", "next_id", "edited")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), one row for each row.

    A null text is empty, and an empty text has the fingerprint of an empty word. Rows that repeat an id
    have the same next document, that of the next larger id; if that id is repeated, the smallest of
    its texts' beginnings and of its fingerprints count. A row without id has no next document: its edited
    text is its first half, and ``near_next`` is null. Only the two named columns are read.
    """
    rows = runtime.texts(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    known = half_edited(rows.filter("doc_id is not null"))
    first = F.expr("left(text, char_length(text) - cast(floor(char_length(text) / 2) as int))")
    lone = rows.filter("doc_id is null").select("doc_id", "text", F.lit(None).cast("long").alias("next_id"), first.alias("edited"))
    made = known.union(lone).select(
        "doc_id",
        "next_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        signature(F.col("text")).alias("sig"),
        signature(F.col("edited")).alias("edited_sig"),
    )
    made = runtime.table(made)
    following = made.filter("doc_id is not null").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("sig").alias("next_sig"))
    return made.join(following, "next_id", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sig")).alias("fingerprint"),
        as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        F.when(F.col("next_sig").isNotNull(), likeness(F.col("sig"), F.col("next_sig"))).alias("near_next"),
    )
