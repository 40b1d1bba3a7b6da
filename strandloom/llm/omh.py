"""Order MinHash, by DataFrame functions alone.

A text's k-mers are runs of ``k`` words, each numbered by how often it has occurred
before, so that repeats are told apart.  Their hashes stand for a permutation, of which
``bins`` places are taken (one-permutation hashing); from each on, around the end, the next
``tuple_size`` k-mers are selected and put back into the order of the text, and the
sequence is hashed.  So every selection has as many k-mers, however few the text has (a
range with too few goes on into the next, which is densification by rotation).  Two texts
agree in a selection if it is of the same k-mers in the same order, which edits that move
text change as well as edits that replace it.

Within a row, a k-mer is one long: 33 bits of hash above 30 bits of place, which is
more words than a string can hold, so sorting is a sort of primitive longs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PLACE = 30
_MASK = (1 << _PLACE) - 1


def _top(hash_: Column, place: Column) -> Column:
    """33 bits of a hash over a place, never negative, for sorting as a signed long."""
    return F.shiftleft(F.shiftrightunsigned(hash_, 31), _PLACE).bitwiseOR(place.cast("long"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value made once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def signature(text: Column, k: int = 3, bins: int = 32, tuple_size: int = 2) -> Column:
    """The ``bins`` tuple hashes of a whole text, as an array of longs; all null where there is no k-mer.

    Words are parted by ASCII white space.  A text of fewer than ``k`` words has one k-mer,
    all its words; null, empty and blank texts have none.
    """
    if bins < 2 or bins & (bins - 1):
        raise ValueError("bins must be a power of two")
    shift = 33 - (bins - 1).bit_length()

    def kmers(words: Column) -> Column:
        last = F.greatest(F.size(words) - k, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: _top(F.xxhash64(*[F.get(words, i + j) for j in range(k)]), i))

    def numbered(s: Column) -> Column:  # s: sorted, so equal k-mers stand together in text order
        kmer = lambda j: F.shiftrightunsigned(F.get(s, j), _PLACE)
        runs = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (j == 0) | (kmer(j) != kmer(j - 1)))
        lengths = _let(runs, lambda r: F.zip_with(r, F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.array(F.size(s))), lambda a, b: b - a))
        seen = F.flatten(F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1)))
        return F.zip_with(s, seen, lambda x, n: _top(F.xxhash64(F.shiftrightunsigned(x, _PLACE), n), x.bitwiseAND(F.lit(_MASK))))

    def picked(g: Column) -> Column:  # the smallest of each bin: g is sorted and a bin is a range of it
        bin_ = lambda x: F.shiftrightunsigned(x, _PLACE + shift)
        return F.filter(g, lambda x, j: (j < tuple_size) | (bin_(x) != bin_(F.get(g, F.greatest(j - tuple_size, F.lit(0))))))

    def tuples(p: Column) -> Column:
        def one(b: Column) -> Column:
            on = F.filter(p, lambda x: F.shiftrightunsigned(x, _PLACE + shift) >= b)
            mine = F.slice(F.concat(on, p), F.lit(1), F.least(F.size(p), F.lit(tuple_size)))
            ordered = F.sort_array(F.transform(mine, lambda x: F.shiftleft(x.bitwiseAND(F.lit(_MASK)), 33).bitwiseOR(F.shiftrightunsigned(x, _PLACE))))
            return F.xxhash64(F.transform(ordered, lambda x: x.bitwiseAND(F.lit((1 << 33) - 1))))

        return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: one(b.cast("long")))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")
    none = F.array_repeat(F.lit(None).cast("long"), bins)
    made = lambda w: _let(F.sort_array(kmers(w)), lambda s: _let(F.sort_array(numbered(s)), lambda g: _let(picked(g), tuples)))
    return _let(words, lambda w: F.when(F.size(w) > 0, made(w)).otherwise(none))


def as_text(signature_: Column) -> Column:
    """A signature as hexadecimal digits, 16 for each bin and dashes for a null."""
    return F.array_join(F.transform(signature_, lambda h: F.coalesce(F.lower(F.lpad(F.hex(h), 16, "0")), F.lit("-" * 16))), "")


def likeness(a: Column, b: Column) -> Column:
    """The share of selections in which two signatures agree; 1 where neither text has a k-mer."""
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda f: f))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda f: f))
    return F.when(either == 0, 1.0).otherwise(same / either)


def _bucket(key: Column, cuts: list[int], parts: int) -> Column:
    """An order-keeping bucket number: the stretch between two cuts, by a tree of comparisons, then equal parts of it."""

    def stretch(low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], stretch(low, middle)).otherwise(stretch(middle, high))

    n = stretch(0, len(cuts) - 1)
    edge = F.array(*map(F.lit, map(float, cuts)))
    inside = F.floor((key.cast("double") - F.get(edge, n)) / F.greatest(F.get(edge, n + 1) - F.get(edge, n), F.lit(1.0)) * parts)
    return n.cast("long") * parts + F.greatest(F.least(inside, F.lit(parts - 1)), F.lit(0))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 3, bins: int = 32, tuple_size: int = 2, bucket_rows: int = 2000) -> DataFrame:
    """(id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next) for every row.

    The edited text has its last floor(n/2) code points replaced by the first as many of
    the next document by id (after the last: the first; ids that repeat: by text).  Null
    texts are empty, null ids come first, other columns are not read.

    The next row is found within buckets of ids, by a window; the last row of each takes the
    first of the next bucket, which is a row a bucket.  Texts are shuffled once.  Buckets
    have about ``bucket_rows`` rows, however many there are; one grows with the input only
    where a single id (or null) is repeated, or where ids that are no numbers begin with
    the same seven bytes.  An empty table gives no rows.
    """
    number = docs.schema[id_col].dataType.typeName() in ("byte", "short", "integer", "long")
    row = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.col("id").cast("long") if number else F.conv(F.substring(F.hex(F.rpad(F.col("id").cast("string"), 7, "\0")), 1, 14), 16, 10).cast("long")  # in the ids' order
    keyed = row.select(key.alias("key"))
    found = keyed.where("key is not null").agg(F.percentile_approx("key", [i / 256 for i in range(257)], 10_000), F.count("*")).first()
    cuts = sorted(set(found[0] or [0]))
    cuts = cuts if len(cuts) > 1 else [cuts[0], cuts[0] + 1]
    parts = max(1, -(-(found[1] or 0) // (bucket_rows * (len(cuts) - 1))))
    bucket = F.when(F.col("key").isNull(), F.lit(-1).cast("long")).otherwise(_bucket(F.col("key"), cuts, parts))
    own = row.select("id", "text", key.alias("key")).withColumn("bucket", bucket).drop("key").withColumn("signature", signature(F.col("text"), k, bins, tuple_size)).repartition("bucket")  # once, for both uses
    # Each bucket's first row is what follows the last of the bucket before it: of a row for
    # each bucket, the one before is sought among those of its stretch, and of the stretches.
    firsts = own.groupBy("bucket").agg(F.min_by(F.struct("text", "signature"), F.struct("id", "text")).alias("first"))
    named = keyed.select(bucket.alias("bucket")).distinct().withColumn("stretch", F.floor(F.col("bucket") / parts))
    ends = named.groupBy("stretch").agg(F.max("bucket").alias("end"))  # 258 rows at most
    whole = Window.orderBy("stretch")
    ends = ends.select("stretch", F.coalesce(F.lag("end").over(whole), F.max("end").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("end"))
    before = named.join(ends, "stretch").select("bucket", F.coalesce(F.lag("bucket").over(Window.partitionBy("stretch").orderBy("bucket")), "end").alias("to"))
    heads = firsts.join(before, "bucket").select(F.col("to").alias("bucket"), "first")
    line = Window.partitionBy("bucket").orderBy("id", "text")
    both = own.withColumn("own_next", F.lead(F.struct("text", "signature")).over(line)).join(heads, "bucket").withColumn("next", F.coalesce("own_next", "first"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = both.select("id", "signature", n.cast("long").alias("n_chars"), F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half)).alias("edited_text"), F.col("next.signature").alias("after"))
    both = both.withColumn("edited", signature(F.col("edited_text"), k, bins, tuple_size))
    return both.select(F.col("id").alias(id_col), "n_chars", "edited_text", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited")).alias("edited_fingerprint"), likeness(F.col("signature"), F.col("edited")).alias("near_edited"), likeness(F.col("signature"), F.col("after")).alias("near_next"))
