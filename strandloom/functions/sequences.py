"""Column functions over letters of sequences."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: the standard genetic code, codons in the order T, C, A, G
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), _AMINO)}
DNA, RNA, PROTEIN = 0, 1, 2


# fixed values: letters and what they pair with
_LETTERS, _PAIRED = "acgtunACGTUN", "tgcaanTGCAAN"


def reverse_complement(seq: Column) -> Column:
    """Case is kept, u pairs with a, and letters that pair with none stay."""
    return F.reverse(F.translate(seq, _LETTERS, _PAIRED))


def substring(seq: Column, start: Column, stop: Column) -> Column:
    """The letters of a signed interval; on the reverse strand, of its complement."""
    forward = F.substring(seq, (start + 1).cast("int"), (stop - start).cast("int"))
    back = F.substring(seq, (-stop + 1).cast("int"), (stop - start).cast("int"))
    return F.when(start >= 0, forward).otherwise(reverse_complement(back))


def _codes() -> np.ndarray:
    """The amino acid of each codon, by six letters a place: T, C, A, G, then N, R, Y in the third, and all others.

    A third N stands for any letter where all four give one amino acid; R and Y for either of
    their two letters where these give one and not all four do.
    """
    out = np.full((8, 8, 8), ord("X"), np.uint8)
    amino = np.frombuffer(_AMINO.encode(), np.uint8).reshape(4, 4, 4)
    out[:4, :4, :4] = amino
    same = (amino == amino[:, :, :1]).all(2)
    out[:4, :4, 4] = np.where(same, amino[:, :, 0], ord("X"))
    for place, (a, b) in ((5, (2, 3)), (6, (0, 1))):
        out[:4, :4, place] = np.where((amino[:, :, a] == amino[:, :, b]) & ~same, amino[:, :, a], ord("X"))
    return out.ravel()


_PLACE = np.full(256, 7, np.uint8)
for _n, _letters in enumerate(("TtUu", "Cc", "Aa", "Gg", "Nn", "Rr", "Yy")):
    _PLACE[np.frombuffer(_letters.encode(), np.uint8)] = _n
_CODES = _codes()


# fixed value: letters translated at once, beyond which one sequence alone may go
_AT_ONCE = 1 << 20


def _proteins(texts: list[str | None]) -> list[str | None]:
    """All sequences at once, each padded to whole codons."""
    coded = [None if s is None else s.encode("utf-32-le") for s in texts]
    sizes = np.array([len(t) // 4 if t else 0 for t in coded])
    codons = -(-sizes // 3)
    letters = np.frombuffer(b"".join(t + b"\0" * (4 * (3 * c - n)) for t, c, n in zip(coded, codons.tolist(), sizes.tolist()) if t), "<u4")
    place = _PLACE[np.minimum(letters, 255)].reshape(-1, 3).astype(np.int16)
    place[letters.reshape(-1, 3) > 255] = 7
    out, ends = _CODES[place[:, 0] * 64 + place[:, 1] * 8 + place[:, 2]].tobytes().decode("ascii"), np.cumsum(codons).tolist()
    return [None if t is None else out[e - c : e] for t, c, e in zip(coded, codons.tolist(), ends)]


@F.pandas_udf(StringType())
def _translated(seqs: pd.Series) -> pd.Series:
    """Some sequences of a batch at a time, so that memory does not grow with what a batch happens to hold."""
    out, some, size = [], [], 0
    for s in seqs:
        if some and size + len(s or "") > _AT_ONCE:
            out += _proteins(some)
            some, size = [], 0
        some.append(s)
        size += len(s or "")
    return pd.Series(out + (_proteins(some) if some else []), dtype=object)


def translate(seq: Column) -> Column:
    """Amino acids of consecutive codons; a codon that is partial or unknown is X, a stop is ``*``.

    A kernel over whole batches: three letters to a codon have no form in built-in functions
    but a lambda for each of them, which is many times slower.
    """
    return _translated(seq)


def translated_slice(seq: Column, start: Column, stop: Column) -> Column:
    """The protein of the signed interval of nucleotides: whole codons of its own frame."""
    return translate(substring(seq, start, start + F.floor((stop - start) / 3) * 3))


def protein_slice(start: Column, stop: Column, low: Column, high: Column) -> Column:
    """Which amino acids of a translated interval a stretch of nucleotides within it covers: (start, stop), rounded inwards down."""
    return F.struct(F.floor((low - start) / 3).alias("start"), F.floor((high - start) / 3).alias("stop"))


def nucleotide_slice(start: Column, low: Column, high: Column) -> Column:
    """The nucleotides of amino acids ``[low:high]`` of an interval that begins at ``start``."""
    return F.struct((start + 3 * low).alias("start"), (start + 3 * high).alias("stop"))


def spliced(seq: Column, starts: Column, stops: Column) -> Column:
    """The letters of exons, one after the other: ``starts`` and ``stops`` are comma lists of forward places; no strand is turned."""
    ends = F.arrays_zip(*[F.filter(F.split(x, ","), lambda v: v != "").alias(a) for x, a in ((starts, "a"), (stops, "b"))])
    return F.array_join(F.transform(ends, lambda e: F.substring(seq, e["a"].cast("int") + 1, e["b"].cast("int") - e["a"].cast("int"))), "")


def letters(seq: Column) -> Column:
    """Structs (pos, letter, next): the sequence as a chain of letters; the last has no next."""
    each = F.filter(F.split(seq, ""), lambda c: c != "")
    pairs = F.zip_with(each, F.slice(each, F.lit(2), F.greatest(F.size(each) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("letter"), b.alias("next")))
    return F.transform(pairs, lambda x, i: F.struct(i.alias("pos"), x["letter"].alias("letter"), x["next"].alias("next")))


def _count(seq: Column, letters: str) -> Column:
    return F.length(seq) - F.length(F.translate(seq, letters, ""))


def guess_type(seq: Column) -> Column:
    """0 DNA, 1 RNA, 2 protein: over 85 % of letters in ATUGCN is nucleic, and DNA has more T than U.  Empty: null."""
    upper = F.upper(seq)
    nucleic = _count(upper, "ATUGCN") / F.nullif(F.length(seq), F.lit(0)) > 0.85
    return F.when(nucleic, F.when(_count(upper, "T") > _count(upper, "U"), DNA).otherwise(RNA)).when(F.length(seq) > 0, PROTEIN)


def soft_masked(seq: Column, spans: Column) -> Column:
    """The letters with repeats in lower case and all others in upper: ``spans`` is an array of structs (start, stop), forward."""
    low = lambda acc, r: F.overlay(acc, F.lower(F.substring(acc, r["start"].cast("int") + 1, (r["stop"] - r["start"]).cast("int"))), r["start"].cast("int") + 1)
    return F.aggregate(F.coalesce(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>")), F.upper(seq), low)


def interval_type(seq: Column, start: Column, stop: Column) -> Column:
    """:func:`guess_type` of an interval: of its first 40 letters."""
    return guess_type(substring(seq, start, F.least(stop, start + 40)))


def identity(a: Column, b: Column) -> Column:
    """How many places of two equally long strings have the same letter, whatever the case."""
    return F.size(F.filter(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: x == y), lambda same: same))


def six_frames(length: Column) -> Column:
    """Structs (frame, start, stop) of the six frames of a sequence that have a codon at least; reverse ones are -1 to -3."""
    ends = lambda f: length - F.pmod(length - f, F.lit(3))
    frames = []
    for f in range(3):
        enough = length >= f + 3
        frames.append(F.when(enough, F.struct(F.lit(f + 1).alias("frame"), F.lit(f).cast("long").alias("start"), ends(f).cast("long").alias("stop"))))
        frames.append(F.when(enough, F.struct(F.lit(-f - 1).alias("frame"), (-ends(f)).cast("long").alias("start"), F.lit(-f).cast("long").alias("stop"))))
    return F.filter(F.array(*frames), lambda x: x.isNotNull())
