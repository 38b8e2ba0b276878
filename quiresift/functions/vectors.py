"""Hashes and similarities of small vectors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the aligned and the hash score in a page's score, and the distance that counts as none alike. Fixed values.
ALIGNED_WEIGHT, HASH_WEIGHT, HASH_SPAN = 0.75, 0.25, 32
#: An aligned score up to here is none. Fixed value.
LEAST_ALIGNED = 0.05


def item_hash(text: Column) -> Column:
    """60 bits of a text's digest, as a long."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def bits(flags: Column) -> Column:
    """Array of booleans as a long; the first is the lowest bit."""
    return F.aggregate(F.transform(flags, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def middle(values: Column) -> Column:
    """Median of an array: the mean of the two middle ones if their number is even."""
    ordered, n = F.array_sort(values), F.size(values)
    low, high = F.floor((n + 1) / 2).cast("int"), F.floor((n + 2) / 2).cast("int")
    return (F.element_at(ordered, low).cast("double") + F.element_at(ordered, high).cast("double")) / 2


def perceptual_hash(coefficients: Column) -> Column:
    """Bit i: coefficient i + 1 is over the median of all but the first."""
    rest = F.slice(coefficients, 2, F.size(coefficients) - 1)
    return F.element_at(F.transform(F.array(F.struct(rest.alias("v"), middle(rest).alias("m"))), lambda s: bits(F.transform(s["v"], lambda x: x.cast("double") > s["m"]))), 1)


def profile_hash(grid: Column, side: int) -> Column:
    """Bits 0 to side - 1: rows of a square grid over the median of rows; then columns alike."""
    cell = lambda i: F.element_at(grid, i.cast("int") + 1).cast("double")
    along = F.sequence(F.lit(0), F.lit(side - 1))
    total = lambda at: F.aggregate(F.transform(along, at), F.lit(0.0), lambda a, x: a + x)
    rows = F.transform(along, lambda r: total(lambda c: cell(r * side + c)))
    columns = F.transform(along, lambda c: total(lambda r: cell(r * side + c)))

    def over(values: Column) -> Column:
        return F.element_at(F.transform(F.array(F.struct(values.alias("v"), middle(values).alias("m"))), lambda s: F.transform(s["v"], lambda x: x > s["m"])), 1)

    return bits(F.concat(over(rows), over(columns)))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(distance: Column, span: int = HASH_SPAN) -> Column:
    """1 for equal hashes, 0 from ``span`` different bits."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / F.lit(float(span)))


def page_score(aligned: Column, hash_score: Column) -> Column:
    """The score of two pages; 0 if they do not align at all."""
    return F.when(aligned > LEAST_ALIGNED, F.lit(ALIGNED_WEIGHT) * aligned + F.lit(HASH_WEIGHT) * hash_score).otherwise(F.lit(0.0))


def unit(vector: Column) -> Column:
    """``vector`` less its mean, scaled to length 1; all zeros if it is flat."""
    n = F.size(vector)
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
    let = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
    centred = let(F.transform(vector, lambda x: x.cast("double")), lambda v: let(total(v) / n, lambda m: F.transform(v, lambda x: x - m)))
    return let(centred, lambda c: let(F.sqrt(total(F.transform(c, lambda x: x * x))), lambda norm: F.transform(c, lambda x: F.when(norm < 1e-3, F.lit(0.0)).otherwise(x / norm))))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
