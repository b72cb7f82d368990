"""Vector and matrix algebra on columns: arrays as vectors, (i, j, val) tables as matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def times(a: Column, k: Column | float) -> Column:
    return F.transform(a, lambda x: x * k)


def axpy(k: Column | float, a: Column, b: Column) -> Column:
    """k a + b"""
    return F.zip_with(a, b, lambda x, y: x * k + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def max_abs(a: Column) -> Column:
    return F.array_max(F.transform(a, F.abs))


def min_abs(a: Column) -> Column:
    return F.array_min(F.transform(a, F.abs))


def argmax_abs(a: Column) -> Column:
    """First place, from 0, of the entry that is largest by magnitude."""
    size = F.transform(a, F.abs)
    return (F.array_position(size, F.array_max(size)) - 1).cast("long")


def sub_vector(a: Column, index: Column) -> Column:
    return F.transform(index, lambda i: F.get(a, i.cast("int")))


def gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two ``(i, j, val)`` tables: one shuffle by the middle index, one by the result."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("val").alias("_v"))
    return a.join(right, F.col("j") == F.col("_k")).groupBy("i", F.col("_j").alias("j")).agg(F.sum(F.col("val") * F.col("_v")).alias("val"))


def gemv(a: DataFrame, x: DataFrame) -> DataFrame:
    """``(i, val)`` of a times ``x(pos, val)``."""
    v = x.select(F.col("pos").alias("_p"), F.col("val").alias("_v"))
    return a.join(v, F.col("j") == F.col("_p")).groupBy("i").agg(F.sum(F.col("val") * F.col("_v")).alias("val"))


def from_half(a: DataFrame, hermitian: bool = False) -> DataFrame:
    """The whole of a symmetric ``(i, j, val)`` matrix of which one triangle is stored; hermitian ones have ``(i, j, val, imag)``."""
    if not hermitian:
        return a.select("i", "j", "val").unionByName(a.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "val"))
    return a.select("i", "j", "val", "imag").unionByName(a.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "val", (-F.col("imag")).alias("imag")))


def symv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x of which one triangle is stored."""
    return gemv(from_half(a), x)


def symm(a: DataFrame, b: DataFrame, side: str = "L") -> DataFrame:
    """A B, or B A with side R, for a symmetric A of which one triangle is stored."""
    return gemm(from_half(a), b) if side == "L" else gemm(b, from_half(a))


def complex_gemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of two ``(i, j, val, imag)`` tables."""
    right = b.select(F.col("i").alias("_k"), F.col("j").alias("_j"), F.col("val").alias("_v"), F.col("imag").alias("_w"))
    both = a.join(right, F.col("j") == F.col("_k"))
    real, imag = F.col("val") * F.col("_v") - F.col("imag") * F.col("_w"), F.col("val") * F.col("_w") + F.col("imag") * F.col("_v")
    return both.groupBy("i", F.col("_j").alias("j")).agg(F.sum(real).alias("val"), F.sum(imag).alias("imag"))


def hemm(a: DataFrame, b: DataFrame) -> DataFrame:
    """A B for a hermitian A of which one triangle is stored; all with real and imaginary parts."""
    return complex_gemm(from_half(a, True), b)


def hemv(a: DataFrame, x: DataFrame) -> DataFrame:
    """A x for a hermitian A of which one triangle is stored, x ``(pos, val, imag)``: ``(i, val, imag)``."""
    return hemm(a, x.select(F.col("pos").alias("i"), F.lit(0).cast("long").alias("j"), "val", "imag")).drop("j")


def combine(a: DataFrame, b: DataFrame, alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """alpha A + beta B of ``(i, j, val)`` tables; entries that one of them lacks are zero there."""
    both = a.select("i", "j", (F.col("val") * alpha).alias("val")).unionByName(b.select("i", "j", (F.col("val") * beta).alias("val")))
    return both.groupBy("i", "j").agg(F.sum("val").alias("val"))


def scaled(a: DataFrame, k: float) -> DataFrame:
    return a.select("i", "j", (F.col("val") * k).alias("val"))


def row(a: DataFrame, i: int) -> DataFrame:
    """``(pos, val)`` of one row."""
    return a.filter(F.col("i") == i).select(F.col("j").alias("pos"), "val")


def column(a: DataFrame, j: int) -> DataFrame:
    return a.filter(F.col("j") == j).select(F.col("i").alias("pos"), "val")


def block(a: DataFrame, rows: tuple[int, int], columns: tuple[int, int]) -> DataFrame:
    """The entries of intervals ``(offset, size)``, counted from their beginning."""
    inside = lambda c, at: (F.col(c) >= at[0]) & (F.col(c) < at[0] + at[1])
    return a.filter(inside("i", rows) & inside("j", columns)).select((F.col("i") - rows[0]).alias("i"), (F.col("j") - columns[0]).alias("j"), "val")


def text_rows(a: DataFrame, separator: str = ",") -> DataFrame:
    """``(i, value)``: each row of a whole matrix as one line of text, as for a CSV file."""
    cells = F.array_sort(F.collect_list(F.struct("j", F.col("val").cast("string").alias("text"))))
    return a.groupBy("i").agg(F.array_join(F.transform(cells, lambda s: s["text"]), separator).alias("value"))


def complex_dot(a: Column, b: Column) -> Column:
    """Scalar product of two arrays of interleaved complex numbers, the first conjugated: ``[real, imaginary]``."""
    at = F.sequence(F.lit(0), F.floor(F.size(a) / 2).cast("int") - 1)
    real = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    imag = F.aggregate(F.transform(at, lambda k: F.get(a, 2 * k) * F.get(b, 2 * k + 1) - F.get(a, 2 * k + 1) * F.get(b, 2 * k)), F.lit(0.0), lambda s, v: s + v)
    return F.array(real, imag)


def conjugate(a: Column) -> Column:
    """Interleaved complex numbers with the other sign of their imaginary parts."""
    return F.transform(a, lambda x, k: F.when(k % 2 == 1, -x).otherwise(x))


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "val")


def frobenius(a: DataFrame) -> DataFrame:
    return a.agg(F.sqrt(F.sum(F.col("val") * F.col("val"))).alias("norm"))


def argmax(a: DataFrame) -> DataFrame:
    """The entry largest by magnitude; of equal ones the first by (i, j)."""
    return a.agg(F.max_by(F.struct("i", "j", "val"), F.struct(F.abs("val"), -F.col("i"), -F.col("j"))).alias("m")).select("m.*")


def pieces(s: Column, separator: str) -> Column:
    """A string cut at each separator, empty pieces left out."""
    return F.filter(F.split(s, r"\Q" + separator + r"\E"), lambda x: x != "")


def padded(k: Column, width: int) -> Column:
    """A number with zeros before it."""
    return F.lpad(k.cast("string"), width, "0")


def base_name(s: Column) -> Column:
    """The last part of a path, without its extension."""
    return F.regexp_extract(s, r"([^/]*?)(?:\.[^./]*)?$", 1)


def number_or_zero(s: Column) -> Column:
    """A string as a number, 0 if it is none."""
    return F.coalesce(s.try_cast("double"), F.lit(0.0))
