"""Point clouds: from table columns, synthetic shapes, mesh files and dense binary matrices."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def from_columns(df: DataFrame, key: str, *coords: Column) -> DataFrame:
    """``points(point_id, coords)`` of a table's expressions."""
    return df.select(F.col(key).cast("long").alias("point_id"), F.array(*[c.cast("double") for c in coords]).alias("coords"))


def normalised(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Columns scaled to [0, 1] by their range; timestamps count in seconds."""
    number = {c: F.col(c).cast("timestamp").cast("double") if dict(df.dtypes)[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c).cast("double") for c in columns}
    ends = df.agg(*[f(number[c]).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    scaled = [(number[c] - ends[f"lo_{c}"]) / ((ends[f"hi_{c}"] - ends[f"lo_{c}"]) or 1.0) for c in columns]
    return from_columns(df, key, *scaled)


def synthetic(spark: SparkSession, shape: str, n: int, dim: int = 3, z: float = 0.0, seed: int = 0) -> DataFrame:
    """``disk``, ``ball`` or ``ellipse`` of n seeded points."""
    ids = spark.range(n)
    a, b, c = (F.rand(seed * 3 + k) for k in range(3))
    if shape == "disk":
        r, phi = F.sqrt(a), b * 2 * np.pi
        xs = [r * F.cos(phi), r * F.sin(phi), F.lit(float(z))][:dim]
    elif shape == "ball":
        r, phi, t = F.pow(a, 1 / 3), b * 2 * np.pi, F.acos(c * 2 - 1)
        xs = [r * F.sin(t) * F.cos(phi), r * F.sin(t) * F.sin(phi), r * F.cos(t) + float(z)]
    elif shape == "ellipse":
        phi, turn = a * 2 * np.pi, np.pi / 6
        p, q = F.cos(phi) * 4, F.sin(phi)
        xs = [p * np.cos(turn) - q * np.sin(turn), p * np.sin(turn) + q * np.cos(turn), F.lit(float(z))][:dim]
    else:
        raise ValueError("shape is disk, ball or ellipse")
    return ids.select(F.col("id").alias("point_id"), F.array(*xs).alias("coords"))


def mesh_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Nodes of a text mesh: lines ``id x y z`` between ``$Nodes`` and ``$EndNodes``, after their count."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", r"(?s)\$Nodes\s+\d+\s+(.*?)\s*\$EndNodes", 1)
    line = raw.select(F.explode(F.split(body, r"\r?\n")).alias("line"))
    part = F.split(F.trim("line"), r"\s+")
    return line.filter(F.size(part) >= 4).select(part[0].cast("long").alias("point_id"), F.transform(F.slice(part, 2, 3), lambda v: v.cast("double")).alias("coords"))


def matrix_from_bytes(data: bytes, dtype: str = "float64") -> np.ndarray:
    """int32 rows, int32 columns, then the values by columns."""
    m, n = struct.unpack("<ii", data[:8])
    return np.frombuffer(data, dtype, m * n, 8).reshape((m, n), order="F")


def matrix_to_bytes(a: np.ndarray) -> bytes:
    return struct.pack("<ii", *a.shape) + np.asarray(a).tobytes(order="F")


def vector_to_bytes(v: np.ndarray) -> bytes:
    return struct.pack("<i", len(v)) + np.asarray(v).tobytes()


def vector_from_bytes(data: bytes, dtype: str = "float64") -> np.ndarray:
    return np.frombuffer(data, dtype, struct.unpack("<i", data[:4])[0], 4)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(path, i, j, val)`` of binary matrices."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            for p, content in zip(frame["path"], frame["content"], strict=True):
                a = matrix_from_bytes(bytes(content))
                i, j = np.indices(a.shape)
                yield pd.DataFrame({"path": p, "i": i.ravel(), "j": j.ravel(), "val": a.ravel()})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, i long, j long, val double")


def random_vector(spark: SparkSession, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """``(pos, val)`` of n numbers, uniform between the bounds."""
    return spark.range(n).select(F.col("id").alias("pos"), (F.rand(seed) * (high - low) + low).alias("val"))


def random_matrix(spark: SparkSession, m: int, n: int, low: float = 0.0, high: float = 1.0, seed: int = 0) -> DataFrame:
    """``(i, j, val)`` of a whole m x n matrix, uniform between the bounds."""
    entries = spark.range(m * n)
    return entries.select(F.floor(F.col("id") / n).alias("i"), (F.col("id") % n).alias("j"), (F.rand(seed) * (high - low) + low).alias("val"))


def vector_text(v: np.ndarray) -> str:
    """A vector as the text ``[a;b;...]`` of numeric tools."""
    return "[" + ";".join(repr(float(x)) for x in v) + "]"
