"""Keeping one row of several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[Column | str], order: list[Column]) -> DataFrame:
    """The first row of each key by the order; the window drops others before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_n") == 1).drop("_n")


def keep_newest(df: DataFrame, key: Column | str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key; rows without a time come last."""
    return keep_first(df, [key], [F.col(ts).desc_nulls_last(), F.col(tie).asc()])


def keep_richest(df: DataFrame, key: Column | str, quality: Column, seq: str, later: bool = True) -> DataFrame:
    """The row of highest quality of each key; ties go to the later (or earlier) row by ``seq``."""
    return keep_first(df, [key], [quality.desc(), F.col(seq).desc() if later else F.col(seq).asc()])


def duplicate_pointers(df: DataFrame, identity: Column | str, order: list[Column], name: str) -> DataFrame:
    """df with ``duplicate_of``: for every row but the first of an identity, the first one's ``name``."""
    w = Window.partitionBy(identity).orderBy(*order)
    return df.withColumn("duplicate_of", F.when(F.row_number().over(w) > 1, F.first(name).over(w)))


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest order columns, by one aggregate."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(df.columns)
