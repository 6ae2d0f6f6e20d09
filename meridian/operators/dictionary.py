"""Dictionaries of texts: ids in order of first sight, and the heap they are stored in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered, running_total


def encode(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """(id, text) of all values: "" is 0, others count up in order of first sight (by
    ``order``, then by column)."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.coalesce(F.col(c), F.lit("")).alias("text")) for k, c in enumerate(columns)])).alias("c")
    seen = rows.select(order, cells).where("c.text <> ''").groupBy("c.text").agg(F.min(F.struct(order, F.col("c.k"))).alias("first"))
    others = numbered(seen, ["first"], "id").select((F.col("id") + 1).alias("id"), "text")
    zero = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.lit("").alias("text"))
    return zero.unionByName(others)


def heap(dictionary: DataFrame) -> DataFrame:
    """(id, text, offset): where each text starts if all are stored one after the other,
    each closed by a zero byte."""
    return running_total(dictionary, ["id"], F.octet_length("text") + 1, "offset").select("id", "text", "offset")


def translate(rows: DataFrame, dictionary: DataFrame, column: str, to: str) -> DataFrame:
    """The rows with the id of a column's text."""
    named = dictionary.select(F.col("text").alias("__text"), F.col("id").alias(to))
    return rows.join(named, F.coalesce(F.col(column), F.lit("")) == F.col("__text"), "left").drop("__text")


def localization(tagged: DataFrame, locale: str, key: str = "id") -> DataFrame:
    """(name, localized) of rows whose name:<locale> differs from their name.

    Of several the one with the largest id counts."""
    name, local = (F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit("")) for k in ("name", f"name:{locale}"))
    rows = tagged.select(F.col(key).alias("id"), name.alias("name"), local.alias("localized")).where("name <> '' and localized <> '' and name <> localized")
    return rows.groupBy("name").agg(F.max_by("localized", "id").alias("localized"))
