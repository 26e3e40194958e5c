"""Search of many texts in many names by an index of their letters in groups of three."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Letters of a gram; terms that are shorter are grams of their own.
GRAM = 3


def _grams(key: Column, size: int) -> Column:
    """The different runs of `size` letters of a key."""
    n = F.length(key) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(key, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def name_index(names: DataFrame) -> DataFrame:
    """(gram, id, key) of names (id, key): a row for each different run of one, two and three letters of a key. Null keys have none."""
    grams = F.flatten(F.array(*(_grams(F.col("key"), size) for size in range(1, GRAM + 1))))
    return names.where("key is not null").select(F.explode(grams).alias("gram"), "id", "key")


def search_names(index: DataFrame, terms: DataFrame, first: int = 8) -> DataFrame:
    """term, nth, id, key: the first names, by key and id, that contain each term. Empty and null terms find nothing; repeated terms count as one.

    Each term asks for the rarest of its grams only, so it meets the fewest names that can contain
    it; these are compared in whole. A term with a gram that no name has is done at once.
    """
    asked = terms.where("term is not null and term != ''").select("term").distinct()
    size = F.length("term")
    own = asked.select("term", F.explode(F.when(size >= GRAM, _grams(F.col("term"), GRAM)).otherwise(F.array("term"))).alias("gram"))
    often = index.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(often, "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).where("best.n > 0").select("term", F.col("best.gram").alias("gram"))
    hits = rarest.join(index, "gram").where(F.contains("key", "term"))
    nth = F.row_number().over(Window.partitionBy("term").orderBy("key", "id"))  # limited before the shuffle
    return hits.select("term", nth.alias("nth"), "id", "key").where(F.col("nth") <= first)
