"""A test of membership before a shuffle: what surely has no partner never travels.

The keys of one side become a Bloom filter of a fixed size, as an array of words that a
distributed aggregate fills. It reaches the rows of the other side as the one value of a
scalar subquery. A row that misses the filter has no partner; only rows that hit it are
shuffled to the exact join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a filter (1 MB), and bits that a key sets.
BITS = 2**23
HASHES = 5


def _places(keys: list[str], bits: int) -> list[Column]:
    columns = [F.col(key) for key in keys]
    return [F.pmod(F.xxhash64(F.lit(n), *columns), F.lit(bits)) for n in range(HASHES)]


def _known(keys: list[str]) -> Column:
    return reduce(Column.__and__, [F.col(key).isNotNull() for key in keys])


def bloom_words(df: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """One row: the filter of all keys without a NULL, as words of 64 bits."""
    places = F.explode(F.array(*_places(list(keys), bits))).alias("place")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    filled = (
        df.where(_known(list(keys)))
        .select(places)
        .groupBy(F.shiftright("place", 6).alias("word"))
        .agg(F.bit_or(one).alias("mask"))
    )
    # Words without a bit are zero; there are bits / 64 in all.
    words = df.sparkSession.range(bits // 64).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    whole = words.unionByName(filled).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    ordered = F.array_sort(F.collect_list(F.struct("word", "mask")))
    return whole.agg(ordered.alias("words")).select(F.col("words.mask").alias("words"))


def with_hit(df: DataFrame, other: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """Add ``hit``: false where no row of ``other`` has the keys; a NULL key never hits.

    With n distinct keys about (1 - exp(-5 n / bits)) ** 5 of the other rows hit by chance.
    """
    if bits % 64:
        raise ValueError("a filter has whole words of 64 bits")
    words = bloom_words(other, *keys, bits=bits).scalar()
    marked = df.withColumn("_words", words)
    each = [
        F.getbit(F.col("_words")[F.shiftright(place, 6).cast("int")], (place % 64).cast("int")) == 1
        for place in _places(list(keys), bits)
    ]
    return marked.withColumn("hit", _known(list(keys)) & reduce(Column.__and__, each)).drop("_words")


def rows_missing_in(child: DataFrame, parent: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """Rows of ``child`` whose key has no row in ``parent``, NULL keys among them.

    Rows that miss the filter are given out where they are read.
    """
    marked = with_hit(child, parent, *keys, bits=bits)
    lost = marked.where(~F.col("hit")).drop("hit")
    exact = marked.where("hit").drop("hit").join(parent.select(*keys).distinct(), list(keys), "left_anti")
    return lost.unionByName(exact.select(*lost.columns))


def rows_found_in(child: DataFrame, parent: DataFrame, *keys: str, bits: int = BITS) -> DataFrame:
    """Rows of ``child`` whose key has a row in ``parent``."""
    hits = with_hit(child, parent, *keys, bits=bits).where("hit").drop("hit")
    return hits.join(parent.select(*keys).distinct(), list(keys), "left_semi").select(*child.columns)
