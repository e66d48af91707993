"""Sharding: a Feistel permutation with cycle walking over global row numbers.

Main path: DataFrame expressions only.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, cut, partitions

ROUNDS = 6
#: Columns that shard_rows adds.
MADE = ("row_number", "shard", "slot")
#: Steps of the walk. The domain a * b has fewer than a points beyond n: to 256 rows a is 16 at most, so 16 steps always suffice; beyond, a point stays outside for 16 steps with a chance under (1 / 16) ** 16, and number_shards then raises an error.
WALK = 16


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    """df with a gapless global row number from 0 by the columns in order, checkpointed.

    Rows are range-partitioned by sampled splitters. A random column splits rows that are equal in all of order, so a key that holds a third of the rows still spreads; equal rows can be swapped without changing the result. Numbers are the place within a partition plus the rows of the partitions before it, of which there is one figure each. Nulls come first. Carry narrow columns only: df is sorted and written once.
    """
    tie, at = f"__tie_{name}", f"__at_{name}"
    tied = df.withColumn(tie, F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(partitions(df.sparkSession), *order, tie).sortWithinPartitions(*order, tie)
    placed = cut(dealt.drop(tie).withColumn(at, F.monotonically_increasing_id()))
    part, place = F.shiftright(F.col(at), 33), F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()  # one figure for each partition
    before, total = {}, 0
    for r in sorted(counts):
        before[r["part"]], total = total, total + r["n"]
    starts = df.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "__part long, __before long")
    out = placed.join(F.broadcast(starts), part == F.col("__part")).withColumn(name, F.col("__before") + place)
    return out.select(*df.columns, name)


def permuted(x: Column, n: int, seed: int) -> Column:
    """x in 0..n-1 to its place under a keyed permutation of 0..n-1.

    The domain is a x b >= n with a = ceil(sqrt(n)); rounds add a keyed hash of one half to the other half, modulo its size, which is a bijection. Points outside of 0..n-1 walk on.
    """
    a = max(1, isqrt(max(n, 1) - 1) + 1)
    b = max(1, -(-n // a))

    def once(v: Column) -> Column:
        left, right = F.floor(v / F.lit(b)).cast("long"), F.pmod(v, F.lit(b))
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = F.pmod(left + F.pmod(F.xxhash64(right, F.lit(seed), F.lit(k)), F.lit(a)), F.lit(a))
            else:
                right = F.pmod(right + F.pmod(F.xxhash64(left, F.lit(seed), F.lit(k)), F.lit(b)), F.lit(b))
        return left * F.lit(b) + right

    walk = F.aggregate(F.array_repeat(F.lit(0), WALK), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("the cycle walk did not end; take another seed")))


def shard_rows(df: DataFrame, order: list[str], shards: int, seed: int = 7) -> DataFrame:
    """df (narrow columns, see row_numbers) with row_number, shard and slot.

    A row's place p is its row number under permuted(); shard is p mod shards and slot is p div shards. So shard counts differ by one at most, slots are gapless from 0, and anyone who knows the row count, the seed and a row number can compute shard and slot. The result depends on the rows and the seed only, not on how they are partitioned. Null keys are numbered first; repeated rows get a place each; an empty table gives an empty result. Columns of df with these names, in any case, are replaced; they may still be among order. None may begin with two underscores.
    """
    df, names = aside(df, MADE)
    numbered = row_numbers(df, [names.get(c, c) for c in order])
    n = numbered.count()
    place = numbered.withColumn("__place", permuted(F.col("row_number"), n, seed))
    return place.withColumn("shard", F.pmod(F.col("__place"), F.lit(shards)).cast("int")).withColumn("slot", F.floor(F.col("__place") / F.lit(shards)).cast("long")).drop("__place", *names.values())
