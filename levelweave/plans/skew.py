"""Keys that hold most of the rows: detection, joins and aggregates that stay balanced.

``heavy_keys`` samples the rows and names every key above a share of them, so at most
``1 / share`` keys are heavy (times two, as the threshold is halved against sampling noise);
that arithmetic is the size bound of every broadcast made here. Which keys are named
only moves rows between two plans with the same result: a missed key costs time, never rows.
The keys found are written, so that all branches of a plan see the same ones, also after a lost executor.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType

from levelweave.plans.storage import cut

#: Rows and bytes of a side that may be broadcast after both were measured.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64_000_000
#: Rows of a heavy key that one salted task takes.
ROWS_PER_SALT = 1_000_000


def heavy_keys(rows: DataFrame, keys: list[str], share: float = 0.001, fraction: float = 0.02, seed: int = 7, least: int = 8) -> DataFrame:
    """Keys that hold about ``share`` of the rows or more, with ``sampled`` counts.

    A key is heavy if its sampled count reaches ``least`` and half of ``share`` of the sample.
    Null keys are keys like any other. An empty table has no heavy key.
    """
    sampled = rows.select(*keys).sample(fraction, seed).groupBy(*keys).agg(F.count(F.lit(1)).alias("sampled"))
    total = sampled.agg(F.sum("sampled").alias("_total"))
    return sampled.join(F.broadcast(total), (F.col("sampled") >= least) & (F.col("sampled") >= F.col("_total") * (share / 2))).drop("_total")


#: Share of the rows that is sampled to find heavy keys.
SAMPLED = 0.02


def with_salts(heavy: DataFrame, rows_per_salt: int = ROWS_PER_SALT, fraction: float = SAMPLED) -> DataFrame:
    """Heavy keys with ``_salts``: tasks that each key's rows (sampled ones over ``fraction``) are worth, 8 at least."""
    return heavy.withColumn("_salts", F.greatest(F.lit(8), F.ceil(F.col("sampled") / (fraction * rows_per_salt))).cast("int")).drop("sampled")


def _bytes(c: Column, of: DataType) -> Column:
    if isinstance(of, StringType | BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(of, ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 16 + 16
    return F.lit(8)


def fits(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows and about ``most_bytes`` bytes; reads no more than it must."""
    size = reduce(lambda a, b: a + b, [_bytes(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields])
    n, held = df.select(size.cast("long").alias("size")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("size")).first()
    return n <= rows and (held or 0) <= most_bytes


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def split_heavy(rows: DataFrame, keys: list[str], heavy: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a heavy key, and the others; nulls match nulls."""
    b = F.broadcast(heavy.select(*keys))
    return (rows.alias("l").join(b.alias("h"), _same("l", "h", keys), "left_semi"), rows.alias("l").join(b.alias("h"), _same("l", "h", keys), "left_anti"))


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: float = 0.001, rows: int = BROADCAST_ROWS, rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """``left`` joined to ``right`` on ``keys`` although a few keys own most of ``left``.

    * ``right`` fits ``rows``: broadcast, no shuffle of ``left``.
    * otherwise heavy keys of ``left`` are found by sampling; their rows of ``right`` are
      broadcast if they fit (else copied for as many salts as the key's sampled rows need), the rest is shuffled,
      both are united.

    ``how`` is inner, left, left_semi or left_anti. Null keys match nothing, as in SQL;
    columns of ``right`` other than the keys must not clash with those of ``left``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"skew_join has no {how} join")
    if fits(right, rows):
        return left.join(F.broadcast(right), keys, how)
    heavy = cut(with_salts(heavy_keys(left.dropna(subset=keys), keys, share, SAMPLED), rows_per_salt))
    left_heavy, left_rest = split_heavy(left, keys, heavy)
    right_heavy, _ = split_heavy(right, keys, heavy)
    rest = left_rest.join(right, keys, how)
    if fits(right_heavy, rows):
        return left_heavy.join(F.broadcast(right_heavy), keys, how).unionByName(rest)
    names = F.broadcast(heavy)
    salted = left_heavy.join(names, keys).withColumn("_salt", (F.rand(11) * F.col("_salts")).cast("int")).drop("_salts")
    copies = right_heavy.join(names, keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt").unionByName(rest)


def skew_aggregate(rows: DataFrame, keys: list[str], unique: list[str], value: str, rows_per_salt: int = ROWS_PER_SALT, share: float = 0.0005) -> DataFrame:
    """Entries and sums of ``value`` per ``keys``, every (keys, ``unique``) row counted once.

    Rows of one position may be delivered several times; the greatest ``value`` stands for
    them. That needs all copies of a position in one place, so plain map-side sums don't do:
    rows of ordinary keys are shuffled by key once, de-duplicated and summed there; rows of
    heavy keys are tagged through a broadcast join and spread by a hash of ``unique`` over as many
    salts as their sampled rows need, de-duplicated there, summed to one partial row each, then combined.

    Columns: keys, ``entries`` (positions), ``values`` (with a finite value), ``sum_val``
    (null without such a value), ``bad_values`` (null, NaN or infinite). Null keys form
    groups of their own; an empty table gives none.
    """
    slim = rows.select(*keys, *unique, F.col(value).cast("double").alias("_v"))
    found = cut(with_salts(heavy_keys(slim, keys, share, SAMPLED), rows_per_salt))
    _, rest_rows = split_heavy(slim, keys, found)
    names = F.broadcast(found.select(*[F.col(k).alias(f"_{k}") for k in keys], "_salts"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    heavy_rows = slim.join(names, same).drop(*[f"_{k}" for k in keys])

    def partial(spread: DataFrame, at: list[str]) -> DataFrame:
        once = spread.groupBy(*at, *unique).agg(F.max("_v").alias("_v"))
        good = F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf"))
        return once.groupBy(*at).agg(F.count(F.lit(1)).alias("entries"), F.count(F.when(good, 1)).alias("values"), F.sum(F.when(good, F.col("_v"))).alias("sum_val"))

    rest = partial(rest_rows.repartition(*keys), keys)
    salted = heavy_rows.withColumn("_salt", F.pmod(F.xxhash64(*unique), F.col("_salts")).cast("int"))
    parts = partial(salted.repartition(*keys, "_salt"), [*keys, "_salt"])
    heavy = parts.groupBy(*keys).agg(F.sum("entries").alias("entries"), F.sum("values").alias("values"), F.sum("sum_val").alias("sum_val"))
    return rest.unionByName(heavy).withColumn("bad_values", F.col("entries") - F.col("values"))
