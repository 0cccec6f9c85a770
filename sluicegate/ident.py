"""Identity: hash buckets, folds, stratified ranks, fingerprints.

Random draws are functions of md5 of the row's identity and a seed, so that partitions, retries and other engines give
the same folds, samples and bootstrap weights.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def bucket(key: Column | str, k: int, seed: str = "") -> Column:
    """md5 of the key's text and seed, first 32 bits, modulo k."""
    key = F.col(key) if isinstance(key, str) else key
    digest = F.md5(F.concat(key.cast("string"), F.lit(seed)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")


def unit(key: Column | str, seed: str = "") -> Column:
    """A number in [0, 1) in steps of 1e-6."""
    return bucket(key, 1_000_000, seed) / F.lit(1e6)


def order_key(key: Column | str, seed: str = "") -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(seed)))


def stratified_folds(df: DataFrame, key: str, label: str, k: int, seed: str = "") -> DataFrame:
    """fold: the hash-ordered rank within each class, modulo k.  Classes with fewer than k rows still get folds."""
    rank = F.row_number().over(W.partitionBy(label).orderBy(order_key(key, seed), key))
    return df.withColumn("fold", ((rank - 1) % k).cast("int"))


def grouped_folds(df: DataFrame, group: str, k: int, seed: str = "") -> DataFrame:
    """fold by a hash of the group, so that equal texts or one conversation stay together."""
    return df.withColumn("fold", bucket(group, k, seed))


def stratified_take(df: DataFrame, key: str, label: str, n: int, seed: str = "") -> DataFrame:
    """n rows in the classes' proportions: floor shares first, then the largest remainders (smallest label on ties);
    fewer only where a class is short."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    total = F.sum("_size").over(W.partitionBy(F.lit(0)))  # a row for each class
    quota = F.col("_size") * n / total
    left = F.lit(n) - F.sum(F.floor("_quota")).over(W.partitionBy(F.lit(0)))
    nth = F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(F.col("_quota") - F.floor("_quota")), label))
    takes = sizes.withColumn("_quota", quota).withColumn("_take", F.floor("_quota") + (nth <= left).cast("long")).select(label, "_take")
    rank = F.row_number().over(W.partitionBy(label).orderBy(order_key(key, seed), key))
    return df.withColumn("_rank", rank).join(takes, label).where("_rank <= _take").drop("_rank", "_take")


def nested_sample(df: DataFrame, key: str, fraction: float, seed: str = "") -> DataFrame:
    """The first round(fraction * n) rows of one hash order, half to even: samples of one seed are nested.

    Rows are ranked within hash ranges, and ranges by their sizes, so that no task orders all rows.
    """
    digest = order_key(key, seed)
    part = F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")  # 4096 ranges in the digest's order
    rows = df.withColumn("_h", digest).withColumn("_part", part)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    everything = W.partitionBy(F.lit(0))
    sizes = sizes.select("_part", (F.sum("_n").over(everything.orderBy("_part")) - F.col("_n")).alias("_before"), F.bround(F.sum("_n").over(everything) * fraction).alias("_take"))
    rank = F.row_number().over(W.partitionBy("_part").orderBy("_h", key))
    return rows.withColumn("_rank", rank).join(F.broadcast(sizes), "_part").where("_before + _rank <= _take").select(df.columns)


def fingerprint(df: DataFrame, key: str, *columns: str, by: str | None = None) -> DataFrame:
    """sha256 of rows in the order of key, fields parted by 0x00 and rows by 0x1e, for each value of by."""
    row = F.concat_ws("\x00", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    groups = df.groupBy(by) if by else df.groupBy()
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), row.alias("r"))))
    return groups.agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["r"]), "\x1e"), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n"))
