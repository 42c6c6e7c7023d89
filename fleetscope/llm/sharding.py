"""Sharding by sampled splitters: near-equal bytes per shard, groups of equal texts kept together.

1. Every record gets a key (hash of its text).  A size-weighted sample of keys
   (a record is drawn with a chance in proportion to its size) gives quantile
   splitters, which cut the key space into many more ranges than shards.
2. Ranges that turn out overfull are subdivided, by key, or by record id inside
   a group of copies too large to stay whole.
3. Exact byte counts of the (bounded number of) pieces give each piece its
   place on the global byte line; inside a piece a window gives each group of
   copies its place; the shard is the place's share of the total.

Only native DataFrame functions run.  The driver sees the splitters and two
totals; what is broadcast has a proven bound (pieces, and groups holding at
least ``whole_share`` of a shard, of which there are at most
``n_shards / whole_share``).

Defined cases: null text counts as empty (size 8); repeated rows are records of
their own; a null id is allowed; an empty table gives an empty result; input
columns besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import bucket_of, n_partitions, stored


def shard_by_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_shards: int = 24,
                   row_overhead: int = 8, ranges_per_shard: int = 16, samples_per_range: int = 64,
                   whole_share: float = 0.01) -> DataFrame:
    """Assign every row a ``shard`` and a gapless ``slot`` in it.

    Returns id, size, text_crc32, shard, slot.  ``size`` is the UTF-8 length of
    the text plus ``row_overhead``.  A group of equal texts stays in one shard
    unless it exceeds ``whole_share`` of a shard's bytes; larger groups are
    divided by id.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stored(df.select(
        F.col(id_col).alias("id"), (F.octet_length(text).cast("long") + row_overhead).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key")), "shard-base")
    total_bytes, total_rows = base.agg(F.sum("size"), F.count(F.lit(1))).first()
    total_bytes = int(total_bytes or 0)
    n_ranges = max(n_shards * ranges_per_shard, 2 * n_partitions(spark))
    splitters = _splitters(base, total_bytes, n_ranges, samples_per_range)
    ranged = bucket_of(base, "key", splitters, "rng")

    large = (base.groupBy("key").agg(F.sum("size").alias("bytes"))
             .filter(F.col("bytes") > whole_share * total_bytes / n_shards).select("key", F.lit(True).alias("large")))
    fair = max(1, -(-total_rows // n_ranges))
    parts = (ranged.groupBy("rng").agg(F.count(F.lit(1)).alias("n"))
             .select("rng", F.ceil(F.col("n") / (2 * fair)).cast("int").alias("parts")))
    tied = F.when(F.col("large"), F.xxhash64("id", "key")).otherwise(F.col("key"))
    pieces = (ranged.join(F.broadcast(large), "key", "left").join(F.broadcast(parts), "rng")
              .withColumn("large", F.coalesce("large", F.lit(False)))
              .withColumn("sub", F.pmod(F.xxhash64(tied, F.lit(1)), F.col("parts")).cast("int"))
              .withColumn("tie", F.when(F.col("large"), tied)))

    # Place of each piece on the byte line: one row per piece, at most about 1.5 * n_ranges + n_ranges of them.
    start = (pieces.groupBy("rng", "sub").agg(F.sum("size").alias("bytes"))
             .withColumn("start", F.coalesce(F.sum("bytes").over(
                 W.orderBy("rng", "sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("bytes"))
    inside = W.partitionBy("rng", "sub").orderBy("key", "tie").rangeBetween(W.unboundedPreceding, W.currentRow)
    unit = W.partitionBy("rng", "sub", "key", "tie")
    place = F.col("start") + F.sum("size").over(inside) - F.sum("size").over(unit) / 2
    sharded = stored(
        pieces.join(F.broadcast(start), ["rng", "sub"])
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor(place * n_shards / max(1, total_bytes))).cast("int"))
        .select("rng", "sub", "id", "size", "crc", "key", "shard"), "shard-placed")

    before = (sharded.groupBy("rng", "sub", "shard").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("before", F.coalesce(F.sum("n").over(
                  W.partitionBy("shard").orderBy("rng", "sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
              .drop("n"))
    nth = F.row_number().over(W.partitionBy("rng", "sub", "shard").orderBy("key", "id"))
    return (sharded.withColumn("nth", nth).join(F.broadcast(before), ["rng", "sub", "shard"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard",
                    (F.col("before") + F.col("nth") - 1).cast("long").alias("slot")))


def _splitters(base: DataFrame, total_bytes: int, n_ranges: int, samples_per_range: int) -> list:
    """Quantiles of a size-weighted key sample; the draw is a hash of the row, so reruns agree."""
    draw = F.pmod(F.xxhash64("id", "key", F.lit(7)), F.lit(1 << 40)) / float(1 << 40)
    sample = base.filter(draw * max(1, total_bytes) < F.col("size") * float(n_ranges * samples_per_range))
    at = [i / n_ranges for i in range(1, n_ranges)]
    found = sample.agg(F.percentile_approx("key", at, 20 * n_ranges).alias("q")).first()["q"]
    return sorted(set(found or []))


def op5_sampled_splitters(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` in 24 shards under the law ``bytes``."""
    from .common import table

    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
