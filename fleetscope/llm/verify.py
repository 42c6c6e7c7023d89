"""Candidate pairs of texts confirmed on their full shingle sets.

Only texts that are in pairs are moved, and as texts: they take less room than
the hashes of their shingles.  A bitmap of ids of bounded size keeps the others
where they are read; beyond its size it lets more texts pass, and the result
stays the same.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import n_partitions
from .wordhash import Runs, Words, slices


def shingle_sets(column, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text of an Arrow column."""
    words = Words(column, lower=True)
    runs = Runs(words.hash)
    grams = runs.all(n)
    short = (words.count > 0) & (words.count < n)
    whole = runs.some(words.first[:-1][short], words.first[1:][short])
    out, at = [], 0
    for begin, end, is_short in zip(words.first[:-1].tolist(), words.first[1:].tolist(), short.tolist()):
        if is_short:
            out.append(whole[at:at + 1])
            at += 1
            continue
        value = np.sort(grams[begin:max(begin, end - n + 1)])
        new = np.ones(len(value), bool)
        np.not_equal(value[1:], value[:-1], out=new[1:])
        out.append(value[new])
    return out


def _bits(ids: DataFrame, per_id: int = 16, most: int = 1 << 27) -> np.ndarray:
    """A bitmap of hashed ids, 16 MB at most; beyond that it only lets more rows pass."""
    want = min(most, max(1 << 12, 1 << (per_id * ids.count() - 1).bit_length())) if per_id else most
    at = F.pmod(F.xxhash64("id"), F.lit(want))
    words = (ids.select(F.shiftright(at, 6).alias("word"), at.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")))
    out = np.zeros(want // 64, np.uint64)
    got = words.toArrow()
    out[np.asarray(got.column("word"))] = np.asarray(got.column("bits")).view(np.uint64)
    return out


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id may be in ``ids``: all that are, few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bits(ids))
    kind = docs.schema["text"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        words = shared.value
        for batch in batches:
            at = np.asarray(batch.column("at"))
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            yield batch.select(["id", "text"]).filter(pa.array(hit))

    known = docs.filter("id is not null").withColumn("at", F.pmod(F.xxhash64("id"), F.lit(len(shared.value) * 64)))
    return known.mapInArrow(run, f"id long, text {kind}")


def _compared(n: int, percent: int):
    """Streams rows sorted by (a, salt, side): the sets of ``a`` first, then those it is compared with."""
    def run(batches):
        import pyarrow as pa

        key, firsts = None, []
        for whole in batches:
            for batch in slices(whole, batch_text := whole.schema.get_field_index("text")):
                out = []
                sets = shingle_sets(batch.column(batch_text), n)
                cols = (batch.column(c).to_pylist() for c in ("a", "salt", "side", "id"))
                for a, salt, side, ident, value in zip(*cols, sets):
                    if (a, salt) != key:
                        key, firsts = (a, salt), []
                    if side == 0:
                        firsts.append(value)
                        continue
                    for first in firsts:
                        # Values of the second set found in the first one, both sorted and distinct.
                        at = np.searchsorted(first, value)
                        shared = int((first[np.minimum(at, len(first) - 1)] == value).sum()) if len(first) else 0
                        if shared and 100 * shared >= percent * (len(first) + len(value) - shared):
                            out.append((a, ident))
                            break
                if out:
                    a, b = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(docs: DataFrame, pairs: DataFrame, n: int, percent: int, most: int = 256) -> DataFrame:
    """The stored pairs (a, b) whose full sets are similar enough.

    Texts that are in pairs travel to the pair's first id (a text takes less room
    than its hashes).  A first id with many partners is divided: each part has
    about ``most`` of them and the first text.
    """
    parts = n_partitions(docs.sparkSession)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("salts"))
    roles = (pairs.select("a", "b").join(many, "a")
             .select(F.col("b").alias("id"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("side"))
             .unionByName(many.select(F.col("a").alias("id"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"),
                                      F.lit(0).alias("side"))))
    met = roles.join(_among(docs, ids), "id").repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "side", "id")
    return met.mapInArrow(_compared(n, percent), "a long, b long").distinct()
