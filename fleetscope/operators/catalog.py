"""Backup-catalog operators: FL5, FL11, JN5, JN11, WN3-WN6, TK1, ST2, AG10, AG11, RT1-RT3.

A catalog is ``host, name, size_bytes, mtime`` (plus optional ``is_link``).
Outputs are plan tables; moving or deleting bytes is left to the caller.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import as_of_literal, base_name, glob_to_regex, stamp_from_name, whole_units_between
from ..plans.ordered import lag_in_series, ordered_index, time_chunk

# Base names never mirrored, and the archive glob.
DEFAULT_EXCLUDES = (".sync-lock", "*.log", ".DS_Store", ".docker-backup-lock")
ARCHIVE_GLOB = "{prefix}-*.tar.gz"
OVERSIZE_BYTES = 1048576


def _regular(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("is_link")) if "is_link" in files.columns else files


def _fits(name: str, glob: str):
    """A glob as a condition: equality or prefix and suffix where that says the same (and can be pushed), else a regex."""
    parts = glob.split("*")
    if len(parts) > 2 or any(c in glob for c in "?[]"):
        return F.col(name).rlike(glob_to_regex(glob))
    if len(parts) == 1:
        return F.col(name) == glob
    head, tail = parts
    cond = F.length(name) >= len(head) + len(tail)
    cond = F.col(name).startswith(head) & cond if head else cond
    return cond & F.col(name).endswith(tail) if tail else cond


def match_names(files: DataFrame, include: str | None = None, exclude: Sequence[str] = DEFAULT_EXCLUDES,
                prefix: str = "backup", name: str = "name") -> DataFrame:
    """FL5: include glob (``<prefix>-*.tar.gz`` by default), minus base-name excludes."""
    inc = include or ARCHIVE_GLOB.format(prefix=prefix)
    cond = _fits(name, inc)
    for ex in exclude:
        cond = cond & ~_fits(name, ex)
    return files.filter(cond)


def archive_stamps(files: DataFrame, name: str = "name") -> DataFrame:
    """SF1/SF2 on a catalog: stamp written in the file name, ``manual`` flag, and the
    whole seconds between the stamp and the file's mtime."""
    stamp = stamp_from_name(base_name(F.col(name)))
    return files.select("host", name, "mtime", stamp.alias("stamp"),
                        base_name(F.col(name)).contains("-manual-").alias("manual"),
                        (F.unix_timestamp("mtime") - F.unix_timestamp(stamp)).alias("stamp_lag_seconds"))


def oversize(files: DataFrame, limit: int = OVERSIZE_BYTES, size: str = "size_bytes") -> DataFrame:
    """FL11: files larger than ``limit`` bytes."""
    return files.filter(F.col(size) > F.lit(limit))


def mirror_diff(primary: DataFrame, replica: DataFrame, keys: Sequence[str] = ("host", "name"),
                exclude: Sequence[str] = DEFAULT_EXCLUDES) -> DataFrame:
    """JN5: action per file: copy, update, delete or same.

    Exclusions (lock files, logs) apply to both sides before the diff, so excluded files on the
    replica are never planned for deletion.
    """
    keys = list(keys)
    if exclude:
        primary = match_names(primary, include="*", exclude=exclude)
        replica = match_names(replica, include="*", exclude=exclude)
    p = primary.select(*keys, F.col("size_bytes").alias("p_size"), F.col("mtime").alias("p_mtime"),
                       F.lit(True).alias("_in_p"))
    r = replica.select(*keys, F.col("size_bytes").alias("r_size"), F.col("mtime").alias("r_mtime"),
                       F.lit(True).alias("_in_r"))
    j = p.join(r, keys, "full_outer")
    in_p, in_r = F.col("_in_p").isNotNull(), F.col("_in_r").isNotNull()
    action = (F.when(~in_r, "copy").when(~in_p, "delete")
              .when(~F.col("p_size").eqNullSafe(F.col("r_size")) | ~F.col("p_mtime").eqNullSafe(F.col("r_mtime")), "update")
              .otherwise("same"))
    return j.select(*keys, action.alias("action"), "p_size", "r_size")


def count_parity(primary: DataFrame, replica: DataFrame, key: str = "host") -> DataFrame:
    """AG11: regular-file counts per side and whether they match."""
    both = (_regular(primary).select(key, F.lit(1).alias("_p"), F.lit(0).alias("_r"))
            .unionByName(_regular(replica).select(key, F.lit(0).alias("_p"), F.lit(1).alias("_r"))))
    g = both.groupBy(key).agg(F.sum("_p").cast("bigint").alias("n_primary"), F.sum("_r").cast("bigint").alias("n_replica"))
    return g.withColumn("counts_match", F.col("n_primary") == F.col("n_replica"))


def only_in(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("host", "name")) -> DataFrame:
    """ST2: distinct rows of ``a`` not in ``b``."""
    return a.select(*cols).subtract(b.select(*cols))


def in_both(a: DataFrame, b: DataFrame, cols: Sequence[str] = ("host", "name")) -> DataFrame:
    """ST2: distinct rows in both."""
    return a.select(*cols).intersect(b.select(*cols))


def _name_ranges(files: DataFrame, ranges: int) -> list[str]:
    """Bounds that cut the names into ``ranges`` parts of about the same number of distinct names.

    The 16 * ``ranges`` names of least hash are a uniform sample of the distinct
    names, the same one whenever it is drawn; only they reach the driver.
    """
    sample = files.select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(16 * ranges)
    names = sorted(r[0] for r in sample.collect() if r[0] is not None)
    return [names[len(names) * i // ranges] for i in range(1, ranges)] if len(names) >= ranges else names[1:]


def list_backups(files: DataFrame, n: int | None = 20, by: str = "mtime", key: str = "host",
                 ranges: int = 64) -> DataFrame:
    """TK1: newest ``n`` by mtime (or greatest ``n`` by name) per host, numbered from 1; all files with ``n=None``.

    A top-n is a WindowGroupLimit, also applied before the shuffle.  Numbering
    every file is done per (host, day) or (host, range of names) chunk with
    offsets, so a hot host is still split.  The ranges' bounds are drawn from
    the names themselves (see ``_name_ranges``).
    """
    f = _regular(files).select(key, "name", "size_bytes", "mtime")
    if by not in ("mtime", "name"):
        raise ValueError(by)
    order = [F.col("name").desc()] if by == "name" else [F.col("mtime").desc(), F.col("name").desc()]
    if n is not None:
        w = Window.partitionBy(key).orderBy(*order)
        out = f.withColumn("number", F.row_number().over(w)).filter(F.col("number") <= n)
        out = out.withColumn("number", F.col("number").cast("bigint"))
    elif by == "name":
        bounds = _name_ranges(f, ranges)
        place = F.aggregate(F.array(*[F.lit(b) for b in bounds]), F.lit(0), lambda n, b: n + (F.col("name") >= b).cast("int")) if bounds else F.lit(0)
        out = ordered_index(f, [key], order, "number", chunk=place, descending_chunks=True)
    else:
        out = ordered_index(f, [key], order, "number", chunk=time_chunk("mtime", 86400), descending_chunks=True)
    return out.select(key, "number", "name", "size_bytes", F.to_date("mtime").alias("date"), "mtime")


def latest_backup(files: DataFrame, by: str = "mtime", key: str = "host") -> DataFrame:
    """WN3: newest file per host by mtime (or greatest name with ``by='name'``).

    ``max(struct)`` is a partial aggregate: each map task sends one row per host.
    """
    f = _regular(files)
    if by == "mtime":
        rec = F.struct("mtime", "name", "size_bytes")
    elif by == "name":
        rec = F.struct("name", "mtime", "size_bytes")
    else:
        raise ValueError(by)
    g = f.groupBy(key).agg(F.max(rec).alias("_m"))
    return g.select(key, "_m.name", "_m.size_bytes", "_m.mtime")


# A backup is fresh below 25 whole hours.
FRESH_HOURS = 25


def backup_freshness(files: DataFrame, hosts: DataFrame, as_of, hours: int = FRESH_HOURS,
                     key: str = "host") -> DataFrame:
    """WN4: whole hours since the latest backup; ``ok`` below ``hours``, else ``warn``;
    hosts without any backup are ``no_backups``."""
    cutoff = as_of_literal(files, "mtime", as_of)
    latest = latest_backup(files.filter(F.col("mtime") <= cutoff), "mtime", key)
    j = hosts.select(key).distinct().join(latest, key, "left")
    age = whole_units_between(as_of_literal(files, "mtime", as_of), F.col("mtime"), 3600)
    status = F.when(F.col("mtime").isNull(), "no_backups").when(age < hours, "ok").otherwise("warn")
    return j.select(key, "name", "mtime", F.when(F.col("mtime").isNotNull(), age).alias("age_hours"),
                    status.alias("status"))


def rpo_gaps(files: DataFrame, hours: int = 24, key: str = "host") -> DataFrame:
    """WN5: gaps between successive backups of a host longer than ``hours``."""
    f = _regular(files).select(key, "name", "mtime")
    lagged = lag_in_series(f, [key], ["mtime", "name"], [], chunk_seconds=86400)
    gap = F.unix_timestamp("mtime") - F.unix_timestamp("prev_mtime")
    return (lagged.filter(F.col("mtime") > F.col("prev_mtime") + F.expr(f"INTERVAL {int(hours)} HOURS"))
            .select(key, F.col("prev_name"), F.col("prev_mtime"), "name", "mtime",
                    gap.cast("bigint").alias("gap_seconds")))


# Storage growth target, bytes per day.
GROWTH_LIMIT_BYTES = 1024 ** 3


def storage_growth(volumes: DataFrame, key: str = "host", ts: str = "mtime", size: str = "size_bytes",
                   limit: int = GROWTH_LIMIT_BYTES, added: bool = False) -> DataFrame:
    """WN6: bytes per day, change against the previous day with data, over-limit flag.

    ``volumes`` are measured sizes (the sum of a day's rows is what is held that
    day) or, with ``added``, files written (what is held grows by them).  The
    limit is per day: growth counts as over it when it exceeds ``limit`` times
    the days since the previous total; the first day of measured sizes has no
    growth, the first day's files are growth of one day.  The lag runs over the
    daily totals (one row per key and day).
    """
    daily = volumes.groupBy(key, F.to_date(ts).alias("day")).agg(F.sum(size).cast("bigint").alias("bytes"))
    w = Window.partitionBy(key).orderBy("day")
    if added:
        total = F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return daily.select(key, "day", total.cast("bigint").alias("bytes"),
                            F.when(F.lag("day").over(w).isNotNull(), total - F.col("bytes")).cast("bigint").alias("prev_bytes"),
                            F.lit(1).alias("days"), F.col("bytes").alias("growth"),
                            F.coalesce(F.col("bytes") > F.lit(limit).cast("bigint"), F.lit(False)).alias("over_limit"))
    prev = F.lag("bytes").over(w)
    days = F.date_diff("day", F.lag("day").over(w))
    return daily.select(key, "day", "bytes", prev.alias("prev_bytes"), days.alias("days"),
                        (F.col("bytes") - prev).alias("growth"),
                        F.coalesce((F.col("bytes") - prev) > days * F.lit(limit).cast("bigint"), F.lit(False)).alias("over_limit"))


def missed_runs(files: DataFrame, start: str, end: str, hosts: DataFrame, hour: int = 2, key: str = "host") -> DataFrame:
    """JN11: daily schedule slots (at ``hour``) with no backup that day, for every host of ``hosts``.

    Each host generates its own calendar (``sequence`` + ``explode``), then a
    left-anti join on (host, day) removes the days with a backup.
    """
    h = hosts.select(key).distinct()
    days = h.select(key, F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)),
                                              F.expr("INTERVAL 1 DAY"))).alias("day"))
    done = _regular(files).select(key, F.to_date("mtime").alias("day")).distinct()  # reduced map-side
    missed = days.join(done, [key, "day"], "left_anti")
    slot = F.to_timestamp_ntz(F.concat(F.col("day").cast("string"), F.lit(f" {int(hour):02d}:00:00")))
    return missed.select(key, "day", slot.alias("slot_ts"))


def prune(files: DataFrame, as_of, days: int, leeway: int = 0, prefix: str | None = None,
          include: str | None = ARCHIVE_GLOB.format(prefix="backup")) -> DataFrame:
    """RT1/RT3: files whose whole 24-hour periods of age exceed ``days``.

    Only regular files whose name fits the archive glob ``include`` are ever
    planned for removal.  ``leeway`` seconds are taken off the age (so more is
    kept); ``prefix`` limits pruning further to names starting with it.
    """
    f = _regular(files)
    if include is not None:
        f = match_names(f, include=include, exclude=())
    if prefix is not None:
        f = f.filter(F.col("name").startswith(prefix))
    now = as_of_literal(files, "mtime", as_of)
    shifted = now - F.expr(f"INTERVAL {int(leeway)} SECONDS") if leeway else now
    age = whole_units_between(shifted, F.col("mtime"), 86400)
    # floor((A - floor(m)) / 86400) > days  <=>  m < A - (days + 1) * 86400 + 1 s  (A in whole seconds):
    # the same condition as a literal bound, so the scan can skip row groups.
    a = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
    bound = a.replace(microsecond=0) - _dt.timedelta(seconds=int(leeway) + (days + 1) * 86400 - 1)
    return (f.filter(F.col("mtime") < as_of_literal(files, "mtime", bound))
            .withColumn("age_days", age).filter(F.col("age_days") > days))


def _monday(d):
    return F.date_sub(d, (F.dayofweek(d) + 5) % 7)


def tiered_retention(files: DataFrame, as_of, daily: int = 7, weekly: int = 4, monthly: int = 12,
                     key: str = "host") -> DataFrame:
    """RT2: keep the newest file per calendar day, ISO week and month inside each tier.

    Tier bounds are computed once from ``as_of`` (constants, pushed down).
    Each tier is a ``max(struct)`` per (host, period), a partial aggregate;
    the union of kept files is joined back for a keep flag per file.
    """
    a = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
    day0 = a.date() - _dt.timedelta(days=daily - 1)
    week0 = a.date() - _dt.timedelta(days=a.weekday()) - _dt.timedelta(weeks=weekly - 1)
    m = a.year * 12 + (a.month - 1) - (monthly - 1)
    month0 = _dt.date(m // 12, m % 12 + 1, 1)
    every = _regular(files).select(key, "name", "mtime", F.to_date("mtime").alias("_d"))
    f = every.filter(F.col("mtime") <= as_of_literal(files, "mtime", a))

    def newest(lo: _dt.date, period, tier: str) -> DataFrame:
        g = (f.filter(F.col("_d") >= F.lit(lo)).groupBy(key, period.alias("_p"))
             .agg(F.max(F.struct("mtime", "name")).alias("_m")))
        return g.select(key, F.col("_m.name").alias("name"), F.lit(tier).alias("tier"))

    kept = (newest(day0, F.col("_d"), "daily")
            .unionByName(newest(week0, _monday(F.col("_d")), "weekly"))
            .unionByName(newest(month0, F.trunc(F.col("_d"), "month"), "monthly")))
    flags = kept.groupBy(key, "name").agg(
        F.bool_or(F.col("tier") == "daily").alias("keep_daily"),
        F.bool_or(F.col("tier") == "weekly").alias("keep_weekly"),
        F.bool_or(F.col("tier") == "monthly").alias("keep_monthly"))
    j = every.drop("_d").join(flags, [key, "name"], "left")
    out = j.select(key, "name", "mtime",
                   *[F.coalesce(c, F.lit(False)).alias(c) for c in ("keep_daily", "keep_weekly", "keep_monthly")])
    # A file newer than ``as_of`` is outside every tier and is kept.
    newer = F.col("mtime") > as_of_literal(files, "mtime", a)
    return out.withColumn("keep", F.col("keep_daily") | F.col("keep_weekly") | F.col("keep_monthly") | F.coalesce(newer, F.lit(True)))


def volume_sizes(files: DataFrame, keys: Sequence[str] = ("host",), size: str = "size_bytes", totals: bool = False) -> DataFrame:
    """AG10: files and bytes per key (e.g. host and volume).

    With ``totals`` also the subtotals of each leading key and the total of all
    (a rollup); ``level`` counts the keys that a row is given for.
    """
    if totals:
        level = F.lit(len(keys)) - F.bit_count(F.grouping_id())
        return files.rollup(*keys).agg(level.cast("int").alias("level"), F.count(F.lit(1)).alias("n_files"),
                                       F.sum(size).cast("bigint").alias("total_bytes"))
    return files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"),
                                    F.sum(size).cast("bigint").alias("total_bytes"))
