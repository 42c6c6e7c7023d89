"""Scalar expressions used by the operators (SF1-SF15).

Each function returns a ``Column`` built from ``pyspark.sql.functions`` so
it stays inside whole-stage codegen and keeps filters pushable.
"""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ordered import epoch_seconds  # noqa: F401  (re-exported)


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_of_literal(df: DataFrame | None, ts_col: str | None, value) -> Column:
    """A constant timestamp typed like ``df[ts_col]`` (NTZ in batch, TIMESTAMP in streams).

    Being a literal, comparisons against it reach the parquet scan as pushed filters.
    """
    if isinstance(value, _dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    text = F.lit(str(value))
    if df is not None and ts_col is not None and isinstance(df.schema[ts_col].dataType, T.TimestampType):
        return F.to_timestamp(text)
    return F.to_timestamp_ntz(text)


def whole_units_between(later: Column, earlier: Column, unit_seconds: int) -> Column:
    """``floor((epoch(later) - floor(epoch(earlier))) / unit)`` (SF14)."""
    return F.floor((epoch_seconds(later) - epoch_seconds(earlier)) / F.lit(unit_seconds)).cast("bigint")


def base_name(path: str | Column) -> Column:
    """Last path element (SF1)."""
    return F.element_at(F.split(_c(path), "/"), -1)


def stamp_from_name(name: str | Column) -> Column:
    """``prefix-YYYY-mm-dd_HH-MM-SS.tar.gz`` -> timestamp_ntz, null when absent (SF2)."""
    raw = F.regexp_extract(_c(name), r"(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})", 1)
    return F.try_to_timestamp(F.nullif(raw, F.lit("")), F.lit("yyyy-MM-dd_HH-mm-ss")).cast("timestamp_ntz")


# Units of a relative age as printed in a container listing.
AGE_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400,
                    "week": 604800, "month": 2592000, "year": 31536000}


def relative_age_seconds(text: str | Column) -> Column:
    """"7 hours ago" / "About an hour ago" / "2 days ago" -> seconds (SF3)."""
    t = F.lower(_c(text))
    amount = F.regexp_extract(t, r"(\d+|an|a)\s+(second|minute|hour|day|week|month|year)s?\s+ago", 1)
    unit = F.regexp_extract(t, r"(\d+|an|a)\s+(second|minute|hour|day|week|month|year)s?\s+ago", 2)
    n = F.when(amount.isin("a", "an"), F.lit(1).cast("bigint")).otherwise(
        F.nullif(amount, F.lit("")).try_cast("bigint"))
    secs = F.lit(None).cast("bigint")
    for u, s in AGE_UNIT_SECONDS.items():
        secs = F.when(unit == u, n * F.lit(s)).otherwise(secs)
    return secs


def tag_version(tag: str | Column) -> Column:
    """Tag name with a leading ``v`` dropped (SF4)."""
    return F.regexp_replace(_c(tag), r"^v", "")


def version_parts(v: str | Column) -> Column:
    """``'15.7-alpine'`` -> ``[15, 7]``; any non-numeric part, or a date, -> null (SF5).

    Arrays compare element by element, so ``version_parts(a) < version_parts(b)``
    orders versions without a UDF (see ``version_key`` for versions of unequal length).
    """
    core = F.regexp_replace(F.regexp_replace(_c(v), r"^v", ""), r"-.*$", "")
    parts = F.transform(F.split(core, r"\."), lambda x: x.try_cast("int"))
    dated = _c(v).rlike(r"^v?\d{4}-\d{2}-\d{2}")
    return F.when(dated | F.exists(parts, lambda x: x.isNull()), F.lit(None)).otherwise(parts)


def version_key(v: str | Column) -> Column:
    """``version_parts`` without zeros at the end, so ``3.97`` and ``3.97.0`` compare as equal."""
    parts = version_parts(v)
    keep = F.array_max(F.transform(parts, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(parts, 1, keep)


def image_parts(image: str | Column) -> Column:
    """image -> struct(registry, repository, tag) (SF6)."""
    img = _c(image)
    tag = F.regexp_extract(img, r":([^:/]+)$", 1)
    name = F.regexp_replace(img, r":[^:/]+$", "")
    registry = F.when(F.regexp_extract(name, r"^([^/]+)/", 1).rlike(r"[.:]|^localhost$"),
                      F.regexp_extract(name, r"^([^/]+)/", 1))
    repo = F.when(registry.isNotNull(), F.regexp_replace(name, r"^[^/]+/", "")).otherwise(name)
    return F.struct(registry.alias("registry"), repo.alias("repository"),
                    F.when(tag == "", F.lit("latest")).otherwise(tag).alias("tag"))


def port_rows(ports: str | Column) -> Column:
    """``"0.0.0.0:7473-7474->7473-7474/tcp, 7687/tcp"`` -> array of struct(port, protocol) (SF7).

    Use with ``explode``/``inline``: one row per container port, ranges expanded
    with ``sequence``.  The container side of a ``host->container`` mapping is used.
    """
    items = F.split(F.coalesce(_c(ports), F.lit("")), r",\s*")

    def one(item):
        target = F.element_at(F.split(item, "->"), -1)
        proto = F.coalesce(F.nullif(F.regexp_extract(target, r"/(\w+)$", 1), F.lit("")), F.lit("tcp"))
        lo = F.nullif(F.regexp_extract(target, r"^(\d+)", 1), F.lit("")).try_cast("int")
        hi = F.coalesce(F.nullif(F.regexp_extract(target, r"^\d+-(\d+)", 1), F.lit("")).try_cast("int"), lo)
        return F.when(lo.isNull(), F.array()).otherwise(
            F.transform(F.sequence(lo, hi), lambda p: F.struct(p.alias("port"), proto.alias("protocol"))))

    return F.flatten(F.transform(items, one))


def setting_value(text: str | Column, kind: str = "int") -> Column:
    """A configuration value as a number or boolean; anything else is null (SF15)."""
    t = F.trim(_c(text))
    if kind == "bool":
        low = F.lower(t)
        return (F.when(low.isin("true", "yes", "on", "1"), F.lit(True))
                .when(low.isin("false", "no", "off", "0"), F.lit(False)))
    return t.try_cast({"int": "bigint", "float": "double"}[kind])


def id_hex(x: str | Column, width: int = 32) -> Column:
    """Normalise an id to lower-case hex left-padded to ``width`` (SF8)."""
    return F.lpad(F.lower(F.trim(_c(x))), width, "0")


def json_field(df: DataFrame, col: str, key: str) -> Column:
    """Field ``key`` of a map column or of a JSON text column (SF9)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.MapType):
        return F.try_element_at(F.col(col), F.lit(key))
    if isinstance(dtype, T.StructType):
        return F.col(col)[key]
    return F.get_json_object(F.col(col), f"$.{key}")


def json_path(text: str | Column, path: str, kind: str = "string") -> Column:
    """Value at ``path`` (such as ``$.data[0].metadata.x``) of JSON of any shape (SF9).

    The text is parsed to a VARIANT.  Broken JSON, a shape without that path and
    a value that is no ``kind`` give null; an object or array as a string is its
    JSON text.
    """
    return F.try_variant_get(F.try_parse_json(_c(text)), path, kind)


# Binary size units as printed by du -h / pg_size_pretty.
SIZE_UNITS = {"": 1, "B": 1, "K": 1024, "KB": 1024, "KIB": 1024, "M": 1024 ** 2, "MB": 1024 ** 2,
              "MIB": 1024 ** 2, "G": 1024 ** 3, "GB": 1024 ** 3, "GIB": 1024 ** 3,
              "T": 1024 ** 4, "TB": 1024 ** 4, "TIB": 1024 ** 4}


def human_size_bytes(text: str | Column) -> Column:
    """``'1.5G'`` / ``'20 MB'`` / ``'512 bytes'`` -> bytes (SF10)."""
    t = F.upper(F.trim(F.regexp_replace(_c(text), r"(?i)\s*bytes?$", "B")))
    num = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Z]*)$", 1).try_cast("double")
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Z]*)$", 2)
    mult = F.lit(None).cast("double")
    for u, m in SIZE_UNITS.items():
        mult = F.when(unit == u, F.lit(float(m))).otherwise(mult)
    return F.round(num * mult).cast("bigint")


def link(prefix: str, value: str | Column) -> Column:
    """Link building (SF11)."""
    return F.concat(F.lit(prefix), _c(value))


def strip_tags(text: str | Column) -> Column:
    """Remove ``<...>`` tags and trim (SF13)."""
    return F.trim(F.regexp_replace(_c(text), r"<[^>]*>", ""))


def upper_first(text: str | Column) -> Column:
    """Upper-case the first character (SF13)."""
    t = _c(text)
    return F.concat(F.upper(F.substring(t, 1, 1)), F.substring(t, 2, 1 << 30))


def glob_to_regex(glob: str) -> str:
    """Shell glob over a base name -> anchored regex (``*`` and ``?`` stay inside one name)."""
    out = []
    for ch in glob:
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        else:
            out.append(re.escape(ch) if ch in ".^$+{}[]()|\\" else ch)
    return "^" + "".join(out) + "$"
