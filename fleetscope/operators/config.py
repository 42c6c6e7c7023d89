"""Configuration operators: FL7, FL8, and the ``KEY=VALUE`` line parser used by SRC9."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .logs import first_n

# Words that make a configuration line sensitive (case-sensitive).
SENSITIVE_PATTERN = "PASSWORD|SECRET|KEY|AUTH"
UNRESOLVED_MARK = "op://"


def parse_config_lines(df: DataFrame, line: str = "line") -> DataFrame:
    """``KEY="value"   # note`` -> key, value; ``#`` lines flagged as comments."""
    raw = F.col(line)
    is_comment = F.ltrim(raw).startswith("#")
    body = F.regexp_replace(F.ltrim(raw), r"^#\s*", "")
    key = F.nullif(F.regexp_extract(body, r"^(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=", 1), F.lit(""))
    rest = F.regexp_extract(body, r"^(?:export\s+)?[A-Za-z_][A-Za-z0-9_]*\s*=(.*)$", 1)
    dq = F.regexp_extract(rest, r'^\s*"([^"]*)"', 1)
    sq = F.regexp_extract(rest, r"^\s*'([^']*)'", 1)
    unquoted = F.trim(F.regexp_replace(rest, r"\s+#.*$", ""))
    value = (F.when(key.isNull(), F.lit(None)).when(F.ltrim(rest).startswith('"'), dq)
             .when(F.ltrim(rest).startswith("'"), sq).otherwise(unquoted))
    return df.withColumn("key", key).withColumn("value", value).withColumn("is_comment", is_comment)


def sensitive_keys(cfg: DataFrame, line: str = "line") -> DataFrame:
    """FL7: lines naming a password, secret, key or auth setting, comments excluded."""
    return cfg.filter(F.col(line).rlike(SENSITIVE_PATTERN) & ~F.col(line).startswith("#"))


def unresolved_refs(cfg: DataFrame, limit: int = 5, file: str = "file", line_no: str = "line_no",
                    line: str = "line") -> DataFrame:
    """FL8: vault references left after injection; the first ``limit`` lines per file."""
    hits = cfg.filter(F.col(line).contains(UNRESOLVED_MARK))
    return first_n(hits, [file], [line_no], limit, out="rn")
