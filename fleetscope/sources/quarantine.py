"""Malformed JSON set aside: every line or page is either a parsed row or a dead letter, never both or neither.

Text is read as text and parsed by ``from_json`` with a corrupt-record field, so
one pass over the files serves both tables, in batch and in streams.  A value
that does not fit its field's type (a word where a time is expected) makes the
whole line a dead letter, as a truncated line does.  Blank lines are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that rows carry until they are split.
RAW, FILE, ROW, BROKEN = "_raw", "_file", "_row", "_broken"


def parsed(lines: DataFrame, schema: T.StructType, value: str = "value", file: str | Column | None = None) -> DataFrame:
    """Lines (or whole pages) of text with their parsed ``_row``; ``_broken`` says which are no valid record."""
    wide = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    text = F.col(value)
    row = F.from_json(text, wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN})
    kept = lines.filter(text.isNotNull() & (F.trim(F.translate(text, "\t\r\n", "   ")) != ""))
    source = (F.col(file) if isinstance(file, str) else file) if file is not None else F.lit(None).cast("string")
    out = kept.select(text.alias(RAW), source.alias(FILE), row.alias(ROW))
    # Text that is valid JSON but no object parses to a row without any field.
    is_object = F.ltrim(F.translate(F.col(RAW), "\t\r\n", "   ")).startswith("{")
    return out.withColumn(BROKEN, F.col(ROW).isNull() | F.col(f"{ROW}.{BROKEN}").isNotNull() | ~is_object)


def good_rows(rows: DataFrame) -> DataFrame:
    """The parsed fields of valid records (and what else the rows carry)."""
    fields = [f.name for f in rows.schema[ROW].dataType.fields if f.name != BROKEN]
    rest = [c for c in rows.columns if c not in (RAW, FILE, ROW, BROKEN)]
    return rows.filter(~F.col(BROKEN)).select(*[F.col(f"{ROW}.{f}").alias(f) for f in fields], *rest)


def dead_letters(rows: DataFrame, *keep: str) -> DataFrame:
    """(file, raw, ...) of what could not be parsed."""
    return rows.filter(BROKEN).select(F.col(FILE).alias("file"), F.col(RAW).alias("raw"), *keep)


def read_text(spark: SparkSession, path: str, whole: bool = False, stream: bool = False,
              max_files_per_trigger: int | None = None) -> DataFrame:
    """(value, file): lines of the files under ``path``, or each file as a whole."""
    reader = spark.readStream if stream else spark.read
    if stream and max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.text(path, wholetext=whole).select("value", F.col("_metadata.file_path").alias("file"))
