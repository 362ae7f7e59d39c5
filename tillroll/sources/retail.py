"""Reader of invoice lines."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.operators.numbering import file_offsets
from tillroll.schema import FILE_PATH, RETAIL_SCHEMA, ROW_ORDER, require_schema


def read_retail(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    sequence: str | None = None,
    timestamp_format: str | None = None,
    convert: bool = False,
    dense: bool = False,
) -> DataFrame:
    """Invoice lines with a fixed schema and a ``row_order`` column.

    ``sequence`` names a BIGINT column of the input that numbers its lines. Without
    it the order is that of the files: by path, then by position in the file.
    Neither the number of splits nor a repeated task changes that order. ``dense`` (Parquet)
    gives that order as a number, 0 for the first line: loads that are to be merged need numbers.

    A Parquet column of another type is an error, unless ``convert`` asks for
    ``exact_types``. (CSV is parsed to the schema.)
    """
    if fmt == "parquet":
        lines = spark.read.parquet(path)
        if convert:
            numbered = [T.StructField(sequence, T.LongType())] if sequence else []
            lines = exact_types(lines, T.StructType([*RETAIL_SCHEMA, *numbered]))
        position = [F.col("_metadata.row_index")]
    elif fmt == "csv":
        schema = RETAIL_SCHEMA
        if sequence:
            schema = T.StructType([T.StructField(sequence, T.LongType()), *RETAIL_SCHEMA])
        reader = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST")
        if timestamp_format:
            reader = reader.option("timestampNTZFormat", timestamp_format)
        # The header must name the columns of the schema in their order.
        lines = reader.option("enforceSchema", False).csv(path)
        # A split is read by one task from top to bottom, so the id grows within it.
        position = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    else:
        raise ValueError(f"unknown format {fmt!r}; use 'parquet' or 'csv'")
    if sequence:
        schema = T.StructType([*RETAIL_SCHEMA, T.StructField(sequence, T.LongType())])
        return require_schema(lines, schema).withColumnRenamed(sequence, ROW_ORDER)
    require_schema(lines, RETAIL_SCHEMA)
    if dense:
        if fmt != "parquet":
            raise ValueError("only Parquet knows the position of a line in its file; give a sequence")
        return _numbered(lines)
    position = [p.alias(f"at_{i}") for i, p in enumerate(position)]
    order = F.struct(F.col("_metadata.file_path").alias(FILE_PATH), *position)
    return lines.select(*RETAIL_SCHEMA.names, order.alias(ROW_ORDER))


# With more files than this, their offsets are joined without a broadcast.
MANY_FILES = 100_000


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their number: the rows of the files before theirs, and the position there.

    The sizes of the files come from their footers. There is an offset for each file that
    Spark lists; up to MANY_FILES of them, some 20 MB, are broadcast.
    """
    placed = lines.select(
        *RETAIL_SCHEMA.names,
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.row_index").alias("_index"),
    )
    offsets = file_offsets(placed.select("_path", "_index"), "_path", "_index")
    if len(lines.inputFiles()) <= MANY_FILES:
        offsets = F.broadcast(offsets)
    number = (F.col("before") + F.col("_index")).alias(ROW_ORDER)
    return placed.join(offsets, "_path").select(*RETAIL_SCHEMA.names, number)


def exact_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns of ``schema`` cast to its types where that loses nothing.

    Between numbers, from whole numbers to strings (17850.0 becomes "17850"), and from dates and
    zoned times (in the session's zone) to times without zone. A value the new type can't
    hold fails the query that reads it. Other types stay, for ``require_schema`` to refuse.
    """
    found = {f.name: f.dataType for f in df.schema}
    casts = {}
    for field in schema:
        have, want = found.get(field.name), field.dataType
        value = F.col(field.name)
        cast = None if have is None or have == want else _converted(value, have, want)
        if cast is None:
            continue
        message = F.concat(F.lit(f"{field.name} can't be {want.simpleString()}: "), value.cast("string"))
        same = cast.try_cast(have).eqNullSafe(value)
        casts[field.name] = F.when(same, cast).otherwise(F.raise_error(message).cast(want))
    return df.withColumns(casts)


def _converted(value: Column, have: T.DataType, want: T.DataType) -> Column | None:
    """``value`` in another type, NULL if it has no place there; None if the types have nothing in common."""
    if isinstance(have, T.NumericType) and isinstance(want, T.NumericType):
        return value.try_cast(want)
    if isinstance(have, T.NumericType) and isinstance(want, T.StringType):
        return value.try_cast("decimal(38,0)").cast("string")
    if isinstance(have, (T.DateType, T.TimestampType)) and isinstance(want, T.TimestampNTZType):
        return value.cast(want)
    return None


# --- bad lines set aside


class CheckedLines(NamedTuple):
    """The good lines, and the others with the reason and what stands in the input.

    Both read one written table, partitioned by whether a line is bad.
    """

    lines: DataFrame
    rejects: DataFrame


def load_checked(
    spark: SparkSession,
    path: str,
    folder: str,
    fmt: str = "parquet",
    sequence: str | None = None,
    timestamp_format: str | None = None,
) -> CheckedLines:
    """Read invoice lines of any types, or CSV, write them to ``folder`` and return both parts.

    Where ``read_retail`` fails on a value that does not fit its type exactly, here the line is set
    aside: ``rejects`` has row_order, ``reason``, the first column's that does not fit (or "malformed
    line" for a line of CSV with too many or too few fields), and ``source``, the line as JSON.
    The input is read once. Every line is in one of the parts.
    """
    checked = check_lines(spark, path, fmt, sequence, timestamp_format)
    checked.withColumn("rejected", F.col("reason").isNotNull()).write.partitionBy("rejected").parquet(folder)
    schema = T.StructType([*checked.schema, T.StructField("rejected", T.BooleanType())])
    stored = spark.read.schema(schema).parquet(folder)
    return CheckedLines(
        stored.where("NOT rejected").select(*RETAIL_SCHEMA.names, ROW_ORDER),
        stored.where("rejected").select(ROW_ORDER, "reason", "source"),
    )


def check_lines(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    sequence: str | None = None,
    timestamp_format: str | None = None,
) -> DataFrame:
    """Typed lines with row_order, ``reason`` and ``source``; the last two are NULL for good lines."""
    numbered = [T.StructField(sequence, T.LongType())] if sequence else []
    schema = T.StructType([*numbered, *RETAIL_SCHEMA])
    corrupt = "_corrupt_record"
    if fmt == "parquet":
        raw = spark.read.parquet(path)
        position = [F.col("_metadata.row_index")]
    elif fmt == "csv":
        strings = T.StructType([T.StructField(n, T.StringType()) for n in [*schema.names, corrupt]])
        reader = spark.read.schema(strings).option("header", True).option("mode", "PERMISSIVE")
        raw = reader.option("columnNameOfCorruptRecord", corrupt).option("enforceSchema", False).csv(path)
        position = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    else:
        raise ValueError(f"unknown format {fmt!r}; use 'parquet' or 'csv'")
    missing = [n for n in schema.names if n not in raw.columns]
    if missing:
        raise ValueError(f"no such column: {', '.join(missing)}")
    reasons = [F.when(F.col(corrupt).isNotNull(), "malformed line")] if fmt == "csv" else []
    typed = {}
    for field in schema:
        value, have, want = F.col(field.name), raw.schema[field.name].dataType, field.dataType
        typed[field.name], good = _checked(value, have, want, timestamp_format)
        message = F.concat(F.lit(f"{field.name}: not {want.simpleString()}: "), value.cast("string"))
        reasons.append(F.when(~good, message))
    if sequence:
        reasons.append(F.when(F.col(sequence).isNull(), f"{sequence}: missing"))
        order = typed[sequence]
    else:
        places = [p.alias(f"at_{i}") for i, p in enumerate(position)]
        order = F.struct(F.col("_metadata.file_path").alias(FILE_PATH), *places)
    reason = F.coalesce(*reasons)
    found = [c for c in raw.columns if c != corrupt]
    line = F.to_json(F.struct(*found), {"ignoreNullFields": "false"})
    if fmt == "csv":
        line = F.coalesce(F.col(corrupt), line)
    return raw.select(
        *[typed[n].alias(n) for n in RETAIL_SCHEMA.names],
        order.alias(ROW_ORDER),
        reason.alias("reason"),
        F.when(reason.isNotNull(), line).alias("source"),
    )


def _checked(value: Column, have: T.DataType, want: T.DataType, timestamp_format: str | None) -> tuple[Column, Column]:
    """The value in its type, and whether it is NULL or fits exactly."""
    if have == want:
        return value, F.lit(True)
    if isinstance(have, T.StringType):
        text = F.trim(value)
        if isinstance(want, T.TimestampNTZType) and timestamp_format:
            cast = F.from_csv(text, "v timestamp_ntz", {"timestampNTZFormat": timestamp_format})["v"]
            return cast, value.isNull() | cast.isNotNull()
        if isinstance(want, T.TimestampNTZType):
            cast = text.try_cast(want)
            return cast, value.isNull() | cast.isNotNull()
        # A whole or decimal number fits if it is written as one and rounding changes nothing.
        wide = text.try_cast("decimal(38,18)")
        cast = wide.try_cast(want)
        return cast, value.isNull() | F.coalesce(cast.cast("decimal(38,18)") == wide, F.lit(False))
    cast = _converted(value, have, want)
    if cast is None:
        return F.lit(None).cast(want), value.isNull()
    return cast, cast.try_cast(have).eqNullSafe(value)
