"""CSV source and sink with R ``read.csv`` / ``write.csv`` conventions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructType

from driftline.functions.numeric import nan_to_null, short_decimal
from driftline.operators.ordering import number_rows
from driftline.session import scratch_path

MISSING = "NA"


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None,
             missing: str = MISSING, order_col: str | None = None, line_breaks: bool = True) -> DataFrame:
    """Header CSV; ``NA``, NaN and unquoted blanks are missing.

    ``schema`` must list every column of the file in file order (Spark applies
    it by position). Without one, types are inferred in one extra pass over the
    file and columns are named from the header, which suits wide survey files.
    A quoted empty string stays an empty string, so blank text tests must
    accept both (``driftline.operators.quality.is_blank``). As in the method's
    own reader, text that spells the missing marker is missing, quoted or not.

    Quotes inside quoted text are doubled; a backslash is a plain character.
    ``line_breaks`` says that quoted text may hold line breaks: each file is
    then one task's work. Without, large files are split among tasks.

    ``order_col`` adds a column that orders rows as the files hold them: by
    file path, then position in the file (see :func:`with_file_order`). Such a
    table is parsed once and kept as Parquet under the shared checkpoint folder:
    a position is a fact of the scan that counted it, and every later pass,
    however it is split, must see the same one (it also reads its columns only).
    """
    reader = (spark.read.option("header", True).option("nullValue", missing).option("mode", "FAILFAST")
                   .option("escape", '"').option("lineSep", "\n").option("multiLine", line_breaks))
    raw = reader.option("inferSchema", True).csv(path) if schema is None else reader.schema(schema).csv(path)
    if order_col:
        raw = with_file_order(raw, order_col)
    out = raw.select(*[nan_to_null(_quoted(f.name)).alias(f.name)
                       if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(_quoted(f.name))
                       for f in raw.schema.fields])
    if not order_col:
        return out
    kept = scratch_path(spark, "csv")
    out.write.parquet(kept)
    return spark.read.parquet(kept)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def with_file_order(df: DataFrame, name: str = "_row") -> DataFrame:
    """Add a sortable source position for "first row" picks to a frame just read.

    A struct of file path, block start and position: blocks of a file are in
    file order, and a task numbers the rows of a block as it reads them. Files
    are ordered by path, whichever task reads them first. The order holds in
    every scan, the numbers in one: store the table before reading it twice.
    """
    return df.withColumn(name, F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("position")))


def _field(col: str, kind, missing: str) -> Column:
    """One field as text: strings quoted, numbers bare, missing values bare."""
    x = F.col(_quoted(col))
    if isinstance(kind, StringType):
        text = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    elif isinstance(kind, (DoubleType, FloatType)):
        text = short_decimal(x)
    else:
        text = x.cast("string")
    return F.coalesce(text, F.lit(missing))


def write_csv(df: DataFrame, path: str, row_names: bool = True,
              order: Sequence[Column] | None = None, missing: str = MISSING) -> None:
    """Write a CSV directory as R does: header and text quoted, numbers and ``NA`` bare.

    ``row_names`` adds a leading column of quoted row numbers 1..n without a
    name. Rows keep the order of ``df``, or follow ``order``; every part file
    starts with the header, and a table without rows is the header alone.
    Numbers are in the method's form: at most 15 significant digits, fixed or
    scientific, whichever is shorter.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = [_field(c, k, missing) for c, k in kinds.items()]
    names = ['"' + c.replace('"', '""') + '"' for c in kinds]
    if row_names:
        marked = df.withColumn("__place", F.monotonically_increasing_id())
        out = number_rows(marked, order or [F.col("__place")], "__row").orderBy("__row")
        fields, names = [F.concat(F.lit('"'), F.col("__row").cast("string"), F.lit('"')), *fields], ['""', *names]
    else:
        out = df.orderBy(*order) if order else df
    header = ",".join(names)
    # the text sink adds nothing of its own; a part file's first record brings the header
    lines = out.select(F.concat_ws(",", *fields).alias("line"))
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    lines = lines.select(F.when(first, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line")).alias("line"))
    if df.isEmpty():
        lines = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("line"))
    lines.write.mode("errorifexists").option("lineSep", "\n").text(path)
