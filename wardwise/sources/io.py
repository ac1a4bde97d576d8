"""CSV result sources and sinks (S1, S2) and the memoised-stage helper."""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, path: str, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """Headered CSV read by column name; returns (rows, rejected).

    The header decides which column is which; columns that the schema does
    not name are left out, and one that is missing raises ``ValueError``. All
    files under ``path`` must have one header (Spark checks each). A record with
    too few or too many fields, or with a value that is not of its column's
    type, is rejected: ``record`` holds its fields as text and ``reasons`` why.
    """
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {', '.join(header)}")
    text = StructType([StructField(c, StringType()) for c in [*header, CORRUPT]])
    raw = (spark.read.schema(text).option("header", True).option("enforceSchema", False)
           .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    cells = {f.name: F.col(f"`{f.name}`") for f in schema.fields}
    values = {f.name: F.trim(cells[f.name]).try_cast(f.dataType) if not isinstance(f.dataType, StringType)
              else cells[f.name] for f in schema.fields}
    wrong = [F.when(cells[f.name].isNotNull() & values[f.name].isNull(), F.lit(f"{f.name}: not {f.dataType.simpleString()}"))
             for f in schema.fields]
    empty = [F.when(cells[f.name].isNull(), F.lit(f"{f.name}: empty")) for f in schema.fields if not f.nullable]
    reasons = F.when(F.col(CORRUPT).isNotNull(), F.array(F.lit("number of fields"))).otherwise(
        F.filter(F.array(*wrong, *empty), lambda r: r.isNotNull()))
    record = F.coalesce(F.col(CORRUPT), F.to_csv(F.struct(*[F.col(f"`{c}`") for c in header])))
    marked = raw.select(*[values[f.name].alias(f.name) for f in schema.fields], reasons.alias("_reasons"),
                        record.alias("_record"))
    rows = marked.where(F.size("_reasons") == 0).select(*[F.col(f"`{f.name}`") for f in schema.fields])
    rejected = marked.where(F.size("_reasons") > 0).select(F.col("_record").alias("record"),
                                                           F.col("_reasons").alias("reasons"))
    return rows, rejected


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame | None:
    """The accepted rows of a headered CSV; None (with a message) when it is absent."""
    try:
        return read_csv_checked(spark, path, schema)[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"no result table at {path}: run the job that writes it first")
        return None


def write_csv(df: DataFrame, path: str, single_file: bool = True) -> None:
    """Write a result table as headered CSV without an index.

    ``single_file`` coalesces to one part file and is meant for small
    result tables (summaries, audit lists); large outputs keep their
    partitioning. The table is written beside ``path`` and takes its place
    when it is whole: a failed write leaves the old table as it was.
    """
    out = df.coalesce(1) if single_file else df
    fresh = f"{path.rstrip('/')}-new-{uuid.uuid4().hex[:12]}"
    out.write.option("header", True).csv(fresh)
    context = df.sparkSession.sparkContext
    old, new = (context._jvm.org.apache.hadoop.fs.Path(p) for p in (path, fresh))
    files = old.getFileSystem(context._jsc.hadoopConfiguration())
    files.delete(old, True)
    if not files.rename(new, old):
        raise OSError(f"{fresh} is written but could not take the place of {path}")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and cut its lineage.

    Used for derived tables that several branches of one plan read (so the
    fact-table scan behind them runs once) and that must survive the loss
    of an executor (unlike ``persist`` or a local checkpoint). The folder is
    ``spark.checkpoint.dir`` (a shared location on a cluster).
    """
    from wardwise.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def memoise(df: DataFrame) -> DataFrame:
    """Keep a stage shared by several views (recomputed from lineage if lost)."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)
