"""CSV to Parquet tables, table profiles and views for plain SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from periodica.sources.staging import fresh_folder

#: header names of row-number columns that an export left behind (fixed pattern)
ARTIFACT = re.compile(r"^(Unnamed.*|_c\d+)$")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A CSV file or folder with a header row, without export artifacts.

    Only the header is read up front. Declared columns are matched by name and cast, text that
    does not fit becomes NULL; other columns stay text.
    """
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    declared = {f.name: f.dataType for f in schema} if schema is not None else {}
    kept = [c for c in raw.columns if not ARTIFACT.match(c)]
    missing = sorted(set(declared) - set(kept))
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")

    def typed(name: str):
        column = F.col(f"`{name}`")
        if name not in declared:
            return column
        value = column.try_cast(declared[name])
        # "NaN" in a number column is a missing value, not a number that sorts above all others
        return F.nullif(value, F.lit(float("nan"))) if declared[name] == T.DoubleType() else value

    return raw.select(*[typed(c).alias(c) for c in kept])


#: the file of a table that names its present version
POINTER = "_current"


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace the table at ``path``: write a new version, then point to it.

    Until the pointer has moved, readers find the old version whole, also when the job that writes
    is lost; so a table can be replaced from itself. The version before stays for those who read it
    now, older ones and what lost jobs left go. One writer at a time.

    With ``partition_by`` the rows are rebalanced first: small partitions of a value merge and an
    oversized one is split, so a hot value costs neither one huge file nor thousands of tiny ones.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    before = current_version(spark, path)
    if partition_by is None:
        df.write.parquet(f"{path}/{version}")
    else:
        balanced = df.hint("rebalance", partition_by)
        balanced.write.partitionBy(partition_by).parquet(f"{path}/{version}")
    fs, folder = _file_system(spark, path)
    _point(spark, path, version)
    for status in fs.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(status.getPath(), True)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The present version of the table that ``write_table`` put at ``path``."""
    version = current_version(spark, path)
    if version is None:
        raise ValueError(f"no table at {path}")
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{path}/{version}")


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder below ``path`` that is the table now; None where there is none."""
    fs, folder = _file_system(spark, path)
    jvm = spark._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(folder, POINTER)
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Write the pointer beside the old one and put it in its place in one step."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs, folder = _file_system(spark, path)
    new = hadoop.Path(folder, f"{POINTER}-{version}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.OVERWRITE
    context = hadoop.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(
        context.makeQualified(new), context.makeQualified(hadoop.Path(folder, POINTER)), options
    )


def load_tables(
    spark: SparkSession,
    files: Mapping[str, str],
    target: str,
    schemas: Mapping[str, T.StructType | None],
    partition_by: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Load each CSV into a Parquet table below ``target`` and return the stored tables."""
    loaded = {}
    for name, path in files.items():
        table = read_csv(spark, path, schemas.get(name))
        write_table(table, f"{target}/{name}", (partition_by or {}).get(name))
        loaded[name] = read_table(spark, f"{target}/{name}", table.schema)
    return loaded


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows, number of columns and column names of each table."""

    def one(name: str, df: DataFrame) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(name).alias("table_name"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.lit(", ".join(sorted(df.columns))).alias("columns"),
        )

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables known to ``spark.sql`` under their names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def list_tables(spark: SparkSession) -> list[str]:
    """Names that ``spark.sql`` can read in this session."""
    return sorted(t.name for t in spark.catalog.listTables())


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder below the one the cluster shares between its machines."""
    return fresh_folder(spark, "tables")
