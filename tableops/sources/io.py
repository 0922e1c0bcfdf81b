"""Reading and writing tables and workbooks.

A *workbook* is a directory holding one dataset per *table* (the reference's sheets);
it is read as ``dict[name, DataFrame]`` and saved by writing every table to a new
directory, never over the input.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.functions.exprs import FLOATING, TEMPORAL, as_list

_FORMATS = ("parquet", "csv", "json", "orc")


def _nan_to_null(df: DataFrame) -> DataFrame:
    repl = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType))
            for f in df.schema.fields if isinstance(f.dataType, FLOATING)}
    return df.withColumns(repl) if repl else df


def read_table(spark: SparkSession, path: str, fmt: str = "parquet",
               nan_to_null: bool | None = None, schema=None, **options) -> DataFrame:
    """Read one table.

    ``nan_to_null`` turns float NaN into NULL, the pandas reading of a missing cell.
    It defaults to on for text formats (csv/json, where ``NaN`` is how a spreadsheet
    export spells a blank) and off for Parquet/ORC, whose NaN is a real value; the
    projection it adds hides the raw column from Parquet filter pushdown.

    Text formats infer column types like pandas does, which costs an extra pass over
    the input; pass ``schema`` (a StructType or DDL string) to skip it on large data.
    """
    if fmt not in _FORMATS:
        raise ValueError(f"format {fmt!r} not in {_FORMATS}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        options = {"header": "true", "inferSchema": "false" if schema is not None else "true",
                   **options}
    df = reader.options(**options).load(path)
    if nan_to_null is None:
        nan_to_null = fmt in ("csv", "json")
    return _nan_to_null(df) if nan_to_null else df


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def list_tables(spark: SparkSession, directory: str) -> list[str]:
    """Names of the datasets in a workbook directory (files or sub-directories,
    extension dropped, hidden and ``_``-prefixed entries skipped), sorted."""
    fs, p = _fs(spark, directory)
    names = []
    for st in fs.listStatus(p):
        n = st.getPath().getName()
        if n.startswith((".", "_")):
            continue
        names.append(re.sub(r"\.(parquet|csv|json|orc)$", "", n))
    return sorted(set(names))


def read_workbook(spark: SparkSession, directory: str, fmt: str = "parquet",
                  names: Sequence[str] | None = None, **options) -> dict[str, DataFrame]:
    """S3: every table of a workbook directory, keyed by name (lazy reads)."""
    fs, p = _fs(spark, directory)
    out = {}
    for n in names or list_tables(spark, directory):
        path = f"{directory.rstrip('/')}/{n}"
        if not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
            path = f"{path}.{fmt}"
        out[n] = read_table(spark, path, fmt, **options)
    return out


def write_workbook(tables: Mapping[str, DataFrame], name: str, df: DataFrame,
                   out_dir: str, fmt: str = "parquet", source_dir: str | None = None) -> dict[str, str]:
    """Save a workbook with table ``name`` replaced by ``df`` and every other table
    kept. Writes with ``errorifexists``: the input is never overwritten."""
    if source_dir and source_dir.rstrip("/") == out_dir.rstrip("/"):
        raise ValueError("refusing to overwrite the input workbook")
    paths = {}
    for n, t in {**tables, name: df}.items():
        path = f"{out_dir.rstrip('/')}/{n}"
        t.write.mode("errorifexists").format(fmt).save(path)
        paths[n] = path
    return paths


def next_output(spark: SparkSession, directory: str, base: str) -> str:
    """First free ``<base>_modified_<n>`` (n = 1, 2, ...) in ``directory``."""
    fs, p = _fs(spark, directory)
    taken = set()
    if fs.exists(p):
        taken = {st.getPath().getName() for st in fs.listStatus(p)}
    n = 1
    while f"{base}_modified_{n}" in taken:
        n += 1
    return f"{directory.rstrip('/')}/{base}_modified_{n}"


def preview(df: DataFrame, order_by: Sequence[str | Column], n: int = 10) -> DataFrame:
    """The first ``n`` rows in an explicit order (TakeOrderedAndProject: each task
    keeps its own top ``n``, the driver merges ``n`` per task)."""
    cols = [F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in as_list(order_by)]
    return df.orderBy(*cols).limit(n)


def json_rows(df: DataFrame, out: str = "json",
              timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> DataFrame:
    """Each row as one JSON object text. Keys are the column names, timestamps
    are text in ``timestamp_format``, NaN and NULL become ``null`` (nulls kept)."""
    fields = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, TEMPORAL):
            c = F.date_format(c, timestamp_format)
        elif isinstance(f.dataType, FLOATING):
            c = F.nanvl(c, F.lit(None).cast(f.dataType))
        fields.append(c.alias(str(f.name)))
    return df.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(out))
