"""S4 and S5 with several writers: versions of a workbook that are whole or not there.

A version is a folder ``<base>_modified_<n>`` with one dataset per table. Its number is
reserved by creating a marker file, which only one writer can do. The tables are then written
into the folder, and a manifest, renamed into place as the last step, commits them. Readers go
by manifests, so what a failed or unfinished writer left is never seen; its number is not
used again. Only file names and the manifest pass the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from tableops.sources.io import _fs, read_table

MANIFEST, RESERVED = "_manifest.json", "_reserved"


def created(spark: SparkSession, path: str) -> bool:
    """Create an empty file; False if somebody else has. Local file systems are asked
    directly, because Hadoop's own create looks first and writes then."""
    fs, p = _fs(spark, path)
    fs.mkdirs(p.getParent())
    if p.toUri().getScheme() in (None, "file") and fs.getUri().getScheme() == "file":
        return spark.sparkContext._jvm.java.io.File(p.toUri().getPath()).createNewFile()
    try:
        fs.create(p, False).close()
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def names_in(spark: SparkSession, directory: str) -> list[str]:
    fs, p = _fs(spark, directory)
    return [st.getPath().getName() for st in fs.listStatus(p)] if fs.exists(p) else []


def _number(name: str, base: str) -> int | None:
    found = re.fullmatch(re.escape(base) + r"_modified_([1-9][0-9]*)", name)
    return int(found[1]) if found else None


def reserve_version(spark: SparkSession, directory: str, base: str) -> str:
    """The path of a new version, which no other caller gets. Numbers rise; those of
    folders that stand there without a reservation are passed over."""
    directory = directory.rstrip("/")
    taken = names_in(spark, directory) + names_in(spark, f"{directory}/{RESERVED}")
    n = max((k for k in (_number(t, base) for t in taken) if k), default=0) + 1
    while not created(spark, f"{directory}/{RESERVED}/{base}_modified_{n}"):
        n += 1
    return f"{directory}/{base}_modified_{n}"


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole or not at all, by a rename."""
    fs, final = _fs(spark, path)
    _, draft = _fs(spark, f"{path}.{uuid.uuid4()}.draft")
    fs.mkdirs(final.getParent())
    out = fs.create(draft, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if not fs.rename(draft, final):
        raise OSError(f"cannot write {path}")


def read_small(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def committed(spark: SparkSession, path: str) -> dict | None:
    """The manifest of a committed folder, None if it is not committed."""
    text = read_small(spark, f"{path.rstrip('/')}/{MANIFEST}")
    return None if text is None else json.loads(text)


def save_version(tables: Mapping[str, DataFrame], name: str, df: DataFrame, directory: str,
                 base: str, fmt: str = "parquet") -> str:
    """Save a workbook as a new version, with table ``name`` replaced by ``df`` and every
    other one kept; its path. If a table fails, the error is raised and no version appears."""
    spark = df.sparkSession
    path = reserve_version(spark, directory, base)
    book = {**tables, name: df}
    for n, t in book.items():
        t.write.mode("errorifexists").format(fmt).save(f"{path}/{n}")
    write_small(spark, f"{path}/{MANIFEST}", json.dumps({"format": fmt, "tables": sorted(book)}, sort_keys=True))
    return path


def versions(spark: SparkSession, directory: str, base: str) -> list[str]:
    """Paths of the committed versions, the oldest number first."""
    directory = directory.rstrip("/")
    numbers = sorted(k for k in (_number(n, base) for n in names_in(spark, directory)) if k)
    paths = [f"{directory}/{base}_modified_{k}" for k in numbers]
    return [p for p in paths if committed(spark, p) is not None]


def read_version(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """S3: the tables of a committed version (lazy reads); an error if it is not committed."""
    manifest = committed(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no committed version at {path}")
    return {n: read_table(spark, f"{path.rstrip('/')}/{n}", manifest["format"]) for n in manifest["tables"]}
