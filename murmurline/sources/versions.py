"""Keyed tables as numbered parts: a write becomes visible with one marker file, wholly or not at all.

A table at ``path`` holds data folders ``p0000000001``, ... and, under ``_committed``, one empty marker for each part that
counts, named by its number and kind: ``whole`` replaces all before it, ``more`` adds to them.  The state is the last whole
part and what was added since.  A marker is made by renaming a finished file to a name that is not there yet, so a
writer that stops at any step leaves the old or the new state, never none and never half of one.  Parts that no longer
count are deleted only after the state after next is there, as running readers may still need them.  One writer at a
time is assumed.

A folder of plain parquet files without markers is read as it stands; it becomes the first part with the first write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MARKERS, WHOLE, MORE = "_committed", "whole", "more"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Hadoop path) of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _names(fs, at) -> list[str]:
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def committed(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, kind) of every marker, in order."""
    fs, at = file_system(spark, f"{path}/{MARKERS}")
    split = [n.split(".") for n in _names(fs, at) if not n.startswith(".")]
    return sorted((int(number), kind) for number, kind in split)


def _part(path: str, number: int) -> str:
    return f"{path}/p{number:010d}"


def _plain(spark: SparkSession, path: str) -> bool:
    fs, at = file_system(spark, path)
    return any(n.endswith(".parquet") or ("=" in n and not n.startswith("_")) for n in _names(fs, at))


def data_paths(spark: SparkSession, path: str) -> list[str]:
    """The folders that together are the table; none if there is no table."""
    parts = committed(spark, path)
    if not parts:
        return [path] if _plain(spark, path) else []
    first = max((n for n, kind in parts if kind == WHOLE), default=0)
    held = [_part(path, n) for n, _ in parts if n >= first]
    return held if first else ([path] if _plain(spark, path) else []) + held


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The current state, empty without one."""
    paths = data_paths(spark, path)
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, kind: str) -> int:
    spark = rows.sparkSession
    number = max((n for n, _ in committed(spark, path)), default=0) + 1
    rows.write.mode("overwrite").parquet(_part(path, number))
    commit(spark, path, number, kind)
    return number


def append_rows(rows: DataFrame, path: str) -> int:
    """Adds rows to the table; returns the number of the part."""
    return _write(rows, path, MORE)


def swap_table(state: DataFrame, path: str) -> int:
    """Makes ``state``, which may read the table itself, the table; returns the number of the part."""
    number = _write(state, path, WHOLE)
    clean(state.sparkSession, path)
    return number


def commit(spark: SparkSession, path: str, number: int, kind: str) -> None:
    """Sets the marker that makes a finished part count."""
    fs, markers = file_system(spark, f"{path}/{MARKERS}")
    fs.mkdirs(markers)
    new = spark._jvm.org.apache.hadoop.fs.Path
    staged, marker = new(markers, f".{number:010d}"), new(markers, f"{number:010d}.{kind}")
    fs.create(staged, True).close()
    if not fs.rename(staged, marker):
        raise RuntimeError(f"part {number} of {path} could not be committed")


def clean(spark: SparkSession, path: str) -> None:
    """Deletes the parts that neither the current state nor the one before its last whole part needs."""
    parts = committed(spark, path)
    wholes = [n for n, kind in parts if kind == WHOLE]
    if not wholes:
        return
    keep_from = wholes[-2] if len(wholes) > 1 else 0
    fs, root = file_system(spark, path)
    new = spark._jvm.org.apache.hadoop.fs.Path
    known = {n for n, _ in parts}
    for name in _names(fs, root):
        number = int(name[1:]) if name.startswith("p") and name[1:].isdigit() else None
        old_plain = len(wholes) > 1 and (name.endswith((".parquet", ".parquet.crc")) or name == "_SUCCESS")
        if old_plain or (number is not None and (number < keep_from or (number not in known and number <= max(known)))):
            fs.delete(new(root, name), True)
    for number, kind in parts:
        if number < keep_from:
            fs.delete(new(root, f"{MARKERS}/{number:010d}.{kind}"), False)
