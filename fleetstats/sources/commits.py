"""Tables that change as a whole: data are written beside, then one small commit file names them.

A folder has ``data``, of which nothing is changed once written, and ``commits``, one numbered JSON file each. A commit appears by a rename
that fails if its number is taken, so a reader sees the state before or after, never one between, and of two writers one
has to start again. What a stopped writer has left in ``data`` is named by no commit and so never read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _path(spark, f"{folder}/commits")
    names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())


def _read(spark: SparkSession, folder: str, number: int) -> dict:
    fs, at = _path(spark, f"{folder}/commits/{number:012d}.json")
    file = fs.open(at)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    finally:
        file.close()


def last_commit(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """Number and content of the last commit; -1 and nothing before the first."""
    numbers = _numbers(spark, folder)
    return (numbers[-1], _read(spark, folder, numbers[-1])) if numbers else (-1, {})


def commit(spark: SparkSession, folder: str, content: dict, after: int) -> int:
    """Make ``content`` the state that follows commit ``after``; an error if another one already does."""
    number = after + 1
    fs, made = _path(spark, f"{folder}/commits/.{uuid.uuid4().hex}")
    _, named = _path(spark, f"{folder}/commits/{number:012d}.json")
    file = fs.create(made, False)
    try:
        file.write(json.dumps(content).encode())
    finally:
        file.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(made).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(made), fs.makeQualified(named), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0))
    except Exception:
        fs.delete(made, False)
        raise
    return number


def new_path(folder: str) -> str:
    """Where a writer may put data of its own."""
    return f"{folder}/data/{uuid.uuid4().hex}"


#: A table that grows by small parts has so many of them merged into one.
MOST_PARTS = 32


def described(schema: StructType, paths: list[str]) -> dict:
    """A table as commits name it."""
    return {"schema": schema.jsonValue(), "paths": paths, "parts": []}


def opened(spark: SparkSession, table: dict | None, kind: str = "parquet") -> DataFrame:
    """The table that a commit describes."""
    if table is None:
        raise FileNotFoundError("no such table has been committed")
    schema, paths = StructType.fromJson(table["schema"]), [*table["paths"], *table["parts"]]
    return spark.read.format(kind).schema(schema).load(paths) if paths else spark.createDataFrame([], schema)


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _path(spark, path)
    return fs.exists(at)


def grown(spark: SparkSession, folder: str, table: dict, part: str, merge: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> dict:
    """``table`` with one more part; after MOST_PARTS of them these become one path, of the rows that ``merge`` makes of theirs."""
    table = table | {"parts": [*table["parts"], part]}
    if len(table["parts"]) < MOST_PARTS:
        return table
    path = new_path(folder)
    merge(opened(spark, table | {"paths": []})).write.parquet(path)
    return table | {"paths": [*table["paths"], path], "parts": []}


def replace_tables(spark: SparkSession, folder: str, tables: dict[str, DataFrame], kind: str = "parquet", partition_by: tuple[str, ...] = (), keep: int = 2, **options: str) -> None:
    """Write all ``tables`` and let them, together, take the place of what ``folder`` holds. The states before stay for readers, ``keep`` in all."""
    after, state = last_commit(spark, folder)
    written = {}
    for name, df in tables.items():
        path = new_path(folder)
        df.write.format(kind).options(**options).partitionBy(*partition_by).save(path)
        written[name] = described(df.schema, [path])
    commit(spark, folder, state | {"tables": written, "kind": kind}, after)
    clean(spark, folder, keep)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the last state of ``folder``."""
    _, state = last_commit(spark, folder)
    return opened(spark, state.get("tables", {}).get(name), state.get("kind", "parquet"))


def clean(spark: SparkSession, folder: str, keep: int = 2) -> None:
    """Delete data and commits that none of the last ``keep`` states needs. Only for folders with one writer, since data of a writer at work aren't named yet."""
    numbers = _numbers(spark, folder)
    texts = [json.dumps(_read(spark, folder, n)) for n in numbers[-keep:]]
    fs, data = _path(spark, f"{folder}/data")
    for f in fs.listStatus(data) if fs.exists(data) else []:
        if not any(f.getPath().getName() in t for t in texts):
            fs.delete(f.getPath(), True)
    for n in numbers[:-keep]:
        fs.delete(_path(spark, f"{folder}/commits/{n:012d}.json")[1], False)
