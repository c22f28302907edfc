"""What the corpus operators share: table access, scratch tables and sizing."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words and the words themselves, in every operator.
WHITE = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A key with more rows than this, or than an average task gets, is hot; below LEAST_HOT it never is.
TASK_ROWS, LEAST_HOT = 1_000_000, 500
#: Keys that one broadcast may hold: a key and a few numbers each, well under 100 MB.
BROADCAST_KEYS = 1_000_000

_own_dirs: dict[str, str] = {}
#: Scratch paths of each application, in the order of their making.
_made: dict[str, list[str]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables, read by Spark from wherever ``sf_dir`` points."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (a test) gets a folder of its own; on a
    cluster its absence is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="spark-jobloom-")
    return _own_dirs[app]


def scratch_paths(spark: SparkSession) -> list[str]:
    """The scratch paths made by this session so far."""
    return _made.setdefault(spark.sparkContext.applicationId, [])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark)}/jobloom/{name}-{uuid.uuid4().hex}"
    scratch_paths(spark).append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it back.

    Cuts the lineage, so that a lost executor costs one stage and not the plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_scratch(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Deletes scratch tables of this session, all or some; nothing may read them any more."""
    made = scratch_paths(spark)
    for name in list(made if paths is None else paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        made.remove(name)


def hot_rows(spark: SparkSession, total: int) -> int:
    """Rows from which a key of a table of ``total`` rows is hot: the share of an average shuffle task, within fixed bounds.

    A table has at most max(shuffle partitions, total / TASK_ROWS) hot keys.
    """
    return max(LEAST_HOT, min(TASK_ROWS, math.ceil(total / int(spark.conf.get("spark.sql.shuffle.partitions")))))


def hot_keys(per_key: DataFrame, key: list[str], n: str, limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, if there are any and a broadcast may hold them.

    ``per_key``: a written table with each key once and in ``n`` how many rows have it.
    """
    hot = per_key.where(F.col(n) > limit).select(*key)
    return hot if 0 < hot.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else None


def split_join(rows: DataFrame, per_key: DataFrame, key: list[str], hot: DataFrame | None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, which holds each key once.

    Rows of ``hot`` keys stay where they are and meet a broadcast of these keys' rows; only the
    others are shuffled, so no task gets all rows of a hot key. Without a list of hot keys all
    rows are shuffled, and Spark splits skewed partitions.
    """
    if hot is None:
        return rows.join(per_key, key)
    part = lambda df, how: df.join(F.broadcast(hot), key, how)
    return part(rows, "left_semi").join(F.broadcast(part(per_key, "left_semi")), key).unionByName(part(rows, "left_anti").join(part(per_key, "left_anti"), key))


def importable(spark: SparkSession) -> None:
    """Lets local Python workers import this package when the driver's cwd is elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)


def input_partitions(df: DataFrame) -> int:
    """Scan partitions of ``df``: a measure of its bytes that grows with the input."""
    return max(1, df.rdd.getNumPartitions())


def shuffle_width(df: DataFrame, per_input: float = 1.0) -> int:
    """Partitions for a shuffle whose bytes are ``per_input`` times those of the scan of ``df``."""
    floor = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(floor, math.ceil(per_input * input_partitions(df)))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def words_of(col: Column) -> Column:
    """Array of words; ``split`` with a filter, as a text may start or end with white space."""
    return F.filter(F.split(col, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that clash with none of ``df``'s columns."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
