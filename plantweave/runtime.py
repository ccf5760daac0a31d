"""Session-level helpers shared by all operators: reading, cutting lineage, checked broadcasts."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a lookup side may have to be broadcast; above it the join is left to shuffle.
BROADCAST_ROWS = 100_000
#: Hot keys that are salted. The list of them is broadcast, so its length is fixed.
HOT_KEYS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else the context's checkpoint folder. Where neither is set
    a local master (tests) gets a temporary one; on a cluster that is an error, as executors don't share such folders."""
    named = spark.conf.get("spark.checkpoint.dir", None) or ""
    if not named:
        context = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context.isDefined():
            named = context.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            named = os.path.join(tempfile.gettempdir(), "plantweave-shared")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at ``path``, in whatever file system it names."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table on shared storage and read it from there, so that lost executors cost no
    recomputation. The table is deleted by ``keep_only`` or when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plantweave-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _WRITTEN:
        atexit.register(_delete_written)
    _WRITTEN.append((spark, path))
    _own_tables().append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_table"] = path
    return out


def _own_tables() -> list[str]:
    """Paths of the tables that this thread has written and not yet deleted."""
    if not hasattr(_LOCAL, "tables"):
        _LOCAL.tables = []
    return _LOCAL.tables


def tables_written() -> int:
    """How many tables of this thread there are: a mark for ``keep_only``."""
    return len(_own_tables())


def keep_only(mark: int, *kept: DataFrame) -> None:
    """Delete the tables this thread has cut since ``mark``, but those of ``kept``, from which alone the caller goes on. The
    driver's garbage is collected, as shuffle files go with the plans that made them."""
    tables = _own_tables()
    stay = {df.__dict__.get("_table") for df in kept}
    gone = {p for p in tables[mark:] if p not in stay}
    for spark, path in [x for x in _WRITTEN if x[1] in gone]:
        _delete(spark, path)
        _WRITTEN.remove((spark, path))
    for df in kept[:1]:
        df.sparkSession._jvm.System.gc()
    tables[mark:] = [p for p in tables[mark:] if p in stay]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_WRITTEN: list[tuple[SparkSession, str]] = []
_LOCAL = threading.local()


def _delete_written() -> None:
    for spark, path in _WRITTEN:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; the cluster's own clean-up is left
            return


def once(c: Column) -> Column:
    """``c``, computed once a row. The optimizer copies a column's expression into every filter on it that it pushes
    down, and into each copy again the columns below; the guard, which always holds but counts as nondeterministic,
    keeps dear expressions out of that."""
    return F.when(F.monotonically_increasing_id() >= 0, c)


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only after counting: ``df`` comes back unhinted if it has over ``max_rows`` rows."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def hot_keys(df: DataFrame, key: str, rows_per_salt: int) -> DataFrame:
    """(key, salts): the at most HOT_KEYS most frequent keys that exceed ``rows_per_salt`` rows, and into how
    many parts each is to be split. Counts are combined before the shuffle. A key beyond the list holds less than
    1/HOT_KEYS of all rows, so it can't dominate a task."""
    return (
        df.groupBy(key)
        .agg(F.count(F.lit(1)).alias("__n"))
        .filter(F.col("__n") > rows_per_salt)
        .orderBy(F.desc("__n"), key)
        .limit(HOT_KEYS)
        .select(key, F.ceil(F.col("__n") / rows_per_salt).cast("int").alias("__salts"))
    )


def salted(build: DataFrame, probe: DataFrame, key: str, spread_by: str, rows_per_salt: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of an equi-join on ``key`` with a column ``__salt`` to join on as well.

    Rows of ``build`` with a hot key are spread over its salts by a hash of ``spread_by``; rows of ``probe`` with a
    hot key are repeated once per salt. Joining on (key, __salt) gives the rows of joining on key.
    """
    hot = F.broadcast(hot_keys(build, key, rows_per_salt))
    n = F.coalesce("__salts", F.lit(1))
    b = build.join(hot, key, "left").withColumn("__salt", F.pmod(F.xxhash64(spread_by), n).cast("int")).drop("__salts")
    p = probe.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("__salts")
    return b, p
