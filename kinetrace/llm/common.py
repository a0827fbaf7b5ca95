"""Helpers shared by the operators: tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Internal columns start with this, so that they clash with no column of the caller.
P = "__kt_"
#: A null id counts as the largest; an id of this very number counts as null.
NULL_ID = 9223372036854775807
#: At most this many groups are ever broadcast by ``join_groups``; a row of them has some 100 bytes.
MAX_HEAVY = 1 << 17
#: Groups up to this size are never broadcast.
LIGHT = 256

BATCH_BYTES = 4 << 20

_own_dirs: dict[str, str] = {}
_made: list[str] = []
_at_exit: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only where none is set and one machine does all."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="kinetrace-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return "file://" + _own_dirs[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which ``tables`` deletes with the other tables made meanwhile."""
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/kinetrace-{app}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append(path)
    if app not in _at_exit:  # results may read tables to the end of the session
        _at_exit.add(app)
        atexit.register(release, spark)
    return path


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as a table of the shared folder and read it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kinetrace_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_stored(*tables_: DataFrame) -> None:
    """Delete tables made by ``stored`` once nothing reads them any more."""
    for df in tables_:
        if (path := df._kinetrace_path) in _made:
            _made.remove(path)
            _delete(df.sparkSession, path)


@contextmanager
def tables(spark: SparkSession) -> Iterator[Callable]:
    """Deletes the tables made within, but for those that the yielded function is given (a table or a path).

    A result that is still to be computed keeps what it reads. After an error everything goes.
    """
    before, kept = len(_made), set()
    try:
        yield lambda *x: kept.update(getattr(t, "_kinetrace_path", t) for t in x)
    except BaseException:
        kept.clear()
        raise
    finally:
        for path in [p for p in _made[before:] if p not in kept]:
            _made.remove(path)
            with suppress(Exception):  # a folder that can't be deleted is no reason to lose a result
                _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Delete every table this session left in the shared folder; results not yet written become unreadable."""
    with suppress(Exception):  # a session that has ended
        app = spark.sparkContext.applicationId
        _made[:] = [p for p in _made if f"/kinetrace-{app}/" not in p]
        _delete(spark, f"{shared_dir(spark)}/kinetrace-{app}")


def bounded_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES``: by default they hold up to 64 MB of text, several times a task.

    It is a setting of the session and only lowers what is there.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(64 << 20))).rstrip("b")) not in range(1, BATCH_BYTES + 1):
        spark.conf.set(key, str(BATCH_BYTES))


def trim() -> None:
    """Give memory that Arrow and the C library hold for later back to the system; a driver lives long."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What a worker remembers from task to task for one operator; what it holds for others goes first.

    Workers outlive tasks and serve all operators in turn, so one operator's memory is not to burden the next.
    """
    others = [k for k in _caches if k != owner]
    if others:
        for k in others:
            _caches.pop(k).clear()
        trim()
    return _caches.setdefault(owner, {})


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_or_last(c: str | Column) -> Column:
    """A bigint id for comparisons; null counts as the largest."""
    return F.coalesce((F.col(c) if isinstance(c, str) else c).cast("bigint"), F.lit(NULL_ID))


def text_of(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Attach one row of ``groups`` to each of the rows that share its key, however large the group.

    Groups of over ``total / MAX_HEAVY`` rows number at most ``MAX_HEAVY``, whatever the input: those are
    broadcast, so their rows stay where they are. All others are a 131072th of the rows at most, or ``LIGHT``
    rows, and meet in a shuffle.
    ``rows`` must have at most ``total`` rows; ``groups`` has one row a key with its size in ``count``.
    """
    least = max(total // MAX_HEAVY, LIGHT)
    heavy = groups.where(F.col(count) > least)
    light = groups.where(F.col(count) <= least)
    flag = heavy.select(*keys, F.lit(True).alias(P + "heavy"))
    marked = rows.join(F.broadcast(flag), keys, "left")
    hot = marked.where(F.col(P + "heavy")).drop(P + "heavy").join(F.broadcast(heavy), keys)
    cold = marked.where(F.col(P + "heavy").isNull()).drop(P + "heavy").join(light, keys, how)
    return hot.unionByName(cold)
