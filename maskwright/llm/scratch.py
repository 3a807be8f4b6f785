"""Intermediate tables that every executor can read, and what is built on them.

Lineage is cut by writing a table under ``spark.checkpoint.dir`` of the
session, or the folder given to ``SparkContext.setCheckpointDir``. Where
neither is set, a local master (tests, a laptop) gets a folder of the
machine's temporary space; on a cluster, whose executors could not read each
other's part of it, that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_roots: dict[str, str] = {}
#: Attribute of a DataFrame that holds the place of the table it reads.
_PLACE = "_maskwright_table"


def scratch_root(spark: SparkSession) -> str:
    """The folder that holds this application's intermediate tables."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        _roots[app] = f"{_shared(spark).rstrip('/')}/tables-{uuid.uuid4().hex}"
        atexit.register(release, spark)
    return _roots[app]


def _shared(spark: SparkSession) -> str:
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given
    set_ = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_.isDefined():
        return set_.get()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="maskwright-")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, which hold whole texts: 1,000 rows and 16 MB at most."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application. Results that were not written yet are lost."""
    try:
        root = _roots.pop(spark.sparkContext.applicationId, None)
        if root:
            _delete(spark, root)
    except Exception:  # the JVM may be gone already when the interpreter ends
        return


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a reader of what was written (no lineage)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    setattr(out, _PLACE, path)
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete what ``materialize`` wrote, once nothing that is still to run reads it."""
    for table in tables:
        place = getattr(table, _PLACE, None)
        if place:
            _delete(table.sparkSession, place)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_running_totals(df: DataFrame, order: list[str], totals: dict[str, str], rank: str) -> DataFrame:
    """Add the 0-based global ``rank`` in ``order`` and, for each ``{new: column}``
    of ``totals``, the sum of that long column over all earlier rows.

    The rows are range-partitioned by ``order`` (add a unique last column, so
    that a hot key can be cut), summed inside each partition, and shifted by
    the totals of the partitions before it, a table with one row a partition.
    No window spans the table. Without ``totals`` no Python runs.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    if not totals:
        # the id counts the rows of a partition in its low 33 bits
        place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        done = materialize(ordered.withColumn(rank, place).withColumn("__part", F.spark_partition_id()).withColumn("__seen", F.col(rank) + 1), "running")
        return _shifted(done, df.columns, [rank], ["__seen"])
    fields = [*df.schema.fields]
    names = [f.name for f in fields]
    new = [rank, *totals]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
        + [f"`{n}` bigint" for n in new]
        + ["`__part` int", "`__seen` bigint"]
        + [f"`__sum_{i}` bigint" for i in range(len(totals))]
    )
    sources = list(totals.values())

    def local(batches):
        from pyspark import TaskContext

        part, seen, sums = TaskContext.get().partitionId(), 0, [0] * len(sources)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            out = [batch.column(batch.schema.get_field_index(c)) for c in names]
            out.append(pa.array(np.arange(seen, seen + n, dtype=np.int64)))
            seen += n
            tails = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, seen, np.int64))]
            for i, c in enumerate(sources):
                v = batch.column(batch.schema.get_field_index(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                run = np.cumsum(v) + sums[i]
                out.append(pa.array(run - v))
                sums[i] = int(run[-1])
                tails.append(pa.array(np.full(n, sums[i], np.int64)))
            yield pa.RecordBatch.from_arrays(
                [*out, *tails], names=[*names, *new, "__part", "__seen", *(f"__sum_{i}" for i in range(len(sources)))]
            )

    done = materialize(ordered.mapInArrow(local, schema), "running")
    return _shifted(done, names, new, ["__seen", *(f"__sum_{i}" for i in range(len(sources)))])


def _shifted(done: DataFrame, names: list[str], new: list[str], counters: list[str]) -> DataFrame:
    """Add the counters' final values of all partitions before a row's own to its running values."""
    parts = done.groupBy("__part").agg(*(F.max(c).alias(c) for c in counters))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before{c}") for c in counters))
    # One row for each partition: its size is bounded by the partition count, not by the data.
    return done.join(F.broadcast(parts), "__part").select(
        *(F.col(f"`{n}`") for n in names),
        *((F.col(f"`{n}`") + F.col(f"__before{c}")).alias(n) for n, c in zip(new, counters, strict=True)),
    )
