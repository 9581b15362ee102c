"""Spark helpers of the operators: inputs, checkpoints, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storepulse.session import scratch_path

DOC = "doc_id"
BATCH_BYTES = 4 << 20
PER_TASK = 4 << 20  # compressed bytes of links for each task of a round of ``components``


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for an application, whatever folder the driver was started in.
    Spark serves the archive from the driver, whose copy lives as long as its process."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="storepulse-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    shutil.copytree(package, os.path.join(folder, "code", "storepulse"), ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(os.path.join(folder, "storepulse"), "zip", os.path.join(folder, "code")))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``docs`` has (in any case)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """The id and text columns alone; other columns of ``docs``, whatever their names, are left out.

    Texts go to Python in batches of at most ``BATCH_BYTES``, so that a task's memory is bounded.
    """
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return docs.select(F.col(DOC).cast("long").alias(DOC), F.col("text").cast("string").alias("text"), *more)


def saved(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there,
    so a lost executor costs no recomputation, and it is computed once. ``tasks`` bounds
    the files written."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    (df if tasks is None else df.coalesce(tasks)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def freed(*written: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more, and of the shuffles that made them: Spark deletes those
    of a plan that is out of use when the driver collects its garbage, which may be long after."""
    for df in written:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    written[0].sparkSession._jvm.System.gc()


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` written to the shared folder in ``buckets`` by ``key`` and read back as a table: joins on the key
    move only the other side. ``dropped`` takes the table's name out of the catalogue again."""
    spark = df.sparkSession
    ship(spark)
    path = scratch_path(spark, name)
    called = os.path.basename(path).replace("-", "_")
    (df.repartition(buckets, key).write.option("path", path).bucketBy(buckets, key).sortBy(key).saveAsTable(called))
    out = spark.table(called)
    out.called = called
    return out


def dropped(df: DataFrame) -> None:
    df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.called}")


@contextlib.contextmanager
def filtered_joins(spark: SparkSession):
    """Within it, a shuffled join of a scan with a smaller side sends a Bloom filter of that side's keys (of bounded size) to the
    scan first, also where the scan is smaller than Spark's own threshold; the session's settings are put back."""
    wanted = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": str(1 << 30)}
    names = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def stored_bytes(df: DataFrame) -> int:
    """Size of the files of a written table, from the file system."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    fs = path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(path).getLength())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges``, for every node of an edge.

    Each round sends every node to its smallest neighbour, follows the pointers
    once more and contracts the edges, so the edges shrink until none is left. Rounds are
    written tables: their sizes, not estimates that multiply, plan the next round.
    Self loops and repeated edges are allowed; null ends are dropped.
    """
    edges = (edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
             .where("u is not null and v is not null"))
    # edges only shrink: as many tasks as the first ones need
    first = saved(edges, "links")
    edges, tasks = first, 1 + stored_bytes(first) // PER_TASK
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    label = nodes.select("node", F.col("node").alias("component"))
    left = saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                 .where("u < v").distinct(), "edges", tasks)
    while not left.isEmpty():
        # smallest neighbour of each remaining node; v always has one below it
        parent = left.groupBy("v").agg(F.min("u").alias("p"))
        # a node without a smaller neighbour is a root; pointers only go down
        up = parent.withColumnRenamed("v", "w").withColumnRenamed("p", "q")
        jump = saved(parent.join(up, parent.p == up.w, "left")
                     .select(F.col("v").alias("was"), F.coalesce("q", "p").alias("now")), "jumps", tasks)
        label = saved(label.join(jump, label.component == jump.was, "left")
                      .select("node", F.coalesce("now", "component").alias("component")), "labels", tasks)
        first, second = jump.select(F.col("was").alias("u"), F.col("now").alias("nu")), jump.select(
            F.col("was").alias("v"), F.col("now").alias("nv"))
        moved = (left.join(first, "u", "left").join(second, "v", "left")
                 .select(F.coalesce("nu", "u").alias("x"), F.coalesce("nv", "v").alias("y")))
        left = saved(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v"))
                     .where("u < v").distinct(), "edges", tasks)
    return label
