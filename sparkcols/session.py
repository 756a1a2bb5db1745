"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PARTITION_BYTES = 256 * 1024**2
DECODED_PER_STORED = 4


def build_session(app: str = "sparkcols", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and timestamps in UTC.

    Shuffle parallelism is left to the cluster's own setting or ``size_shuffles``.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # stored timestamps then carry minimum and maximum, so scans can skip by them
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, as its scans state them; no file is opened.

    A join's estimate is a product, so the scans below it are added up instead.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = (int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    # a source that can't state its size counts as an unknown, about 2^63 bytes
    return sum(size for size in sizes if size < 2**62)


def parts_for(df: DataFrame, least: int | None = None) -> int:
    """How many partitions an exchange of ``df`` needs: about 256 MB of decoded rows each, without an upper
    bound, and not fewer than ``least`` (the session's number of shuffle partitions)."""
    if least is None:
        least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, 1, -(-scan_bytes(df) * DECODED_PER_STORED // PARTITION_BYTES))


def size_shuffles(spark: SparkSession, stored_bytes: int) -> int:
    """Set the shuffle partitions for input of so many stored bytes, and return their number.

    Adaptive execution merges small partitions but cannot cut a large one in a
    range exchange, so the start value has to be large enough: about 256 MB of
    decoded rows each, and at least the session's parallelism.
    """
    wanted = -(-stored_bytes * DECODED_PER_STORED // PARTITION_BYTES)
    parts = max(spark.sparkContext.defaultParallelism, wanted)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    return parts


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A folder of our own is set only for a local session without one; on a
    cluster a missing setting is an error, because a machine's own temporary
    folder would be lost together with the machine.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sparkcols-"))
    return context.getCheckpointDir()


def new_table_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def new_table(spark: SparkSession, name: str) -> tuple[str, str]:
    """An unused table name and a fresh path for it."""
    path = new_table_path(spark, name)
    return path.rsplit("/", 1)[-1].replace("-", "_"), path


def staged(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This fixes values that a second evaluation could change (positions in a
    range partition), survives lost executors, and later reads are columnar.
    """
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.staged_path = path
    return table


def path_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def staged_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """Like ``staged``, as a table bucketed on ``key``: a later join on it moves only the other side.

    ``df`` comes dealt by ``key`` into so many partitions, so that a task writes one bucket.
    """
    spark = df.sparkSession
    label, path = new_table(spark, name)
    df.write.format("parquet").bucketBy(buckets, key).option("path", path).saveAsTable(label)
    table = spark.table(label)
    table.staged_path, table.staged_name = path, label
    return table


def release(*tables: DataFrame | None) -> None:
    """Delete staged tables. Call it once everything that reads them has itself been written: what is
    still lazy would fail, also when a lost executor makes it run again."""
    for table in tables:
        path = getattr(table, "staged_path", None)
        if path:
            spark = table.sparkSession
            if name := getattr(table, "staged_name", None):
                spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", args={"name": name})
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that nothing can read any more.

    It does so when the driver's garbage collector finds a shuffle unused, which
    on a large heap may be never; so that's asked for between long steps.
    """
    gc.collect()
    spark._jvm.System.gc()
