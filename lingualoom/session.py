"""Session set-up and the few helpers that touch the cluster's shared state."""

from __future__ import annotations

import atexit
import io
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "lingualoom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the engine expects; anything in ``conf`` (dots as ``__``) overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        # Stages here do much work per byte: small partitions are joined only as far as all cores stay busy.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors see: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, local mode) an own temporary folder is made and registered.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        folder = tempfile.mkdtemp(prefix="lingualoom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set(CHECKPOINT_KEY, root)
    return root


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone already
        pass


def ship_package(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once per context, as a zip in the shared folder.

    Where they can import it anyhow this changes nothing.
    """
    context = spark.sparkContext
    if getattr(context, "_lingualoom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = f"{shared_folder(spark)}/code/lingualoom-{uuid.uuid4().hex}.zip"
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(context._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    context.addPyFile(path)
    context._lingualoom_shipped = True
    atexit.register(_remove, spark, path)


def own_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets; what is written there goes at exit."""
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back; cuts lineage and survives lost executors.

    Every call has a folder of its own, as earlier results may still be read; all of them go at exit.
    """
    spark = df.sparkSession
    path = own_folder(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Most bytes of a broadcast side.
MAX_BROADCAST = 64 << 20


def _fits(df: DataFrame, max_rows: int, size: Column | None) -> bool:
    if size is None:
        return df.limit(max_rows + 1).count() <= max_rows
    row = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return row.n <= max_rows and row.bytes <= MAX_BROADCAST


def bounded_broadcast(df: DataFrame, max_rows: int, size: Column | None = None) -> DataFrame:
    """Broadcast hint, given only after a count proved at most ``max_rows`` rows; else ``df`` as it is.

    Rows that hold arrays or long strings need ``size``, their bytes, which are added up and held against ``MAX_BROADCAST``.
    """
    return F.broadcast(df) if _fits(df, max_rows, size) else df


def lookup_join(big: DataFrame, small: DataFrame, key: str | list[str], max_rows: int, size: Column, how: str = "inner", parts: int = 64) -> DataFrame:
    """``big`` joined with ``small``, which has a row per ``key``: by broadcast if that is small enough, else shuffled with each key of ``big`` spread over ``parts``.

    So a key that holds a third of all rows is no single task, whatever the size of the other side.
    """
    if _fits(small, max_rows, size):
        return big.join(F.broadcast(small), key, how)
    spread = big.withColumn("_part", F.pmod(F.xxhash64(*big.columns), F.lit(parts)).cast("int"))
    copies = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = [key] if isinstance(key, str) else key
    return spread.join(copies, [*keys, "_part"], how).drop("_part")
