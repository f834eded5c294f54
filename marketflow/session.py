"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession

# Settings every job wants; cluster-specific sizes come from the submitter.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, app_name: str = "marketflow",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the library's defaults.

    ``master`` and ``shuffle_partitions`` are only set when given, so a
    cluster submit keeps its own values.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in _DEFAULTS.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared folder there.  Only when nothing is set and the
    driver runs everything itself (local tests) a folder under the system temp
    dir is chosen; a cluster without the setting is an error, since its nodes
    would not see each other's files.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder shared by all nodes of {master}")
        import tempfile
        d = os.path.join(tempfile.gettempdir(), "marketflow-checkpoints")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


#: Scratch paths handed out by this process, oldest first.
SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    SCRATCH.append(f"{base}/marketflow/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}")
    return SCRATCH[-1]


def drop_scratch(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that no result still to be computed reads."""
    for path in paths:
        fs, hpath = _file_system(spark, path)
        fs.delete(hpath, True)
        if path in SCRATCH:
            SCRATCH.remove(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any file system Spark reads.  Errors other
    than a missing path are raised."""
    fs, hpath = _file_system(spark, path)
    return bool(fs.exists(hpath))


def create_exclusive(spark: SparkSession, path: str) -> bool:
    """Create an empty file unless it exists; False if somebody else had it
    first.  The file system decides, so of two callers only one gets True."""
    from py4j.protocol import Py4JJavaError
    fs, hpath = _file_system(spark, path)
    fs.mkdirs(hpath.getParent())
    try:
        fs.create(hpath, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName() or fs.exists(hpath):
            return False
        raise


def touch(spark: SparkSession, path: str) -> None:
    """Create an empty marker file (and its folders), or replace it."""
    fs, hpath = _file_system(spark, path)
    fs.create(hpath, True).close()


def file_times(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names in a folder and when they were changed (milliseconds); none if
    the folder doesn't exist."""
    fs, hpath = _file_system(spark, folder)
    if not fs.exists(hpath):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in fs.listStatus(hpath)}


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it exists."""
    fs, hpath = _file_system(spark, path)
    fs.delete(hpath, True)


def read_small(spark: SparkSession, path: str) -> str:
    """The text of a small file."""
    fs, hpath = _file_system(spark, path)
    stream = fs.open(hpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_new(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small text file in place, whole or not at all; False if there is
    one already.  It is written beside and renamed without overwriting."""
    from py4j.protocol import Py4JJavaError
    fs, hpath = _file_system(spark, path)
    fs.mkdirs(hpath.getParent())
    jvm = spark.sparkContext._jvm
    beside = jvm.org.apache.hadoop.fs.Path(hpath.getParent(), f".{hpath.getName()}-{uuid.uuid4().hex[:12]}")
    stream = fs.create(beside, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(hpath), plain)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in e.java_exception.getClass().getName():
            raise
        fs.delete(beside, False)
        return False


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables.  Call it after the last
    result that reads them has been written."""
    fs, hpath = _file_system(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketflow/"
                                    f"{spark.sparkContext.applicationId}")
    fs.delete(hpath, True)


def materialize(df, name: str, partitions: int | None = 1):
    """Write a derived table once below the shared checkpoint folder and
    return it read back: cuts the lineage with one job (an eager RDD
    checkpoint runs two) and survives lost executors.  ``partitions=1``
    suits small tables; ``None`` keeps the partitioning of large ones."""
    path = scratch_path(df.sparkSession, name)
    (df if partitions is None else df.repartition(partitions)).write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make ``marketflow`` importable by Python workers (once per context).

    Operators that run Python on executors (keyed streaming state) pickle
    functions of this package by reference.  When the package is not
    installed on the cluster, a zip of it is built in memory, written to the
    shared checkpoint folder through the Hadoop file system (any scheme the
    cluster reads) and added with ``addPyFile``, Spark's way to ship code.
    """
    import io
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_marketflow_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/marketflow-code/marketflow-{uuid.uuid4().hex[:8]}.zip"
    jvm = sc._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(buf.getvalue()))
    finally:
        out.close()
    sc.addPyFile(str(fs.makeQualified(hpath).toString()))
    sc._marketflow_shipped = True


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings that size partitions for a given input volume.

    Shuffle partitions start at input / target (AQE then coalesces small
    ones and splits skewed ones); scan splits and the advisory size use the
    same target so a task's working set stays well inside executor memory.
    Pass the result as ``extra`` to ``get_spark`` or to ``spark-submit --conf``.
    """
    n = max(1, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(int(target_partition_bytes)),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(int(target_partition_bytes) * 4),
    }
