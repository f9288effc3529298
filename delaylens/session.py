"""Spark session helpers.

The library never hard-codes cluster sizing. ``build_session`` is a
convenience for tests, the bench and local runs; on a cluster the caller
passes in its own session and every operator only reads settings from it.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

# Settings every operator relies on: UTC wall clock for timestamp_ntz
# arithmetic, AQE for runtime re-planning (partition coalescing, skew-join
# splitting, sort-merge -> broadcast demotion when a side turns out small).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


# Defaults of the convenience builder (a caller's own session keeps its own):
# fact-to-fact joins shuffle instead of relying on file-size estimates for a
# broadcast (dimension broadcasts are decided by the row-count check in
# operators.joins); AQE may still turn a sort-merge join into a broadcast or a
# shuffled hash join at runtime when the measured sides are small enough.
DEFAULT_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": str(2 * 1024 * 1024),
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(8 * 1024 * 1024),
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(64 * 1024 * 1024),
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(64 * 1024 * 1024),
}


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "delaylens",
    extra_conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings the operators expect."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = {**DEFAULT_CONF, **REQUIRED_CONF}
    conf["spark.ui.enabled"] = "false"
    conf["spark.ui.showConsoleProgress"] = "false"
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra_conf or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    On a cluster this is the shared location named by ``spark.checkpoint.dir``.
    Where the session names none, a folder in its warehouse serves, which every
    executor reaches like the tables in it.
    """
    root = _setting(spark, "spark.checkpoint.dir")
    return root or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def _setting(spark: SparkSession, key: str) -> str | None:
    return spark.conf.get(key, None) or spark.sparkContext.getConf().get(key, None)


def has_scratch(spark: SparkSession) -> bool:
    """Whether the session names a shared folder. Copies that only save
    recomputation are left out where it doesn't."""
    return bool(_setting(spark, "spark.checkpoint.dir"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make ``DataFrame.checkpoint()`` and ML checkpointing usable."""
    root = checkpoint_root(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_root(spark: SparkSession) -> str:
    """This application's part of the shared folder, removed when its driver
    ends."""
    root = f"{checkpoint_root(spark).rstrip('/')}/delaylens/{spark.sparkContext.applicationId}"
    if root not in _made:
        fs, path = _file_system(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _made.add(root)
    return root


_made: set[str] = set()


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path of this application under the shared folder."""
    return "/".join([scratch_root(spark), *parts])


def release_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application. DataFrames that
    still read them must have been used before."""
    fs, path = _file_system(spark, scratch_root(spark))
    fs.delete(path, True)
