"""Session defaults, the shared checkpoint folder, and scratch tables in it.

On a cluster the platform configures the session: :func:`get_spark` never sets
a master unless asked to, and sets a default only where nothing is configured.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Runtime defaults, set after start where the submitted configuration is silent.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # parquet timestamps without zone stay wall-clock values
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
}
#: Start-up defaults of a session that this process starts by itself.
_START_DEFAULTS = {"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}


def _submitted() -> bool:
    """True when spark-submit started this process (its settings are complete)."""
    return "PYSPARK_GATEWAY_PORT" in os.environ


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or fetch) a session with the library's defaults.

    ``master``, ``shuffle_partitions`` and ``extra`` are set because the caller
    asks for them; every other setting is a default and yields to what
    spark-submit, ``PYSPARK_SUBMIT_ARGS`` or a running session already has.
    """
    builder = SparkSession.builder
    if app_name or not _submitted():
        builder = builder.appName(app_name or "ledger_spark")
    if master:
        builder = builder.master(master)
    asked = dict(extra or {})
    if shuffle_partitions is not None:
        asked["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    arguments = os.environ.get("PYSPARK_SUBMIT_ARGS", "")
    if not _submitted():
        starts = dict(_START_DEFAULTS)
        if "LEDGER_DRIVER_MEMORY" in os.environ:
            starts["spark.driver.memory"] = os.environ["LEDGER_DRIVER_MEMORY"]
        for key, value in starts.items():
            if key not in arguments:
                builder = builder.config(key, value)
    for key, value in asked.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    configured = dict(spark.sparkContext.getConf().getAll())
    for key, value in _DEFAULTS.items():
        if key not in configured and key not in asked:
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a laptop) gets a
    temporary folder, removed when the process ends; on a cluster a missing
    setting is an error, since executors cannot reach the driver's disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        current = tempfile.mkdtemp(prefix="ledger-ckpt-")
        atexit.register(shutil.rmtree, current, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder inside the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/ledger-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's scratch tables. Only once no DataFrame over
    them is still to be read."""
    from ledger_spark.sources.storage import delete

    delete(spark, scratch_dir(spark))


def materialize(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the scratch folder and continue from the files.

    Used where a compact intermediate is read by several later jobs. Lineage is
    cut, so a lost executor re-reads files instead of recomputing upstream, and
    the planner knows the true size. Partitioned ``by`` columns, a filter on them
    reads its own files only.
    """
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so that
    functions of it run there even where the package is not installed or on
    their path (as ``spark-submit --py-files`` would)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="ledger-py-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "ledger_spark.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in sorted(os.walk(package)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(at, name)
                    z.write(path, os.path.join("ledger_spark", os.path.relpath(path, package)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)
