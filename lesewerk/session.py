"""Session defaults. A cluster's own settings win: values are only set where they are unset."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("lesewerk")
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where the setting is unset (tests)."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it must name a shared folder")
        import tempfile

        folder = tempfile.mkdtemp(prefix="lesewerk-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package: by path where they share the driver's files, as a zip elsewhere."""
    import os
    import shutil
    import tempfile

    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root in known:
        return spark
    context.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])
    if not context.master.startswith("local"):
        name = os.path.join(tempfile.mkdtemp(prefix="lesewerk-"), "lesewerk")  # on the driver; Spark hands it out
        context.addPyFile(shutil.make_archive(name, "zip", root, "lesewerk"))
    return spark
