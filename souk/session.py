"""Session helpers: configuration that every analytic in the library assumes.

The library never creates a cluster session on its own; callers pass their
``SparkSession``.  ``local_session`` exists for tests, the bench and the
driver smoke check.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings the analytics rely on for correct results (not tuning):
#  * UTC session time zone: month keys of timestamp_ntz columns are stable.
#  * ANSI mode stays on (Spark 4 default); every division goes through
#    try_divide / nullif so degenerate groups return NULL instead of failing.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
}

# Scale settings: AQE re-plans joins from runtime sizes (a dimension that turns
# out small is broadcast only after its size is measured), coalesces small
# shuffle partitions and splits skewed join partitions.
SCALE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # checkpoint files of intermediate tables are removed once unreferenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "souk") -> SparkSession:
    """Local-mode session for tests and benchmarks (UI off, no server)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SOUK_DRIVER_MEMORY", "12g"))
    )
    for k, v in {**REQUIRED_CONF, **SCALE_CONF}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``souk`` importable in the Python workers of this application.

    Vectorised UDFs and grouped-map functions defined in the package are
    pickled by reference, so executors must be able to import it.  The
    package is zipped once per application and added with ``addPyFile``
    (Spark distributes it to every executor).
    """
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="souk-pkg-"), "souk.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, dirs, files in os.walk(pkg):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the analytics need to an existing session: UTC
    session time zone, a checkpoint folder, and the package on the workers."""
    for k, v in REQUIRED_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder; set a scratch one only if unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as
    is.  Only when nothing is configured (local tests) is a fresh scratch
    folder created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    scratch = tempfile.mkdtemp(prefix="souk-ckpt-")
    sc.setCheckpointDir(scratch)
    return sc.getCheckpointDir()
