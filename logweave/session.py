"""Session construction and the few session-wide settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings every session of the engine has; the cluster's own settings win where they are present.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
}


def get_spark(app: str = "logweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; ``conf`` keys may use ``__`` for the dots."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the cluster's ``spark.checkpoint.dir``; only in a local session where it is unset (tests) a folder of our own."""
    sc = spark.sparkContext
    have = sc.getCheckpointDir()
    if have:
        return have
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + os.path.join(os.getcwd(), "spark-warehouse", "checkpoints")
    sc.setCheckpointDir(path)
    return path


def materialised(df):
    """A result that several parts of a query read, computed once and written to the shared checkpoint folder (its lineage ends there)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sized(df, most_rows: int = 100_000):
    """A table that is to be broadcast: written once, then marked for broadcast only if it has at most ``most_rows`` rows; a larger one is joined by a shuffle."""
    from pyspark.sql import functions as F

    done = materialised(df)
    return F.broadcast(done) if done.count() <= most_rows else done


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once: they need not have it installed, nor share the driver's folder."""
    sc = spark.sparkContext
    if getattr(sc, "_logweave_shipped", False):
        return
    import tempfile
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="logweave-"), "logweave.zip")  # on the driver only: executors fetch it from there
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("logweave", os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._logweave_shipped = True
