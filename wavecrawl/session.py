"""Session helpers: a local session for tests/bench and the shared state folder.

Library code never invents storage locations on a cluster: wave state and
other lineage cuts go under the folder named by ``spark.checkpoint.dir``.
Only a local-mode session without that setting (tests, the driver's check
harness, the bench) gets a private scratch folder.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Pages are large strings: keep Arrow batches small for the HTML pass.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, app: str = "wavecrawl") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("WAVECRAWL_DRIVER_MEMORY", "16g"))
    for k, v in _LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_state_root(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def ensure_state_root(spark: SparkSession) -> str:
    """Return the shared folder for lineage cuts (``spark.checkpoint.dir``).

    Reads the setting from the session. Only when it is unset *and* the
    session is local (tests, checks) is a private scratch folder set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            root = jdir.get()
    if not root:
        if not _is_local(spark):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; a cluster run needs a shared folder for wave state"
            )
        root = tempfile.mkdtemp(prefix="wavecrawl-ckpt-", dir=os.environ.get("WAVECRAWL_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def new_run_dir(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the state root for one job run (never reused)."""
    return f"{ensure_state_root(spark)}/wavecrawl/{kind}-{uuid.uuid4().hex[:12]}"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``wavecrawl`` importable in Python workers (``addPyFile`` of a zip).

    Needed wherever a pandas UDF / ``mapInPandas`` references package code.
    Done once per SparkContext, and only for local masters: on a cluster the
    package is shipped with the job (``spark-submit --py-files`` /
    ``spark.submit.pyFiles``) or installed on the executors.
    """
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _shipped or not _is_local(spark):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="wavecrawl-pkg-"), "wavecrawl.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.join("wavecrawl", os.path.relpath(full, pkg_dir)))
    sc.addPyFile(out)
    _shipped.add(key)
