"""Session factory: ANSI, UTC, adaptive execution."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "talus", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that spark-submit gives."""
    cores = cores or os.cpu_count() or 4
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Let the Python workers of all executors import this package: once per context, through the shared folder."""
    import io
    import zipfile
    from pathlib import Path

    from talus.staging import shared_dir

    context = spark.sparkContext
    if getattr(context, "_talus_shipped", False):
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{root.name}-{context.applicationId}.zip")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    context.addPyFile(path.toString())
    context._talus_shipped = True
