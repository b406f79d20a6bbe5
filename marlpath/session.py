"""Session defaults that the library's results rely on."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "marlpath", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, adaptive execution and skew-join handling.

    ``conf`` keys use ``__`` for a dot: ``spark__sql__shuffle__partitions="64"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that their Python workers can import it from any working directory."""
    context = spark.sparkContext
    if getattr(context, "_marlpath_shipped", False):
        return
    root = Path(__file__).resolve().parent
    bundle = Path(tempfile.mkdtemp(prefix="marlpath-")) / "marlpath.zip"
    with zipfile.ZipFile(bundle, "w") as out:
        for source in sorted(root.rglob("*.py")):
            out.write(source, source.relative_to(root.parent))
    context.addPyFile(str(bundle))
    context._marlpath_shipped = True
