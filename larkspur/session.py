"""Session settings and shipping of this package to Python workers."""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


def get_spark(app: str = "larkspur", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine's results rely on (UTC, ANSI, AQE)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.ansi.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate data below spark.checkpoint.dir, which all executors share.

    Where that is unset, as in tests, a session in one process takes a temporary folder; a cluster is refused.
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="larkspur-data-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, whatever their path is.

    The zip is named by its content, so that a second call on the same context adds nothing.
    """
    sc = spark.sparkContext
    if getattr(sc, "_larkspur_shipped", False):
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        for path in sorted(PACKAGE.rglob("*.py")):
            info = zipfile.ZipInfo(str(Path(PACKAGE.name) / path.relative_to(PACKAGE)))
            archive.writestr(info, path.read_bytes())
    digest = hashlib.sha256(buffer.getvalue()).hexdigest()[:16]
    folder = tempfile.mkdtemp(prefix="larkspur-")
    target = os.path.join(folder, f"larkspur-{digest}.zip")
    Path(target).write_bytes(buffer.getvalue())
    sc.addPyFile(target)
    sc._larkspur_shipped = True
