"""Session settings that the operators count on."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.legacy.javaCharsets": "true",  # single-byte western encodings in the text reader
}


def build_session(app: str = "gristmill", **more: str) -> SparkSession:
    """A session with these settings; ``more`` adds or overrides, with ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder the driver has it in.

    On a cluster without such a folder the package is installed or shipped with
    ``--py-files``; an unknown entry on the path does no harm there.
    """
    home, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if home not in known:
        env["PYTHONPATH"] = os.pathsep.join([home, *known])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A session in one process (a ``local`` master, as in tests) may leave it
    unset and gets a folder of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-shared-"))
        named = sc.getCheckpointDir()
    return named.rstrip("/")
