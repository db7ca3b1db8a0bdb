"""Sessions, and the package's way to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Rows that pass to a Python worker at a time: texts may be long, and Spark's 10,000 of them fill both sides' memory.
BATCH_ROWS = "1000"
PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: dict[str, str] = {}


def build_session(app: str = "textloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings that the operators are written for; ``conf`` wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS,
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for key, value in {**settings, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, as ``--py-files`` would; once for each application.

    A session that leaves Arrow's batches at Spark's 10,000 rows gets smaller ones.
    """
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if _SHIPPED.get("app") == sc.applicationId:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="textloom-"), "textloom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in sorted(names):
                if name.endswith((".py", ".json", ".tsv", ".txt")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("textloom", os.path.relpath(full, PACKAGE)))
    sc.addPyFile(path)
    _SHIPPED["app"] = sc.applicationId
