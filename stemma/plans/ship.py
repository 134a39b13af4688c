"""Sends the package to the executors once a session, for the functions that run in their Python workers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


#: Stored tables are compressed; without a factor Spark takes a file's size for that of its rows and plans broadcasts
#: many times larger than the bound that is set.
COMPRESSION, FACTOR = "spark.sql.sources.fileCompressionFactor", "4.0"


def ship(spark: SparkSession) -> None:
    if float(spark.conf.get(COMPRESSION, "1.0")) == 1.0:
        spark.conf.set(COMPRESSION, FACTOR)
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(home):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(home)))
    path = os.path.join(tempfile.mkdtemp(prefix="stemma-"), "stemma.zip")
    with open(path, "wb") as f:
        f.write(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _sent.add(app)
