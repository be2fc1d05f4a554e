"""Operators for preparing training text: near duplicates, toxicity, secrets, personal data, tokens.

Nothing else in the library imports this package. Its Python functions run on the
executors, so `ship` sends the package there once per application.
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="send-"), "forgetide_code.zip")  # the driver serves it
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(package):
                for name in names:
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        _SENT.add(context.applicationId)
    return spark
