"""Make this package importable in the Python workers of any cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame

_ROOT = os.path.dirname(os.path.abspath(__file__))
_sent: set[str] = set()


def ship(df: DataFrame) -> DataFrame:
    """``df``, after the package was sent once to the application's workers.

    Functions that run in Python workers are pickled by reference, so the workers
    must import this package; Spark's file server hands them a zip of it.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _sent:
        path = os.path.join(tempfile.mkdtemp(prefix="ship"), "contactloom_src.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(_ROOT):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(_ROOT)))
        context.addPyFile(path)
        _sent.add(context.applicationId)
    return df
