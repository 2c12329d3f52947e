"""Giving the executors' Python workers this package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame

_shipped: set[str] = set()

#: Arrow batches end at this many bytes unless the session says otherwise, so long rows don't swell them.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4m")


def ship(df: DataFrame) -> DataFrame:
    """Send the package's sources to the executors, once for each application, bound the session's Arrow batches, and return df."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession._jsparkSession.sessionState().conf().contains(BATCH_BYTES[0]):
        df.sparkSession.conf.set(*BATCH_BYTES)
    if context.applicationId not in _shipped:
        top = Path(__file__).resolve().parents[1]
        target = os.path.join(tempfile.mkdtemp(prefix="pairloom-"), "pairloom.zip")
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(top.rglob("*.py")):
                out.write(path, f"{top.name}/{path.relative_to(top)}")
        context.addPyFile(target)
        atexit.register(shutil.rmtree, os.path.dirname(target), ignore_errors=True)
        _shipped.add(context.applicationId)
    return df
