"""runledger: a PySpark-native analytics engine for agent execution traces."""

from __future__ import annotations

import os
import tempfile
import zipfile

__version__ = "0.1.0"


def ship(spark) -> None:
    """Sends this package to the executors, once per application, so that Python workers can import it wherever they run."""
    context = spark.sparkContext
    if getattr(context, "_runledger_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="ship-"), "runledger-package.zip")
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(at)
    context._runledger_shipped = True
