"""Makes the package importable where Python workers run."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once an application, unless their path has it."""
    app = spark.sparkContext.applicationId
    paths = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()] if p]
    if app in _sent or _ROOT in paths:
        return
    _sent.add(app)
    target = Path(tempfile.mkdtemp(prefix="loomscan-")) / "loomscan.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(_ROOT.glob("loomscan/**/*.py")):
            z.write(f, f.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(target))
