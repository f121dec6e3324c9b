"""Makes the package importable in Python workers that were not started with it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession, root: Path) -> None:
    """Adds a zip of the package to the session's Python files, once, unless PYTHONPATH already leads workers to it."""
    app = spark.sparkContext.applicationId
    if app in _done or str(root) in os.environ.get("PYTHONPATH", "").split(":"):
        return
    path = Path(tempfile.mkdtemp(prefix="lumenreel-")) / "lumenreel_src.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in [*sorted(root.glob("lumenreel/**/*.py")), *root.glob("corpus_pipeline.py")]:
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(path))
    _done.add(app)
