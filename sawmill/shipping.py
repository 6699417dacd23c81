"""Makes the package importable in Python workers that don't start in the repository's folder."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession, root: Path) -> None:
    """Adds a zip of the package as a --py-file, once for each application, unless workers find the package anyway."""
    app = spark.sparkContext.applicationId
    paths = [Path(p or ".").resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or root in paths or Path.cwd() == root:
        return
    target = Path(tempfile.mkdtemp(prefix="sawmill-")) / "sawmill.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted((root / "sawmill").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)
