"""Makes the package known to Python workers that don't find it by themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def found_by_workers(master: str) -> bool:
    """Whether workers find the package: on this machine they share PYTHONPATH, and in plain local mode this folder."""
    if not master.startswith("local"):
        return False
    places = list(filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep)))
    if not master.startswith("local-cluster"):
        places.append(os.getcwd())
    return any(os.path.isdir(os.path.join(p, "quarry")) for p in places)


def ship(spark: SparkSession) -> None:
    """Send the package to the workers as a zip file, once a session, where they lack it."""
    app = spark.sparkContext.applicationId
    if app in _done or found_by_workers(spark.sparkContext.master):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quarry-"), "quarry.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith((".py", ".json")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("quarry", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _done.add(app)
