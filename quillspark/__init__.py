"""quillspark: document-to-question dataset engine and corpus tools on Spark DataFrames."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path


def ship(spark) -> None:
    """Lets Python workers import this package: by path on one machine, as an archive on a cluster. Does nothing where
    PYTHONPATH names the package's folder already."""
    context, root = spark.sparkContext, str(Path(__file__).resolve().parents[1])
    if root in os.environ.get("PYTHONPATH", "").split(":") or root in context.environment.get("PYTHONPATH", "").split(":"):
        return
    known = context.environment.get("PYTHONPATH")
    context.environment["PYTHONPATH"] = f"{root}:{known}" if known else root
    if not context.master.startswith("local["):
        folder = tempfile.mkdtemp()  # the driver serves the archive from here
        context.addPyFile(shutil.make_archive(f"{folder}/quillspark", "zip", root, "quillspark"))
