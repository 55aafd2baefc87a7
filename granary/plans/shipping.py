"""The package itself for executors that don't have it installed."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_PACKAGE = Path(__file__).resolve().parent.parent


def zipped() -> bytes:
    """A zip of the package's sources, as executors import them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(_PACKAGE.rglob("*.py")):
            archive.write(path, path.relative_to(_PACKAGE.parent))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Give every executor the package, once an application. The driver's own file server hands it out; executors need no shared folder."""
    context = spark.sparkContext
    if getattr(context, "_granary_shipped", False):
        return
    path = Path(tempfile.mkdtemp(prefix="granary-")) / "granary.zip"
    path.write_bytes(zipped())
    context.addPyFile(str(path))
    context._granary_shipped = True
