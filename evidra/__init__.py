"""Evidence-fusion analytics on Spark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

_SHIPPED: set[str] = set()


def packed(folder: str) -> str:
    """The package as a zip file in folder, from which Python imports it."""
    own = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(folder, "evidra.zip")
    with zipfile.ZipFile(path, "w") as file:
        for at, _, names in os.walk(own):
            for name in names:
                if name.endswith(".py"):
                    file.write(os.path.join(at, name), os.path.relpath(os.path.join(at, name), os.path.dirname(own)))
    return path


def ship(spark) -> None:
    """Sends the package to the workers of a session, once: Python stages import it there, wherever the driver was started. The
    driver's copy goes as it exits."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="evidra-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(packed(folder))
    _SHIPPED.add(context.applicationId)
