"""Brings the library's code to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from weakref import WeakKeyDictionary

from pyspark import SparkContext
from pyspark.sql import SparkSession

import srcatlas

_SHIPPED: WeakKeyDictionary[SparkContext, bool] = WeakKeyDictionary()


def ship(spark: SparkSession) -> None:
    """Python workers can import the library from now on, wherever they run; done once for each application."""
    context = spark.sparkContext
    if context in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(srcatlas.__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="srcatlas-code-"), "srcatlas_code.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                archive.write(path, os.path.join("srcatlas", os.path.relpath(path, root)))
    context.addPyFile(target)  # served by the driver
    _SHIPPED[context] = True
