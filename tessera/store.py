"""Tables that queries of one session share: an index is built once and then served from disk."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

_MADE: dict[tuple[str, str, str], tuple[str, float]] = {}
_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The session's place below the folder that all executors share; on a single machine a temporary one if none is named."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if "at" not in _OWN:
            _OWN["at"] = tempfile.mkdtemp(prefix="tessera-")
            atexit.register(shutil.rmtree, _OWN["at"], True)
        root = f"file://{_OWN['at']}"
    return f"{root.rstrip('/')}/tessera-index/{spark.sparkContext.applicationId}"


def once(spark: SparkSession, name: str, source: str, build: Callable[[str], None]) -> str:
    """The folder that ``build`` filled for (name, source) in this session; built at the first call."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _MADE:
        path, began = f"{folder(spark)}/{name}-{uuid.uuid4().hex}", time.perf_counter()
        build(path)
        _MADE[key] = path, time.perf_counter() - began
    return _MADE[key][0]


def built() -> dict[str, float]:
    """Seconds that each thing of this process took to build."""
    return {name: round(seconds, 3) for (_, name, _), (_, seconds) in _MADE.items()}

