"""Small file access inside tasks of Python data sources: one file system per URI, retried calls."""

from __future__ import annotations

import sys
import time
from collections.abc import Callable
from typing import Any

from pyarrow import fs
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it; ``file:/x`` as Hadoop writes it is local."""
    if path.startswith("file:"):
        path = "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)


def retried(call: Callable[[], Any], attempts: int, delay: float) -> Any:
    """The value of ``call``; after an ``OSError`` it is tried again, each time after twice the wait."""
    for turn in range(attempts):
        try:
            return call()
        except OSError:
            if turn + 1 == attempts:
                raise
            time.sleep(delay * 2**turn)
