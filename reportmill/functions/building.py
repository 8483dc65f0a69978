"""Large expressions are made of thousands of calls into the JVM. PySpark notes the Python line of each for error messages, which costs
several calls more; ``light`` leaves that out while an operator builds its plan."""

from __future__ import annotations

import functools
from collections.abc import Callable
from typing import Any

from pyspark.errors import utils


def light(build: Callable) -> Callable:
    @functools.wraps(build)
    def run(*args: Any, **kwargs: Any) -> Any:
        if not hasattr(utils, "_enable_debugging_cache"):
            return build(*args, **kwargs)
        before, utils._enable_debugging_cache = utils._enable_debugging_cache, False
        try:
            return build(*args, **kwargs)
        finally:
            utils._enable_debugging_cache = before

    return run
