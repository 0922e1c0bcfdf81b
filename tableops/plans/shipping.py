"""Python functions that run on executors without the package being installed there."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(module: str) -> None:
    """Send functions of ``module`` inside the task instead of by import name."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
