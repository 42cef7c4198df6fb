"""Queries over the driver tables and the SQL they are compared with."""

from __future__ import annotations

import importlib
import pkgutil
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(__path__) if m.name.startswith("block_")):
        importlib.import_module(f"{__name__}.{module}")


def queries() -> dict:
    from driver_checks.registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict:
    from driver_checks.registry import TWINS, compose

    _load()
    return {name: compose(body, *ctes) for name, (body, ctes) in TWINS.items()}
