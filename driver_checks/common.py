"""Helpers of several blocks of checks."""

from __future__ import annotations

import uuid

from voxtable.session import scratch_folder


def fresh(spark, name: str) -> str:
    """A folder of its own in the shared scratch folder."""
    return f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
