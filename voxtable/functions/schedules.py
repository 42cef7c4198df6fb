"""Learning-rate schedule as a closed form of the step number."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def warmup_progress(step: Column, warmup_steps: Column) -> Column:
    """Share of the warm-up done, 1 without a warm-up."""
    return F.when(warmup_steps > 0, F.least(F.lit(1.0), step / warmup_steps)).otherwise(F.lit(1.0))


def learning_rate(
    step: Column, warmup_steps: Column, total_steps: Column, base: float = 1e-4, floor_share: float = 0.01
) -> Column:
    """Linear from 1 % to 100 % over the warm-up, then a half cosine down to 1 %."""
    low = base * floor_share
    linear = base * (floor_share + (1.0 - floor_share) * step / warmup_steps)
    span = F.greatest(total_steps - warmup_steps, F.lit(1))
    cosine = low + (base - low) * (1 + F.cos(math.pi * (step - warmup_steps) / span)) / 2
    return F.when((warmup_steps > 0) & (step < warmup_steps), linear).otherwise(cosine)
