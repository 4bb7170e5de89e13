"""Status and group label of a compared key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import (
    EPSILON,
    GROUP_A_LARGER,
    GROUP_B_LARGER,
    GROUP_IMMATERIAL,
    GROUP_NOT_FOUND,
    GROUP_RECONCILED,
    STATUS_DIFFERENT,
    STATUS_NOT_FOUND,
    STATUS_RECONCILED,
)


def status_of(difference: Column, on_both: Column) -> Column:
    return (
        F.when(~on_both, STATUS_NOT_FOUND)
        .when(F.abs(difference) <= EPSILON, STATUS_RECONCILED)
        .otherwise(STATUS_DIFFERENT)
    )


def group_of(difference: Column, on_both: Column, limit: float) -> Column:
    label = F.when(~on_both, GROUP_NOT_FOUND).when(
        F.abs(difference) <= EPSILON, GROUP_RECONCILED
    )
    if limit > 0:
        tolerated = F.abs(difference) <= max(float(limit), EPSILON)
        label = label.when(tolerated, GROUP_IMMATERIAL)
    return label.when(difference > 0, GROUP_A_LARGER).otherwise(GROUP_B_LARGER)
