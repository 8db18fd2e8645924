"""Numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column | str, places: int) -> Column:
    """Rounded as doubles are: the nearest whole number of units of the last place, not the nearest of the shortest decimal
    that reads as x, which F.round takes. So 0.575, a little less than that, gives 0.57."""
    unit = float(10**places)
    return F.round((F.col(x) if isinstance(x, str) else x) * unit, 0) / unit
