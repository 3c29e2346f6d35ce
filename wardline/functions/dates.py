"""Election calendar and as-of shifts."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F


def election_day_column(year: Column) -> Column:
    """Tuesday after the first Monday of November."""
    return F.date_add(F.next_day(F.make_date(year, F.lit(10), F.lit(31)), "MON"), 1)


def election_day(year: int) -> dt.date:
    """The same for a plan parameter."""
    nov1 = dt.date(year, 11, 1)
    return nov1 + dt.timedelta(days=(7 - nov1.weekday()) % 7 + 1)


def shift_age(age: Column, ref_year: int, target_year: int) -> Column:
    """Age at the target election, from an age that is current in ref_year."""
    return age - F.lit(ref_year - target_year)
