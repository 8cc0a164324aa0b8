"""A border the optimizer does not move expressions across."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(rows: DataFrame) -> DataFrame:
    """The same rows behind a generator of one row each.

    A filter pushed below a projection takes a copy of every expression it mentions. After a
    costly column that later steps use often, this border keeps it evaluated once per row
    and the generated code within its limit.
    """
    return rows.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))))
