"""Normal distribution function and moneylines as native expressions.

Spark has no normal CDF. It is built here from two classical expansions and stays
inside generated code: the odd power series near the centre, and the continued
fraction of Mills' ratio in the tails, where the series would lose digits.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boutframe import fixed_values as fv

SERIES_TERMS = 30
FRACTION_TERMS = 24
TAIL_FROM = 3.0


def lower_tail(distance: Column) -> Column:
    """P(Z <= -distance) for distance >= 0, to full relative precision.

    Pass a plain column: the expansions refer to it many times.
    """
    square = distance * distance
    density = F.exp(square * -0.5) / math.sqrt(2 * math.pi)

    series = F.lit(1.0)
    for k in range(SERIES_TERMS, 0, -1):
        series = square * (1.0 / (2 * k + 1)) * series + 1.0

    fraction = distance
    for k in range(FRACTION_TERMS, 0, -1):
        fraction = F.lit(float(k)) / fraction + distance

    near = F.lit(0.5) - density * distance * series
    return F.when(distance <= TAIL_FROM, near).when(distance > TAIL_FROM, density / fraction)


def moneyline(spread: Column, tail: Column, margin: float = fv.BOOK_MARGIN) -> Column:
    """American odds for a spread whose ``tail`` is P(Z <= -|spread| / sigma).

    The chance includes the book's margin; the odds are rounded half to even. Below
    about -23.71 the marked-up chance passes 1 and the favourite's sign flips; that is
    the rule's own behaviour and is kept.
    """
    short, long = tail * (1 + margin), (F.lit(1.0) - tail) * (1 + margin)
    favourite = F.try_divide(long, F.lit(1.0) - long) * -100
    underdog = F.try_divide(F.lit(1.0) - short, short) * 100
    return F.rint(F.when(spread < 0, favourite).when(spread >= 0, underdog))


def with_moneyline(df: DataFrame, spreads: dict[str, str]) -> DataFrame:
    """Add a moneyline column per spread column (``{moneyline: spread}``).

    Distance and tail are columns of their own, so each is worked out once per row.
    """
    distances = {f"__d_{s}": F.abs(F.col(s)) / fv.MARGIN_STD_DEV for s in spreads.values()}
    tails = {f"__t_{s}": lower_tail(F.col(f"__d_{s}")) for s in spreads.values()}
    lines = {m: moneyline(F.col(s), F.col(f"__t_{s}")) for m, s in spreads.items()}
    staged = df.withColumns(distances).withColumns(tails).withColumns(lines)
    return staged.drop(*distances, *tails)
