"""Contest analytics as Spark DataFrame transformations."""

from boutframe.functions.calendar import SeasonSpan

__all__ = ["SeasonSpan"]
