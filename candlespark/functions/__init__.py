"""Scalar functions of epoch seconds."""

from candlespark.functions.calendar import add_calendar_columns, day_of_week, second_of_day, second_of_week

__all__ = ["add_calendar_columns", "day_of_week", "second_of_day", "second_of_week"]
