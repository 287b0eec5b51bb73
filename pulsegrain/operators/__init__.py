"""Operators: functions from DataFrame to DataFrame, to be chained with ``df.transform``."""
