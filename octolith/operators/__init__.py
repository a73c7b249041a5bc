"""Operators over point tables: functions from DataFrames to DataFrames."""
