"""Operators: functions from DataFrames and parameters to one lazy DataFrame."""
