"""Stage operators: functions from DataFrames to DataFrames."""
