"""Graph operators: functions of DataFrames and parameters to DataFrames. Nothing here collects rows."""
