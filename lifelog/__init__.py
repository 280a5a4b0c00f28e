"""lifelog: event-sourced player-log analytics on PySpark DataFrames."""
