"""Binding of the operators to the driver's tables, and the SQL each query must equal."""
