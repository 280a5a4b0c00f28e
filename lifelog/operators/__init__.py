"""Reusable relational operators: ordered scans, temporal joins, ranking and islands."""
