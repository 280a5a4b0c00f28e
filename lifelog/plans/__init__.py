"""Batch planners: tables in, delta tables out.  Nothing is updated in place."""
