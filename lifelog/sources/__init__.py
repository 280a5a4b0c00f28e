"""Sources and sinks: log files, line extraction, payload validation, idempotent tables."""
