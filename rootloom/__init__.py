"""Root-cause analytics over telemetry tables, as DataFrame operators."""
