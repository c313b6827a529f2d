"""Sources and sinks: CSV, log lines, model folders."""
