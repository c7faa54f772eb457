"""Sources and sinks: files, fitted state, generated columns."""
