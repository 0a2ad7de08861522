"""Sources and sinks: trace indices, run logs, settings, event files, HTTP."""
