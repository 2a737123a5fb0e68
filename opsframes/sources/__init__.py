"""Sources and sinks: typed file reads/writes and the test-table adapters."""
