"""Query registry and the SQL oracle used to check it."""
