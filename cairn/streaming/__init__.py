"""Event-time forms of the access-trace operators."""
