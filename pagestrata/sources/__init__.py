"""Sources and sinks of pages and documents."""
