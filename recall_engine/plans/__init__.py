"""Plan-level helpers: session defaults, shared tables, link expansion."""
