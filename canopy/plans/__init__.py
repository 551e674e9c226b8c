"""Plan-level helpers: materialisation and registry of queries."""
