"""Operators on graphs: ingest, hierarchy, aggregation, ordering, reachability, detail, search, views."""
