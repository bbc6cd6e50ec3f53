"""Graph views over relational tables, and sources and sinks of results."""
