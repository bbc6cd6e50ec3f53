"""Named queries over the graph views, with SQL twins."""
