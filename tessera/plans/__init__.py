"""Named queries over the given tables, experiments, and their SQL twins."""
