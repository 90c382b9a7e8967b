"""Column functions: all built on Spark's own expressions unless a name says otherwise."""
