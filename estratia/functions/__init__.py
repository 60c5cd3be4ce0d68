"""Column functions; every one returns a plain Spark ``Column`` expression."""
