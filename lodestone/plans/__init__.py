"""Named queries over the given tables, each with its checking SQL where SQL can say it."""
