"""Training-data operators: thirteen corpus operators, their queries and SQL twins."""
