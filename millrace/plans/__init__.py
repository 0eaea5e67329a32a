"""Plans given as text, statements, EXPLAIN and statistics."""
