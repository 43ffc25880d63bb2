"""Stage jobs, the mapping of the given tables, and the registered queries."""
