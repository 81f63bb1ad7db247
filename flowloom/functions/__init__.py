"""Column expressions: no I/O, no shuffles, no Python workers."""
