"""DataFrame operators: ``fn(df, ...) -> DataFrame``."""
