"""DataFrame operators, each `f(df, **params) -> DataFrame`."""
