"""Helpers of the tests, in a module whose name no other folder has."""


def rows(df, *cols):
    """All rows as sorted tuples."""
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=repr)
