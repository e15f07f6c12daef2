"""Working columns beside columns that a caller chose."""

from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df is called so (case does not count)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
