"""Column names that a caller's frame doesn't have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, *names: str) -> str | list[str]:
    """The names, each lengthened by underscores until no column of the frame has it in any case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out[0] if len(out) == 1 else out
