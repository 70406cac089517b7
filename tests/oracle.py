"""Both engines' results as comparable values."""

import math
from pathlib import Path

import duckdb


def connect(folder):
    con = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def values(frame):
    columns = sorted(frame.columns)

    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return None
        return x.item() if hasattr(x, "item") else x

    return columns, sorted(repr([plain(x) for x in row]) for row in frame[columns].itertuples(index=False))
