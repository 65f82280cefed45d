"""Compare a query with its SQL in DuckDB, whatever the order of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for table in TABLES:
        con.sql(f"create view {table} as select * from read_parquet('{folder}/{table}.parquet')")
    return con


def plain(value):
    if value is None or (not hasattr(value, "__len__") and pd.isna(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return float(f"{value:.9g}")
    if hasattr(value, "tolist") and hasattr(value, "__len__"):
        return [plain(x) for x in value.tolist()]
    text = str(value)
    return text.removesuffix(" 00:00:00")


def rows(frame: pd.DataFrame) -> list[str]:
    return sorted(str(tuple(map(plain, r))) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False, name=None))
