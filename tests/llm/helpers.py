"""Small document tables and the edge cases that every operator is held against."""

from __future__ import annotations

import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows, schema=SCHEMA):
    """rows: (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, schema)


def edge_rows():
    long = " ".join(f"w{i % 997} the" for i in range(30_000))
    return [
        (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "same text here\nwith lines"), (6, "same text here\nwith lines"),
        (6, "same text here\nwith lines"), (7, long), (8, "é ü 漢字 \U0001f600 mixed\r\ntext"), (None, "no id at all"), (9, "x" * 50_000, None),
    ]


def save(df, folder, name="documents"):
    """As the table ``name`` of a dataset folder."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def pdf(df, *order) -> pd.DataFrame:
    out = df.toPandas()
    return out.sort_values(list(order or out.columns[:1])).reset_index(drop=True)
