"""A query against its SQL on the same tables."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def differences(made, wanted):
    if sorted(made.columns) != sorted(wanted.columns):
        return [f"columns {sorted(made.columns)} and {sorted(wanted.columns)}"]
    if len(made) != len(wanted):
        return [f"{len(made)} and {len(wanted)} rows"]
    first = [c for c in ("key", "t", "row", "bin", "position", "doc_id", "o_orderkey") if c in made.columns]
    order = first + [c for c in sorted(made.columns) if c not in first]
    made, wanted = (x[order].sort_values(order).reset_index(drop=True) for x in (made, wanted))
    out = []
    for c in order:
        same = ((made[c] == wanted[c]) | (made[c].isna() & wanted[c].isna())).to_numpy()
        if not same.all():
            at = np.flatnonzero(~same)[0]
            out.append(f"{c}: {(~same).sum()} differ, first {made[c][at]!r} and {wanted[c][at]!r}")
    return out
