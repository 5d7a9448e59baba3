"""Run registered queries against their checking SQL."""

from __future__ import annotations

import math
import time

import duckdb
import pandas as pd

from engram.plans.views import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, bool):
        return v
    if hasattr(v, "item") and not hasattr(v, "__len__"):
        return _plain(v.item())
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(_plain(x) for x in v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(_plain(v) for v in row) for row in pdf.itertuples(index=False, name=None)), key=repr)


def kinds(pdf: pd.DataFrame) -> dict:
    return {c: str(pdf[c].dtype) for c in sorted(pdf.columns)}


def compare(spark, con, sf_dir: str, name: str, fn, check: str | None) -> dict:
    start = time.time()
    got = fn(spark, sf_dir).toPandas()
    out = {"name": name, "rows": len(got), "sec": round(time.time() - start, 2), "ok": None, "why": ""}
    if check is None:
        return out
    want = con.sql(check).df()
    if sorted(got.columns) != sorted(want.columns):
        return {**out, "ok": False, "why": f"columns {sorted(got.columns)} != {sorted(want.columns)}"}
    a, b = rows_of(got), rows_of(want)
    out["ok"] = a == b
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3] if len(a) < 20000 else a[:2]
        only_b = [r for r in b if r not in set(a)][:3] if len(a) < 20000 else b[:2]
        out["why"] = f"{len(a)} vs {len(b)} rows; spark {only_a} | check {only_b}"
    ga, wa = kinds(got), kinds(want)
    odd = {c: (ga[c], wa[c]) for c in ga if ga[c] != wa[c]}
    if odd:
        out["types"] = odd
    return out
