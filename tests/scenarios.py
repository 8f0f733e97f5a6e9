"""Made-up tables with a known cause, defect or effect."""

from __future__ import annotations

import numpy as np
import pandas as pd


def months(first: str, last: str) -> pd.DatetimeIndex:
    return pd.date_range(first, last, freq="MS")


def regional_decline() -> pd.DataFrame:
    rng = np.random.default_rng(42)
    rows = []
    for m in months("2023-01-01", "2024-09-01"):
        for region in ("North", "South", "East", "West"):
            base = 50_000 + rng.normal(0, 3_000)
            base *= 0.35 if region == "South" and m >= pd.Timestamp("2024-07-01") else 1.0
            for product in ("Alpha", "Beta", "Gamma"):
                rows.append((m, region, product, round(base / 3 + rng.normal(0, 900), 2),
                             int(base / 300 + rng.normal(0, 12))))
    return pd.DataFrame(rows, columns=["date", "region", "product", "revenue", "units"])


def no_explanation() -> pd.DataFrame:
    rng = np.random.default_rng(5)
    rows = []
    for m in months("2023-01-01", "2024-09-01"):
        level = 400 if m < pd.Timestamp("2024-06-01") else 250
        rows += [(m, round(level + rng.normal(0, 8), 2), f"O{len(rows) + i:06d}") for i in range(20)]
    return pd.DataFrame(rows, columns=["date", "revenue", "order_id"])


def moved_driver() -> pd.DataFrame:
    """A falls in 2023, Y falls in late 2024."""
    rng = np.random.default_rng(9)
    rows = []
    for m in months("2022-01-01", "2024-12-01"):
        for product in ("X", "Y", "Z"):
            for region in ("A", "B"):
                v = 10_000 + rng.normal(0, 150)
                if region == "A" and pd.Timestamp("2022-10-01") <= m <= pd.Timestamp("2023-05-01"):
                    v *= 0.4
                if product == "Y" and m >= pd.Timestamp("2024-08-01"):
                    v *= 0.3
                rows.append((m, region, product, round(v, 2)))
    return pd.DataFrame(rows, columns=["date", "region", "product", "revenue"])


def pair_decline() -> pd.DataFrame:
    """Only one product of one region falls."""
    rng = np.random.default_rng(11)
    rows = []
    for m in months("2023-01-01", "2024-09-01"):
        for region in ("North", "South", "East"):
            for product in ("Widget", "Gadget", "Gizmo"):
                v = 10_000 + rng.normal(0, 120)
                if (region, product) == ("North", "Widget") and m >= pd.Timestamp("2024-04-01"):
                    v *= 0.25
                rows.append((m, region, product, round(v, 2)))
    return pd.DataFrame(rows, columns=["date", "region", "product", "revenue"])


def dirty() -> pd.DataFrame:
    """240 clean rows with eight kinds of injected defects."""
    rng = np.random.default_rng(1)
    n = 240
    d = pd.DataFrame({
        "order_id": [f"O{i:05d}" for i in range(n)],
        "order_date": pd.date_range("2024-01-01", periods=n).strftime("%Y-%m-%d"),
        "region": rng.choice(["North", "South", "East", "West"], n),
        "revenue": np.round(rng.normal(500, 60, n), 2), "units": rng.integers(1, 20, n)})
    d.loc[0:17, "revenue"] = np.nan
    d.loc[20:25, "revenue"] = -100.0
    d.loc[30:32, "revenue"] = 90_000.0
    d.loc[40:59, "region"] = " north "
    d.loc[60:65, "region"] = "Norht"
    d.loc[70:74, "order_date"] = "not-a-date"
    d.loc[80:85, "order_id"] = "O00001"
    return pd.concat([d, d.iloc[100:110]], ignore_index=True)


EXPECTED_ISSUES = [
    ("revenue", "missing_values"), ("revenue", "invalid_range"), ("revenue", "outliers"),
    ("region", "inconsistent_categories"), ("region", "similar_categories"),
    ("order_date", "date_problems"), ("order_id", "duplicate_keys"), ("__dataset__", "duplicate_rows")]
BY_DESIGN = [("region", "similar_categories"), ("order_id", "duplicate_keys"), ("revenue", "outliers")]
