"""Defaults shared by the operators; every one of them is also a parameter."""

from __future__ import annotations

import datetime as dt

# Reporting date, seed, thresholds.
AS_OF = dt.date(2026, 3, 12)
SEED = 42
RISK_THRESHOLD = 0.5
HOLDOUT_FRACTION = 0.25
