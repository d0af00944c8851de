"""Transaction costs and tax as column expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

# Fixed values.
COST_VERSION = "v0-literature"
IMPACT = 0.1
SPREAD_BPS = 5.0
ADV_FLOOR = 1.0
TAX_SHORT = 0.35
TAX_LONG = 0.15
LONG_TERM_DAYS = 365


def not_negative(value: float, label: str) -> float:
    """A finite number from zero on, or an error that names it."""
    if type(value) not in (int, float) or not 0 <= value < math.inf:
        raise ValueError(f"{label} must be a finite number from 0 on, got {value!r}")
    return value


@dataclass(frozen=True)
class CostModel:
    """Half the spread plus square-root impact, one way, in dollars.

    The version names the calibration; results under different versions are not
    comparable, so it has to be given.
    """

    version: str
    k: float = IMPACT
    spread_bps: float = SPREAD_BPS

    def __post_init__(self) -> None:
        if not isinstance(self.version, str) or not self.version.strip():
            raise ValueError("a cost model needs the version of its calibration")
        object.__setattr__(self, "version", self.version.strip())
        for label in ("k", "spread_bps"):
            not_negative(getattr(self, label), label)

    def estimate(self, price: Column, qty: Column, adv: Column, sigma: Column) -> Column:
        """Cost of trading ``qty`` shares; the sign of ``qty`` does not matter."""
        notional = F.abs(price * qty)
        impact = self.k * sigma * F.sqrt(notional / F.greatest(adv, F.lit(ADV_FLOOR)))
        return notional * (self.spread_bps / 2 / 1e4 + impact)


def current_model() -> CostModel:
    return CostModel(COST_VERSION)


def tax_due(short: Column, long: Column, short_rate: float = TAX_SHORT, long_rate: float = TAX_LONG) -> Column:
    """Tax on a year's netted gains, never below zero.

    When one side lost, what remains of the other is taxed at the other's rate.
    """
    for label, rate in (("short_rate", short_rate), ("long_rate", long_rate)):
        if isinstance(rate, bool) or not isinstance(rate, (int, float)):
            raise TypeError(f"{label} must be a number")
        if not 0 <= rate <= 1:
            raise ValueError(f"{label} must be between 0 and 1")
    net = short + long
    return (
        F.when(net <= 0, 0.0)
        .when(short < 0, net * long_rate)
        .when(long < 0, net * short_rate)
        .otherwise(short * short_rate + long * long_rate)
    )
