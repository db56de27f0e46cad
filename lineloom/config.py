"""Thresholds and plant settings; every operator takes them as parameters with these defaults."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Limits of the alarm rules and the constraint detector. Fixed values."""

    green: float = 2.0
    alert: float = 3.0
    trend_window: int = 5
    trend_step: float = 0.12
    trend_last: float = 2.0
    trend_rise: float = 1.6
    warmup: int = 200
    cross_z: float = 2.5
    cross_corr: float = 0.35
    lam: float = 0.2
    ewma_l: float = 4.5
    release: float = 0.4
    detrend: int = 61
    slope_window: int = 24
    slope_t: float = 3.5
    cusum_k: float = 0.5
    cusum_h: float = 7.75
    queue_z: float = 3.0


#: Lineitem quantities are near uniform, so textbook limits would never fire on them.
ADAPTED = Thresholds(green=1.0, alert=1.5, trend_last=1.0, trend_rise=0.8, cross_z=1.2, cross_corr=0.05, ewma_l=2.5, cusum_h=4.0, slope_t=1.5, queue_z=1.4)


@dataclass(frozen=True)
class Oven:
    """First-order thermal model and the search for its time constant. Fixed values."""

    setpoint: float = 178.0
    ambient: float = 25.0
    tau: float = 42.0
    dwell_base: float = 25.0
    dwell_step: float = 19.0
    z_crit: float = 3.3
    window: int = 15
    grid: int = 400


@dataclass(frozen=True)
class Economics:
    """Unit assumptions. Fixed values."""

    vehicles_per_year: float = 78000.0
    margin: float = 1850.0
    rework_cost: float = 640.0
    scrap_rate: float = 0.06
    scrap_cost: float = 4200.0
    defect_rate: float = 0.021
    investigation: float = 310.0
    max_share: float = 0.05
    band: float = 0.3
    lead: tuple[float, ...] = (0.0, 5.0, 10.0, 20.0, 40.0)
    actionable: tuple[float, ...] = (0.05, 0.35, 0.6, 0.78, 0.85)


#: Faults laid over the adapted line (station numbers are suppliers), active in a range of vehicles or at listed ones. Fixed values.
INJECTIONS = [
    # id, kind, station, parameters, start, stop, vehicles, size in standard deviations
    ("inj1", "trend", 1, ["quantity"], 250, 300, None, 0.08),
    ("inj2", "point", 5, ["discount"], None, None, [260, 261, 262], 4.0),
    ("inj3", "cross_parameter", 7, ["tax", "discount"], 300, 340, None, 1.5),
    ("inj4", "bottleneck", 4, ["cycle_time"], 240, 420, None, 0.05),
    ("inj5", "latent_defect", 2, ["extendedprice"], 280, 380, None, 1.2),
    ("inj6", "bottleneck", 9, ["cycle_time"], 310, 450, None, 0.04),
]

@dataclass(frozen=True)
class Parameter:
    """What the plant says of a parameter: the model that scores it, its weight in a station's health, whether back-traces use it, its specification."""

    model: str | None = None
    weight: float = 1.0
    traced: bool = True
    spec: tuple[float, float] | None = None


THERMAL = "thermal_first_order"
#: The adapted line's parameters; temperatures are read in the ovens of even number, their own shop. Fixed values.
PLANT = {"quantity": Parameter(traced=False), "extendedprice": Parameter(), "discount": Parameter(), "tax": Parameter(), "temperature": Parameter(model=THERMAL, weight=1.4)}

#: Station groups: prefix, area, stations, instrumented share, base cycle. Fixed values.
GROUPS = [("BIW", "Body", 14, 0.72, 52.0), ("PNT", "Paint", 10, 0.70, 55.0), ("FNL", "Final", 16, 0.69, 50.0)]

#: Rollout phases (name, weeks, cost) and sensor plan (item, stations, unit cost). Fixed values of the adapted plant.
PHASES = [("pilot", 12.0, 120000.0), ("line", 20.0, 310000.0), ("plant", 36.0, 540000.0)]
SENSORS = [("torque", [3, 6, 9], 4200.0), ("vision", [12, 15], 18500.0), ("thermal", [18], 2600.0)]


def load(text: str, kind: type):
    """Settings of ``kind`` from a JSON object; names it does not have raise, those left out keep their defaults."""
    given = json.loads(text)
    unknown = set(given) - {f.name for f in dataclasses.fields(kind)}
    if unknown:
        raise ValueError(f"{kind.__name__} has no {sorted(unknown)}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
