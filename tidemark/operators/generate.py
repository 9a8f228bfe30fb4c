"""Synthetic multivariate series by domain, with injected scenarios.

A sample is made whole in one task from its own random generator, seeded by ``(seed, sample)``: the result doesn't
depend on partitions. Domains and scenarios are plain functions in registries; ``domain`` and ``scenario`` add more.
Bit-equality with other generators is no goal, the shapes and the labelling are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ..schema import TYPES

SCHEMA = "sample long, domain string, scenario string, row_idx long, timestamp double, channel int, role string, value double, label int, type int"
#: Share of samples without a fault; of faults that last to the end; least effect of a fault, in spreads.
CLEAN, PERSISTENT, LEAST_EFFECT = 0.25, 0.10, 0.3
DAY = 86400.0


@dataclass
class Sample:
    """A series under construction: time axis, channels by role, labels and types by cell."""

    rng: np.random.Generator
    t: np.ndarray
    roles: tuple[str, ...] = ()
    x: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    label: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int8))
    type: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int8))

    def ready(self, **channels: np.ndarray) -> None:
        self.roles = tuple(channels)
        self.x = np.stack([np.asarray(c, float) for c in channels.values()], 1)
        self.label, self.type = np.zeros(self.x.shape, np.int8), np.zeros(self.x.shape, np.int8)

    def at(self, role: str) -> np.ndarray:
        return self.x[:, self.roles.index(role)]

    def hours(self) -> np.ndarray:
        return (self.t % DAY) / 3600

    def noise(self, scale: float = 1.0) -> np.ndarray:
        return self.rng.normal(0, scale, len(self.t))

    def walk(self, keep: float = 0.97, scale: float = 1.0) -> np.ndarray:
        """A stationary first-order autoregression of deviation ``scale``."""
        shock = self.noise(scale * np.sqrt(1 - keep * keep))
        out = np.empty(len(shock))
        last = self.rng.normal(0, scale)
        for i, s in enumerate(shock):
            out[i] = last = keep * last + s
        return out

    def smooth(self, x: np.ndarray, rows: float) -> np.ndarray:
        """A one-pole low pass with a time constant of ``rows`` rows."""
        a = np.exp(-1 / max(rows, 1e-6))
        out, last = np.empty(len(x)), x[0]
        for i, v in enumerate(x):
            out[i] = last = a * last + (1 - a) * v
        return out

    def pulse(self, centre: float, width: float) -> np.ndarray:
        away = np.abs(self.hours() - centre)
        away = np.minimum(away, 24 - away)
        return np.exp(-0.5 * (away / width) ** 2)

    def segment(self, low: int = 8, high: float = 0.25) -> tuple[int, int]:
        """Rows of a fault: after the first 30 % of the series, sometimes to its end."""
        n = len(self.t)
        start = int(self.rng.integers(int(0.3 * n), max(int(0.3 * n) + 1, n - low)))
        if self.rng.random() < PERSISTENT:
            return start, n
        return start, min(n, start + int(self.rng.integers(low, max(low + 1, int(high * n)))))

    def rise(self, s: int, e: int) -> np.ndarray:
        """0 before, growing to 1 over the segment, 1 after."""
        return np.clip((np.arange(len(self.t)) - s + 1) / max(1, e - s), 0, 1)

    def mark(self, s: int, e: int, kind: str, *roles: str) -> None:
        for role in roles:
            c = self.roles.index(role)
            self.label[s:e, c], self.type[s:e, c] = 1, TYPES.index(kind)


DOMAINS: dict[str, tuple[Callable[[Sample], None], float]] = {}
SCENARIOS: dict[str, dict[str, Callable[[Sample], None]]] = {}


def domain(name: str, step: float) -> Callable:
    def add(f: Callable[[Sample], None]) -> Callable[[Sample], None]:
        DOMAINS[name] = (f, step)
        SCENARIOS.setdefault(name, {})
        return f

    return add


def scenario(*domains: str) -> Callable:
    def add(f: Callable[[Sample], None]) -> Callable[[Sample], None]:
        for d in domains:
            SCENARIOS.setdefault(d, {})[f.__name__] = f
        return f

    return add


def change(s: Sample, kind: str, edits: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]], low: int = 8, high: float = 0.25) -> None:
    """Apply one edit a role to a common segment; an edit gets the segment's values and its rise from 0 to 1."""
    a, b = s.segment(low, high)
    ramp = s.rise(a, b)[a:b]
    for role, edit in edits.items():
        x = s.at(role)
        x[a:b] = edit(x[a:b].copy(), ramp)
    s.mark(a, b, kind, *edits)


def add_scenarios(domain_: str, table: dict[str, tuple[str, dict[str, Callable]]]) -> None:
    for name, (kind, edits) in table.items():
        SCENARIOS[domain_][name] = lambda s, kind=kind, edits=edits: change(s, kind, edits)


by = lambda k: lambda x, r: x * k
plus = lambda d: lambda x, r: x + d
grow = lambda d: lambda x, r: x + d * r
shrink = lambda k: lambda x, r: x * (1 - (1 - k) * r)
hold = lambda x, r: np.full(len(x), x[0])
zero = lambda x, r: np.zeros(len(x))
level = lambda v: lambda x, r: np.full(len(x), float(v))
jagged = lambda d: lambda x, r: x + d * np.where(np.arange(len(x)) % 2, 1, -1)
once = lambda k: lambda x, r: np.where(np.arange(len(x)) == len(x) // 2, x * k, x)


@domain("finance", 60.0)
def finance(s: Sample) -> None:
    vol = 0.001 * np.exp(s.walk(0.99, 0.4))
    price = 100 * np.exp(np.cumsum(s.noise() * vol))
    s.ready(price=price, volume=np.exp(8 + s.walk(0.9, 0.3) + 200 * vol))


add_scenarios("finance", {
    "flash_crash": ("spike", {"price": lambda x, r: x * (1 - 0.08 * np.sin(np.pi * r)), "volume": by(4)}),
    "trading_halt": ("flatline", {"price": hold, "volume": zero}),
    "fat_finger": ("spike", {"price": once(1.15)}),
    "volatility_burst": ("noise_burst", {"price": lambda x, r: x * (1 + 0.01 * np.where(np.arange(len(x)) % 2, 1, -1)), "volume": by(2)}),
})


@domain("manufacturing", 300.0)
def manufacturing(s: Sample) -> None:
    on = (s.hours() % 8 < 7.5).astype(float)
    rpm = s.smooth(1500 * on, 2) + s.noise(5)
    load = 0.6 + s.walk(0.98, 0.1)
    s.ready(rpm=rpm, current=rpm / 1500 * (10 + 6 * load) + s.noise(0.2), vibration=0.5 + rpm / 1500 * 1.5 + s.noise(0.1), temperature=25 + s.smooth(rpm / 1500 * 40 * load, 20) + s.noise(0.3))


add_scenarios("manufacturing", {
    "bearing_wear": ("drift", {"vibration": grow(2.5), "temperature": grow(12)}),
    "unexpected_stop": ("level_shift", {"rpm": zero, "current": by(0.1), "vibration": by(0.2)}),
    "current_mismatch": ("correlation_break", {"current": by(1.6)}),
    "overheat": ("drift", {"temperature": grow(35)}),
})


@domain("space", 60.0)
def space(s: Sample) -> None:
    phase = (s.t / 5400) % 1
    sun = (phase < 0.62).astype(float)
    charge = s.smooth(sun, 25)
    wheel = 2000 + 300 * np.sin(s.t / 9000) + s.walk(0.99, 40)
    s.ready(solar_current=8 * sun + s.noise(0.1), battery_voltage=26 + 4 * charge + s.noise(0.05), panel_temp=-40 + 110 * s.smooth(sun, 12) + s.noise(0.5), wheel_speed=wheel, attitude_error=np.abs(s.noise(0.02)))


add_scenarios("space", {
    "single_event_upset": ("spike", {"wheel_speed": once(1.8)}),
    "battery_degradation": ("drift", {"battery_voltage": grow(-3)}),
    "wheel_friction": ("drift", {"wheel_speed": shrink(0.6), "attitude_error": grow(0.3)}),
    "heater_stuck": ("level_shift", {"panel_temp": plus(45)}),
    "solar_string_failure": ("level_shift", {"solar_current": by(0.6)}),
})


@domain("vitals", 60.0)
def vitals(s: Sample) -> None:
    night = s.pulse(3, 3)
    s.ready(heart_rate=75 - 12 * night + s.walk(0.95, 4), spo2=np.minimum(100, 97.5 + s.walk(0.9, 0.6)), resp_rate=16 - 3 * night + s.walk(0.9, 1), body_temp=36.8 - 0.3 * night + s.walk(0.99, 0.1), sys_bp=122 - 10 * night + s.walk(0.97, 5))


add_scenarios("vitals", {
    "tachycardia": ("level_shift", {"heart_rate": plus(55), "resp_rate": plus(6)}),
    "desaturation": ("drift", {"spo2": grow(-14), "heart_rate": grow(18)}),
    "fever": ("drift", {"body_temp": grow(2.4), "heart_rate": grow(22)}),
    "probe_off": ("missing_data", {"spo2": zero, "heart_rate": zero}),
    "motion_artifact": ("noise_burst", {"heart_rate": jagged(25), "spo2": jagged(4)}),
    "hypotension": ("drift", {"sys_bp": grow(-45), "heart_rate": grow(30)}),
})


@domain("ecg", 0.004)
def ecg(s: Sample) -> None:
    n = len(s.t)
    phase = np.cumsum(1 / (200 + s.walk(0.999, 8))) % 1
    bell = lambda c, w, h: h * np.exp(-0.5 * ((phase - c) / w) ** 2)
    beat = bell(0.2, 0.025, 0.15) + bell(0.34, 0.008, -0.12) + bell(0.36, 0.01, 1.1) + bell(0.385, 0.009, -0.25) + bell(0.6, 0.045, 0.3)
    s.ready(lead_1=beat + s.noise(0.02), lead_2=0.8 * beat + s.noise(0.02), lead_3=-0.4 * beat + s.noise(0.02) + np.zeros(n))


add_scenarios("ecg", {
    "ectopic_beat": ("pattern_change", {"lead_1": lambda x, r: x + 1.6 * np.sin(np.pi * r), "lead_2": lambda x, r: x + 1.2 * np.sin(np.pi * r)}),
    "lead_off": ("flatline", {"lead_1": zero}),
    "muscle_noise": ("noise_burst", {"lead_1": jagged(0.4), "lead_2": jagged(0.4)}),
})


@domain("glucose", 300.0)
def glucose(s: Sample) -> None:
    meals = sum(s.pulse(h + s.rng.normal(0, 0.4), 1.1) for h in (8, 13, 19))
    s.ready(glucose=105 + 55 * s.smooth(meals, 6) + s.walk(0.97, 8))


add_scenarios("glucose", {"hypoglycemia": ("drift", {"glucose": grow(-60)}), "compression_low": ("level_shift", {"glucose": by(0.6)}), "hyperglycemia": ("drift", {"glucose": grow(140)})})


@domain("bioreactor", 600.0)
def bioreactor(s: Sample) -> None:
    growth = 1 / (1 + np.exp(-8 * (np.linspace(0, 1, len(s.t)) - 0.5)))
    s.ready(optical_density=0.1 + 18 * growth + s.noise(0.1), culture_temp=37 + s.noise(0.05), ph=7 - 0.1 * ((s.t / 7200) % 1) + s.noise(0.01), dissolved_oxygen=90 - 55 * growth + s.noise(0.8), stirrer_rpm=300 + 400 * growth + s.noise(4), co2_offgas=0.5 + 5 * growth + s.noise(0.05))


add_scenarios("bioreactor", {
    "contamination": ("drift", {"dissolved_oxygen": grow(-30), "ph": grow(-0.6), "co2_offgas": grow(3)}),
    "temp_controller": ("drift", {"culture_temp": grow(4)}),
    "ph_probe_fouling": ("flatline", {"ph": hold}),
    "stirrer_failure": ("level_shift", {"stirrer_rpm": by(0.1), "dissolved_oxygen": by(0.4)}),
})


@domain("energy", 900.0)
def energy(s: Sample) -> None:
    sun = np.maximum(0, np.sin((s.hours() - 6) / 12 * np.pi)) * (s.hours() > 6) * (s.hours() < 18) * np.clip(0.8 + s.walk(0.95, 0.15), 0, 1)
    wind = np.maximum(0, 8 + s.walk(0.98, 3))
    power = 2000 / (1 + np.exp(-(wind - 8) / 1.5))
    s.ready(irradiance=950 * sun, pv_power=430 * sun + s.noise(2), module_temp=15 + 35 * sun + s.noise(0.5), wind_speed=wind, wind_power=power + s.noise(10), rotor_rpm=np.clip(wind * 1.6, 0, 18) + s.noise(0.1), grid_load=600 + 250 * s.pulse(19, 3) + 120 * s.pulse(9, 2) + s.noise(8))


add_scenarios("energy", {
    "inverter_trip": ("level_shift", {"pv_power": zero}), "soiling": ("drift", {"pv_power": shrink(0.6)}), "curtailment": ("level_shift", {"wind_power": by(0.4)}),
    "anemometer": ("flatline", {"wind_speed": hold}), "yaw": ("drift", {"wind_power": shrink(0.55)}), "blackout": ("level_shift", {"grid_load": zero}),
})


@domain("it", 60.0)
def it(s: Sample) -> None:
    requests = np.maximum(1, 400 + 300 * s.pulse(15, 5) + s.walk(0.9, 30))
    saw = (s.t / 3600) % 1
    s.ready(requests=requests, cpu=10 + requests / 12 + s.noise(2), latency=80 + requests / 20 + np.abs(s.noise(6)), errors=np.maximum(0, s.noise(1) + 1), memory=55 + 12 * saw + s.noise(0.5))


add_scenarios("it", {
    "memory_leak": ("drift", {"memory": grow(35)}), "outage": ("level_shift", {"requests": zero, "cpu": by(0.1), "errors": plus(80)}), "latency_regression": ("level_shift", {"latency": by(2.2)}),
    "error_burst": ("noise_burst", {"errors": plus(40)}), "traffic_surge": ("level_shift", {"requests": by(2.5), "cpu": by(1.8), "latency": by(1.6)}),
})


@domain("water", 300.0)
def water(s: Sample) -> None:
    use = 40 + 30 * s.pulse(7.5, 1.5) + 35 * s.pulse(20, 2) + s.walk(0.9, 3)
    s.ready(flow=use, pressure=5 - use / 60 + s.noise(0.05), tank_level=3 + 1.2 * np.sin(s.t / 14400) + s.noise(0.02))


add_scenarios("water", {"leak": ("drift", {"flow": grow(25), "pressure": grow(-0.8)}), "pipe_burst": ("level_shift", {"flow": plus(90), "pressure": plus(-2.5)}), "pump_failure": ("drift", {"tank_level": grow(-2.2), "pressure": grow(-1.2)})})


@domain("environment", 600.0)
def environment(s: Sample) -> None:
    front = s.walk(0.995, 1)
    temp = 14 + 6 * np.sin((s.hours() - 9) / 24 * 2 * np.pi) - 3 * front + s.noise(0.2)
    s.ready(air_temp=temp, humidity=np.clip(70 - 2 * (temp - 14) + s.noise(1.5), 5, 100), air_pressure=1013 + 6 * front + s.noise(0.1), pm25=np.exp(2.3 + 0.4 * s.walk(0.97, 1)), rain=np.maximum(0, front - 1.2) * 3)


add_scenarios("environment", {"calibration_drift": ("drift", {"air_temp": grow(5)}), "humidity_stuck": ("flatline", {"humidity": hold}), "radiation_shield": ("level_shift", {"air_temp": plus(6)}), "pollution_episode": ("drift", {"pm25": lambda x, r: x * (1 + 6 * r)})})


@domain("retail", 3600.0)
def retail(s: Sample) -> None:
    promo = (s.rng.random(len(s.t)) < 0.01).astype(float)
    s.ready(sales=np.maximum(0, 50 + 60 * s.pulse(17, 4) + 80 * s.smooth(promo, 6) + s.noise(6)), price=20 - 4 * s.smooth(promo, 6) + s.noise(0.05))


add_scenarios("retail", {"stockout": ("level_shift", {"sales": zero}), "data_entry_error": ("spike", {"price": once(10)}), "demand_shift": ("level_shift", {"sales": by(1.9)})})


@domain("automotive", 1.0)
def automotive(s: Sample) -> None:
    speed = s.smooth(np.repeat(s.rng.choice([0, 30, 50, 90], len(s.t) // 60 + 1), 60)[: len(s.t)].astype(float), 12)
    s.ready(speed=speed + s.noise(0.3), engine_rpm=800 + 28 * speed + s.noise(20), coolant_temp=s.smooth(np.full(len(s.t), 90.0), 200) + s.noise(0.2), fuel_level=60 - np.cumsum(0.0004 + speed * 1e-5), battery_voltage=14.1 + s.noise(0.03))


add_scenarios("automotive", {
    "engine_overheat": ("drift", {"coolant_temp": grow(35)}), "thermostat": ("level_shift", {"coolant_temp": plus(-25)}), "clutch_slip": ("correlation_break", {"engine_rpm": by(1.5)}),
    "fuel_theft": ("level_shift", {"fuel_level": plus(-18)}), "alternator": ("drift", {"battery_voltage": grow(-2.3)}),
})


@domain("telecom", 900.0)
def telecom(s: Sample) -> None:
    users = 80 + 150 * s.pulse(20, 4) + s.walk(0.9, 10)
    s.ready(users=users, traffic=users * 3 + s.noise(12), prb_util=np.clip(users / 3 + s.noise(2), 0, 100), drop_rate=np.abs(0.4 + s.noise(0.1)))


add_scenarios("telecom", {"cell_outage": ("level_shift", {"users": zero, "traffic": zero, "prb_util": zero}), "sleeping_cell": ("level_shift", {"traffic": by(0.1), "users": by(0.3)}), "congestion": ("drift", {"prb_util": grow(45), "drop_rate": grow(3)})})


@domain("agriculture", 1800.0)
def agriculture(s: Sample) -> None:
    dry = (s.t / (2 * DAY)) % 1
    s.ready(soil_moisture=38 - 14 * dry + s.noise(0.2), soil_temp=17 + 4 * np.sin((s.hours() - 11) / 24 * 2 * np.pi) + s.noise(0.1), greenhouse_co2=650 + 120 * np.cos(s.hours() / 24 * 2 * np.pi) + s.noise(8))


add_scenarios("agriculture", {"irrigation_failure": ("drift", {"soil_moisture": grow(-18)}), "valve_stuck_open": ("drift", {"soil_moisture": grow(20)}), "co2_fault": ("level_shift", {"greenhouse_co2": plus(600)})})


@domain("chemical", 30.0)
def chemical(s: Sample) -> None:
    setpoint = np.repeat(s.rng.choice([340.0, 350, 360], len(s.t) // 400 + 1), 400)[: len(s.t)]
    temp = s.smooth(setpoint, 40) + s.noise(0.4)
    s.ready(reactor_temp=temp, reactor_pressure=2 + (temp - 340) * 0.05 + s.noise(0.02), feed_flow=12 + s.walk(0.95, 0.3), valve_position=50 + (setpoint - temp) * 4 + s.noise(0.5))


add_scenarios("chemical", {"thermal_runaway": ("drift", {"reactor_temp": lambda x, r: x + 60 * r**2, "reactor_pressure": lambda x, r: x + 4 * r**2}), "valve_stiction": ("flatline", {"valve_position": hold}), "feed_pump_trip": ("level_shift", {"feed_flow": zero})})


@domain("abstract", 60.0)
def abstract(s: Sample) -> None:
    k = int(s.rng.integers(2, 9))
    latent = [np.sin(2 * np.pi * np.arange(len(s.t)) / s.rng.uniform(20, 400)), s.walk(0.99), np.repeat(s.rng.normal(0, 1, len(s.t) // 97 + 1), 97)[: len(s.t)], (s.walk(0.9) > 1.2).astype(float)]
    mix = s.rng.normal(0, 1, (len(latent), k))
    x = np.stack(latent, 1) @ mix + s.rng.normal(0, 0.1, (len(s.t), k))
    s.ready(**{f"abstract_{i}": x[:, i] for i in range(k)})


@domain("coupled", 60.0)
def coupled(s: Sample) -> None:
    k = int(s.rng.integers(3, 7))
    n = len(s.t)
    x = np.zeros((n, k))
    for j in range(k):
        x[:, j] = s.walk(0.95)
        for parent in range(j):
            if s.rng.random() < 0.5:
                lag = int(s.rng.integers(0, 12))
                x[lag:, j] += s.rng.uniform(0.5, 1.5) * x[: n - lag, parent]
    s.ready(**{f"coupled_{i}": x[:, i] for i in range(k)})


def generic(s: Sample) -> str:
    """A fault of a random kind on a random channel, and on those that move with it now and then."""
    kind = str(s.rng.choice(TYPES[1:8]))
    role = str(s.rng.choice(s.roles))
    x = s.at(role)
    spread = max(np.median(np.abs(x - np.median(x))) * 1.4826, 1e-8 + x.std() * 0.1)
    size = float(np.exp(s.rng.normal(1.2, 0.5))) * spread * s.rng.choice([-1, 1])
    middle = float(np.median(x))
    edit = {
        "spike": lambda v, r: np.where(np.arange(len(v)) == len(v) // 2, v + 2 * size, v), "level_shift": plus(size), "flatline": hold, "drift": lambda v, r: v + size * r * r,
        "noise_burst": jagged(size), "pattern_change": lambda v, r: middle + size * np.sin(8 * np.pi * r), "correlation_break": lambda v, r: 2 * middle - v + size,
    }[kind]
    change(s, kind, {role: edit})
    return f"generic_{kind}"


def guarded(s: Sample, fault: Callable[[Sample], object]) -> bool:
    """Apply a fault, or nothing: it goes back unless it labels cells, moves each labelled channel by enough and stays
    off cells that have a label already."""
    before, labels, types = s.x.copy(), s.label.copy(), s.type.copy()
    fault(s)
    new = (s.label == 1) & (labels == 0)
    ok = new.any() and not ((s.label != labels) & (labels == 1)).any()
    for c in np.flatnonzero(new.any(0)):
        rows = new[:, c]
        spread = max(np.median(np.abs(before[:, c] - np.median(before[:, c]))) * 1.4826, before[:, c].std() * 0.1, 1e-8)
        moved = np.abs(s.x[rows, c] - before[rows, c]) / spread
        ok = ok and (moved.max() if s.type[rows, c][0] == TYPES.index("spike") else moved.mean()) >= LEAST_EFFECT
    if not ok:
        s.x[:], s.label[:], s.type[:] = before, labels, types
    return bool(ok)


def make(sample: int, seed: int, rows: int, names: list[str]) -> tuple[Sample, str, str]:
    """One sample: a domain, jittered times, and up to three faults."""
    rng = np.random.default_rng([seed, sample])
    name = str(rng.choice(names))
    build, step = DOMAINS[name]
    n = rows if rng.random() < 0.5 else int(rng.integers(max(64, rows // 4), rows + 1))
    s = Sample(rng, 1.7e9 + step * (np.arange(n) + rng.uniform(-0.05, 0.05, n)))
    build(s)
    done = []
    if rng.random() >= CLEAN:
        for _ in range(int(rng.integers(1, 4))):
            own = SCENARIOS[name]
            if own and rng.random() < 0.7:
                pick = str(rng.choice(sorted(own)))
                if guarded(s, own[pick]):
                    done.append(pick)
            else:
                got: list[str] = []
                if guarded(s, lambda x: got.append(generic(x))):
                    done += got
    return s, name, ",".join(done)


def generate(spark: SparkSession, samples: int, rows: int = 512, seed: int = 1, domains: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """``samples`` labelled series in long form, one row a cell."""
    names = sorted(domains or DOMAINS)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample in frame["id"].tolist():
                s, name, faults = make(sample, seed, rows, names)
                n, k = s.x.shape
                yield pd.DataFrame({
                    "sample": sample, "domain": name, "scenario": faults, "row_idx": np.repeat(np.arange(n), k), "timestamp": np.repeat(s.t, k), "channel": np.tile(np.arange(k), n),
                    "role": np.tile(np.array(s.roles, object), n), "value": s.x.ravel(), "label": s.label.ravel().astype(np.int32), "type": s.type.ravel().astype(np.int32),
                })

    return spark.range(0, samples, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(run, SCHEMA)
