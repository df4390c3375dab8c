"""Operators against plain Python on random input."""

import datetime
import math
import random
import statistics
from collections import Counter

import numpy as np
import pytest

from fieldtempo.functions import MIXED_ORDERS, parse_mixed
from fieldtempo.operators import chartdata, pace
from tests.frames import daily


def _random_text(rng: random.Random) -> str:
    """A date in one of the orders, sometimes impossible, with any separators."""
    day, month, year = rng.randint(0, 33), rng.randint(0, 14), rng.randint(1965, 2068)
    clock = [rng.randint(0, 25), rng.randint(0, 61), rng.randint(0, 61)]
    order, clock_part = rng.choice(MIXED_ORDERS).split()
    first = [day, month] if order == "dmy" else [month, day]
    pad = rng.choice(["{}", "{:02d}"])
    date_text = rng.choice("/-. ").join([*(pad.format(n) for n in first), str(year)])
    clock_text = ":".join(f"{n:02d}" for n in clock[: len(clock_part)])
    return rng.choice(["", " "]) + date_text + rng.choice([" ", "  ", "T"]) + clock_text


def _read(text: str) -> datetime.datetime | None:
    """The first order that gives a real date and time."""
    tidy = text.replace("T", " ")
    for mark in "/-.:":
        tidy = tidy.replace(mark, " ")
    numbers = [int(n) for n in tidy.split()]
    for order in MIXED_ORDERS:
        date_part, clock_part = order.split()
        if len(numbers) != 3 + len(clock_part):
            continue
        parts = dict(zip(date_part, numbers))
        try:
            return datetime.datetime(parts["y"], parts["m"], parts["d"], *numbers[3:])
        except ValueError:
            continue
    return None


def test_mixed_dates(spark):
    rng = random.Random(11)
    texts = [_random_text(rng) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    parsed = {row.t: row.ts for row in parse_mixed(frame, "t", "ts").collect()}
    wrong = {t: (parsed[t], _read(t)) for t in texts if parsed[t] != _read(t)}
    assert wrong == {}
    readable = sum(ts is not None for ts in parsed.values())
    assert 300 < readable < len(parsed) - 300


@pytest.mark.parametrize("seed", [1, 2])
def test_trim(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([rng.gauss(10, 2), rng.uniform(0, 40)]) for _ in range(80)]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    reach = 1.5 * (q3 - q1)
    expected = sorted(v for v in values if q1 - reach <= v <= q3 + reach)
    assert len(expected) < len(values)
    kept = pace.iqr_trim(daily(spark, values)).collect()
    assert sorted(row.daily_avg for row in kept) == pytest.approx(expected)


@pytest.mark.parametrize("bins", [15, 20])
def test_histogram(spark, bins):
    rng = random.Random(bins)
    values = [round(rng.uniform(1, 9), 2) for _ in range(200)]
    width = (max(values) - min(values)) / (bins - 1)
    edges = [min(values) + (i - 0.5) * width for i in range(bins + 1)]
    expected = Counter()
    for value in values:
        expected[next(i for i in range(bins) if value <= edges[i + 1] + 1e-9)] += 1
    table = chartdata.histogram(daily(spark, values), bins=bins).orderBy("bin").collect()
    assert [row["count"] for row in table] == [expected[i] for i in range(bins)]
    assert [row.bin_start for row in table] == pytest.approx(edges[:-1])
    assert [row.density for row in table] == pytest.approx(
        [expected[i] / (len(values) * width) for i in range(bins)]
    )


def test_density(spark):
    rng = random.Random(5)
    values = [rng.gauss(10, 3) for _ in range(60)]
    q1, q3 = np.quantile(values, [0.25, 0.75])
    bw = 0.9 * min(statistics.stdev(values), (q3 - q1) / 1.34) * len(values) ** -0.2
    grid = np.linspace(min(values), max(values), 512)
    kernels = np.exp(-0.5 * ((grid[:, None] - np.array(values)[None, :]) / bw) ** 2)
    expected = kernels.sum(axis=1) / (len(values) * bw * math.sqrt(2 * math.pi))
    rows = chartdata.density(daily(spark, values)).orderBy("point").collect()
    assert [row.x for row in rows] == pytest.approx(list(grid))
    assert [row.density for row in rows] == pytest.approx(list(expected))
