"""Histogram in one scan, box plots in two, with values that lie on and beside edges and fences."""

import math
import random

import numpy as np
import pytest

from segstats.operators import dist
from segstats.sources.tables import load_table

SF = "/root/testdata/sf0.001"
LABELS = {"measure": "value", "label": "event_type", "populations": ("click", "view")}


@pytest.fixture
def scans(spark, monkeypatch):
    """Number of file scans of every plan that runs, whatever starts it."""
    seen = []
    frame = type(spark.range(1))
    for name in ("collect", "first", "checkpoint"):
        original = getattr(frame, name)

        def counted(df, *args, original=original, **kwargs):
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            seen.append(plan.count("FileScan"))
            return original(df, *args, **kwargs)

        monkeypatch.setattr(frame, name, counted)
    return seen


def test_histogram_reads_its_table_once(spark, scans):
    dist.histogram_by_label(load_table(spark, SF, "events"), **LABELS).collect()
    assert sum(scans) == 1


def test_box_plot_reads_its_table_twice(spark, scans):
    dist.box_plot_stats(load_table(spark, SF, "events"), **LABELS).collect()
    assert sum(scans) == 2


def population(spark, values):
    return spark.createDataFrame([(float(v), "No") for v in values], "tenure double, Churn string").repartition(4)


def box(values, whis=1.5):
    """Fences, whiskers and fliers by hand."""
    v = sorted(map(float, values))

    def at(p):
        pos = p * (len(v) - 1)
        k0, k1 = math.floor(pos), math.ceil(pos)
        return v[k0] if k0 == k1 else (k1 - pos) * v[k0] + (pos - k0) * v[k1]

    q1, q3 = at(0.25), at(0.75)
    reach = whis * (q3 - q1)
    inner = [x for x in v if q1 - reach <= x]
    outer = [x for x in v if x <= q3 + reach]
    fliers = sum(x < q1 - reach or x > q3 + reach for x in v)
    return (q1, q3, min(q1, inner[0]) if inner else q1, max(q3, outer[-1]) if outer else q3, fliers)


R = random.Random(11)
TABLES = {
    "normal": [R.gauss(0, 1) for _ in range(30_000)],
    "heavy tails": [R.gauss(0, 1) / max(R.random(), 1e-9) for _ in range(30_000)],
    "one value holds a third": [5.0] * 10_000 + [R.uniform(0, 10) for _ in range(20_000)],
    "on the fences": [0, 0, 0, 1, 1, 1, 2, 2, 2] * 500 + [-3.0, 5.0, math.nextafter(-3, -9), math.nextafter(5, 9)],
    "one value": [7.0] * 50,
    "tiny": [3.0],
    "two": [1e300, -1e300],
    "infinite": [math.inf, -math.inf, *range(20)],
    "large, close": [1e15 + k / 8 for k in range(20_000)],
}


@pytest.mark.parametrize("whis", [0.0, 1.5])
@pytest.mark.parametrize("name", sorted(TABLES))
def test_box_plot_by_hand(spark, name, whis):
    r = dist.box_plot_stats(population(spark, TABLES[name]), whis=whis).first()
    assert (r["q1"], r["q3"], r["lower_whisker"], r["upper_whisker"], r["flier_count"]) == box(TABLES[name], whis)


def test_fences_lie_in_their_ranges():
    r = random.Random(5)
    for _ in range(2_000):
        a, b, c, d = sorted(r.choice([r.gauss(0, 10), r.uniform(0, 1e9), 0.1 * r.randrange(50)]) for _ in range(4))
        q1, q3, whis = r.uniform(a, b), r.uniform(c, d), r.choice([0.0, 1.5, 3.0, 0.1])
        for fence, (low, high) in zip(dist._fence_values(q1, q3, whis), dist._fence_ranges([(a, b), (b, c), (c, d)], whis)):
            assert low <= fence <= high


@pytest.mark.parametrize("width", [6.0, 0.1, 0.3, 2.5, 1e-3])
def test_bins_hold_the_values_between_their_edges(spark, width):
    r = random.Random(2)
    on = [k * width for k in range(-40, 41)]
    values = [*on, *[math.nextafter(x, 1e9) for x in on], *[math.nextafter(x, -1e9) for x in on], *[r.uniform(-40 * width, 40 * width) for _ in range(300)]]
    df = population(spark, values)
    edges = [e["edge"] for e in dist.shared_bin_edges(df, width=width).orderBy("edge_index").collect()]
    got = [b for b in dist.histogram_by_label(df, width=width).collect() if b["churn_status"] == "No"]
    assert [b["bin_low"] for b in got] == edges[:-1] and [b["bin_high"] for b in got] == edges[1:]
    assert [b["observation_count"] for b in got] == np.histogram(values, bins=edges)[0].tolist()


@pytest.mark.parametrize("values, width", [([1.0, math.inf], 6), ([1.0, 1e30], 1e-3)])
def test_ranges_without_countable_bins_are_refused(spark, values, width):
    for make in (dist.shared_bin_edges, dist.histogram_by_label):
        with pytest.raises(ValueError, match="infinite range|too small"):
            make(population(spark, values), width=width)
