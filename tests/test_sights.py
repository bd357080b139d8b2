"""Lines of sight settled at homes against the test pair by pair."""

import numpy as np
import pytest

from viewfield.operators import sights, visibility
from viewfield.plans import queries
from viewfield.sources.fixtures import view

SF = "/root/testdata/sf0.001"
PAIRED = ["los1_mesh", "cov5_density", "cov5_decibels", "cov9_detectable", "cov10_snapshot"]


def _one_by_one(e, t, corners):
    out = np.zeros(t.shape[1], bool)
    with np.errstate(all="ignore"):
        for k in range(corners.shape[1]):
            a, m, c = (corners[i : i + 3, k : k + 1] for i in (0, 3, 6))
            out |= sights._meets(e, t, a, m, c, np.fmin(np.fmin(a, m), c), np.fmax(np.fmax(a, m), c))
    return out


@pytest.mark.parametrize("kind", ["spread", "ties", "far", "close"])
def test_triangles_that_are_left_out_meet_nothing(kind, monkeypatch):
    """Segments through corners, along edges, straight down, of no length, and values that are missing."""
    rng = np.random.default_rng(7)
    monkeypatch.setattr(sights, "TESTED", 50)
    make = {"spread": lambda *s: rng.normal(0, 20, s), "ties": lambda *s: rng.integers(-3, 4, s).astype(float), "far": lambda *s: rng.integers(-3, 4, s) * 1e5, "close": lambda *s: rng.integers(-20, 21, s) / 10.0}[kind]
    blocked = 0
    for n in range(300):
        e, t, corners = make(3), make(3, rng.integers(1, 30)), make(9, rng.integers(1, 12))
        if n % 5 == 0:
            t[:, 0] = e
        if n % 7 == 0:
            t[:2, -1], t[2, 0] = e[:2], np.nan
        if n % 11 == 0:
            corners[5, 0] = np.nan
        expected = _one_by_one(e, t, corners)
        assert (sights._blocked(e, t, corners) == expected).all()
        blocked += expected.sum()
    assert blocked > 100


def test_no_targets_and_no_triangles():
    assert sights._blocked(np.zeros(3), np.zeros((3, 0)), np.ones((9, 2))).shape == (0,)
    assert not sights._blocked(np.zeros(3), np.ones((3, 2)), np.zeros((9, 0))).any()


def test_settled_pairs_are_those_of_the_joins(spark, monkeypatch):
    monkeypatch.setattr(sights, "HANDED", 5)
    emitters = view(spark, SF, "emitters").union(spark.sql("SELECT 900L, 50e0, 50e0, CAST(NULL AS DOUBLE), 2L, 60e0, 0e0, CAST(NULL AS DOUBLE)")).union(spark.sql("SELECT 901L, 99999e0, 50e0, 5e0, 2L, 60e0, 0e0, 0e0"))
    targets = view(spark, SF, "targets").union(spark.sql("SELECT 901L, 51e0, 52e0, CAST(NULL AS DOUBLE)"))
    mesh = view(spark, SF, "mesh")
    pairs = visibility.pairs_within(emitters, targets, 60.0)
    for hidden, join in ((False, visibility.visible), (True, visibility.hidden)):
        settled = sights.settled(emitters, targets, mesh, 60.0, hidden)
        assert dict(settled.dtypes) == dict(pairs.dtypes)
        rows = lambda df: sorted(map(repr, df.select(sorted(pairs.columns)).collect()))
        expected = rows(join(pairs, mesh, emitters))
        assert rows(settled) == expected and expected


@pytest.mark.parametrize("name", PAIRED)
def test_pairs_meet_no_index_of_sectors(spark, name):
    """Such an index is joined pair by pair and held in memory for all emitters of a partition."""
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "sector" not in plan and "FlatMapGroupsInArrow" in plan
