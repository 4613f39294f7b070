import pytest
from hypothesis import given
from hypothesis import strategies as st

from scaleloom.plans import lattice as L
from scaleloom.plans import neighborhood as N


@given(st.integers(1, 10**6))
def test_factorize_round_trip(n):
    assert L.to_int(L.factorize(n)) == n
    assert all(p > 1 and e > 0 for p, e in L.factorize(n).items())


@given(st.integers(1, 5000), st.integers(1, 5000))
def test_vectors_add_as_integers_multiply(a, b):
    assert L.to_int(L.vec_add(L.factorize(a), L.factorize(b))) == a * b
    assert L.divisors(a) == [d for d in range(1, a + 1) if a % d == 0]


def test_factorize_refuses():
    for n in (0, -4):
        with pytest.raises(ValueError):
            L.factorize(n)


def test_plans():
    p = L.SamplingPlan(3600, 250)
    assert p.cbin == 300 and p.windows == (300, 600, 900, 1200, 1800, 3600) and p.prime_basis == {2: 2, 3: 1}
    assert p.scales == (1, 2, 3, 4, 6, 12) and p.n_values == p.scales
    assert L.SamplingPlan(86400, 60).prime_basis == {2: 5, 3: 2, 5: 1}
    assert len(L.SamplingPlan(360, 1).windows) == 24
    assert L.SamplingPlan(3600, 250) == L.SamplingPlan(3600, 300) and len({L.SamplingPlan(3600, 250), L.SamplingPlan(3600, 300)}) == 1
    q = L.SamplingPlan.from_windows([3600, 86400], 60)
    assert q.cbin == 60 and q.horizon == 86400 and q.hops == (60, 60)
    assert L.SamplingPlan(86400, 3600, (3600, 21600), {21600: 10800}).n_values == (1, 2)
    assert p.cover(300) == 600 and p.cover(3600) is None and (300, 1800) not in p.cover_edges() and (600, 1800) in p.cover_edges()
    assert "3600" in p.describe() and "->" in p.show_lattice()


@pytest.mark.parametrize("args", [(0, 1), (10, 0), (10, 20), (360, 1, "sparse"), (360, 1, ()), (360, 1, (7,)), (360, 1, (10, 20), (3, 3)), (360, 1, (10, 20), (5,))])
def test_bad_plans(args):
    with pytest.raises(ValueError):
        L.SamplingPlan(*args)


def test_helpers():
    assert L.horizon_for([4, 6]) == 12 and L.suggest_cbin(2, [4, 6]) == 2
    with pytest.warns(UserWarning):
        assert L.suggest_cbin(5, [4, 6]) == 2
    assert [L.parse_duration(x) for x in ("90s", "5m", "2h", "1d", "1w", 7, "12")] == [90, 300, 7200, 86400, 604800, 7, 12]
    with pytest.raises(ValueError):
        L.parse_duration("5 years")
    assert len(L.eeg_plan().windows) == 25 and L.eeg_plan().cbin == 256
    assert len(L.geomagnetic_plan().windows) == 28 and 27 * 86400 in L.geomagnetic_year_plan(27 * 86400 * 40).windows
    assert L.equities_plan().windows == (1, 2, 3, 4, 5, 6, 8, 9, 10, 12, 15, 18, 20, 24, 30, 36, 40, 45, 60, 360)
    assert L.derive_plan(1, (12,), None).windows == (1, 2, 3, 4, 6, 12) and L.derive_plan(2, (4, 6), None).horizon == 12 and L.derive_plan(None, (), None).horizon == 360


@given(st.integers(2, 7), st.integers(1, 60))
def test_flips_follow_valuations(p, n):
    f = L.FlipFlop(p).expand_to(n)
    assert f.terms[n - 1] == L.valuation(n, p) == f.valuation_at(n)
    assert f.coverage >= n and f.coverage == p**f.depth


def test_neighborhood(spark):
    rows = {(r.prime, r.n): r.valuation for r in N.neighborhood(spark, 36, 4).collect()}
    assert rows[2, 36] == 2 and rows[3, 36] == 2 and rows[37, 37] == 1 and rows[2, 32] == 5 and rows[2, 35] == 0
    grid = N.neighborhood_from_vector(spark, {2: 2, 3: 2}, 1)
    assert {r.n for r in grid.collect()} == {35, 36, 37} and "36" in N.show(grid)
    res = {r.n: (r.residual, r.is_prime_column) for r in N.residuals(N.neighborhood(spark, 10, 4, [2, 3])).collect()}
    assert res[10] == (5, True) and res[12] == (1, False) and res[7] == (7, False)
    with pytest.raises(ValueError):
        N.neighborhood(spark, 0, 3)
