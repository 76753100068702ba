"""The similarity joins against all pairs, and the weighted ratio against its definition written out plainly."""

import math
import os
import random

import pytest

from stockloom.functions import similarity as S
from stockloom.operators import geo, similarity


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def ratio(a, b):
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def partial(a, b):
    a, b = sorted((a, b), key=len)
    if not a:
        return 100.0 if not b else 0.0
    parts = [b[i:j] for i in range(len(b)) for j in range(i + 1, len(b) + 1) if j - i == len(a) or j - i < len(a) and (i == 0 or j == len(b))]
    return max(ratio(a, p) for p in parts)


def token_set(p, q):
    both, x, y = sorted(set(p) & set(q)), " ".join(sorted(set(p) - set(q))), " ".join(sorted(set(q) - set(p)))
    if not p or not q:
        return 0.0
    if both and (not x or not y):
        return 100.0
    s = " ".join(both)
    one, two = f"{s} {x}".strip(), f"{s} {y}".strip()
    found = [100.0 - 100.0 * (len(x) + len(y) - 2 * lcs(x, y)) / (len(one) + len(two))]
    return max(found + ([ratio(s, one), ratio(s, two)] if s else []))


def weighted(a, b):
    if not a or not b:
        return 0.0
    p, q = sorted(a.split()), sorted(b.split())
    long, short = max(len(a), len(b)), min(len(a), len(b))
    if long < 1.5 * short:
        return max(ratio(a, b), 0.95 * ratio(" ".join(p), " ".join(q)), 0.95 * token_set(p, q))
    scale = 0.9 if long <= 8 * short else 0.6
    tokens = 100.0 if set(p) & set(q) else max(partial(" ".join(p), " ".join(q)), partial(" ".join(sorted(set(p))), " ".join(sorted(set(q)))))
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * tokens)


WORDS = "de la el san santa villa vila palma burgo osma mar monte rio alto bajo norte sur puente real orense ourense x y a".split()


def names(rng, n):
    out = []
    for _ in range(n):
        w = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w = w[:k] + rng.choice(["", "e", "z", " "]) + w[k + rng.randint(0, 1) :]
        out.append(" ".join(w.split()))
    return out


def test_known_scores():
    """Figures that the public documentation of the ratio gives."""
    pairs = [("this is a test", "this is a new test!!!", 85.5), ("this is a word", "THIS IS A WORD", 21.428571), ("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 95.0), ("", "x", 0.0), ("same", "same", 100.0)]
    for a, b, want in pairs:
        assert S.weighted([a], [b])[0] == pytest.approx(want, abs=1e-5), (a, b)
    assert S.ratios(["this is a test"], ["this is a test!"])[0] == pytest.approx(96.551724) and S.partial_ratios(["this is a test"], ["this is a test!"])[0] == 100.0


def test_scores_equal_the_definition():
    rng = random.Random(4)
    a, b = names(rng, 1500), names(rng, 1500)
    a += ["", "a" * 70, "ab " * 40, "núñez \U0001f600", "x" * 64]
    b += ["b", "a" * 71 + "b", "ab " * 41 + "c", "nunez \U0001f600", "x" * 64]
    for x, y, got in zip(a, b, S.weighted(a, b), strict=True):
        assert got == pytest.approx(weighted(x, y), abs=1e-9), (x, y)


def test_weighted_matches_lose_nothing(spark):
    rng = random.Random(5)
    asked, known = [(i % 3, n) for i, n in enumerate(names(rng, 600))], [(i % 3, n) for i, n in enumerate(names(rng, 600))]
    got = {(r["p"], r["a"], r["b"]): r["score"] for r in similarity.weighted_matches(spark.createDataFrame([*asked, (0, None), (None, "villa")], "p int, q string"), spark.createDataFrame(known, "p int, c string"), ["p"], "q", "c").collect()}
    want = {(p, a, b): s for p, a in set(asked) for k, b in set(known) if p == k and len(a) >= 4 and len(b) >= 4 and (s := weighted(a, b)) >= 88}
    assert got == pytest.approx(want) and len(want) > 300


def test_near_names_lose_nothing(spark):
    rng = random.Random(6)
    own = [(i, i % 2, "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))) for i in range(400)]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    got = sorted(tuple(r) for r in similarity.near_name_pairs(spark.createDataFrame([*own, (999, 0, None)], "id int, k int, s string"), ["k"], "id", "s").collect())
    assert got == sorted((i, j) for i, k, s in own for j, m, t in own if i < j and k == m and 0 < edits(s, t) <= 2)


def test_price_bands_lose_nothing(spark):
    rng = random.Random(7)
    own = [(i, "m" if i % 2 else "n", None if i % 50 == 0 else float(round(rng.choice([100, 101, 102, 9000]) * rng.uniform(0.98, 1.03), 2)) if i % 9 else 0.0, i % 7) for i in range(300)] + [(900, "m", -5.0, 1), (901, "m", -5.0, 1), (902, None, 100.0, 1)]
    out = similarity.price_bands(spark.createDataFrame(own, "id int, k string, p double, t int"), ["k"], "id", "p", ["t"]).collect()
    want = {(i, j): (s, t) for i, k, p, s in own for j, m, q, t in own if i < j and k and k == m and p is not None and q is not None and p >= 0 and q >= 0 and abs(p - q) <= 0.02 * min(p, q)}
    assert {(r["a"], r["b"]): (r["a_t"], r["b_t"]) for r in out} == want and len(out) == len(want) > 1000


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_similar_sets_lose_nothing(spark, least):
    rng = random.Random(8)
    sets = {i: {min(int(rng.expovariate(0.05)), 60) for _ in range(rng.randint(1, 12))} for i in range(150)}
    sets |= {i: {1000 + i, 2000 + i, 5} for i in range(150, 170)}
    rows = [(i, x) for i, s in sets.items() for x in s]
    got = {(r["a"], r["b"]): (r["n_both"], r["jaccard"]) for r in similarity.similar_sets(spark.createDataFrame([*rows, rows[0], (3, None)], "id int, item int"), "id", "item", least).collect()}
    want = {(a, b): (n, n / len(s | t)) for a, s in sets.items() for b, t in sets.items() if a < b and (n := len(s & t)) and n / len(s | t) >= least}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(v[1] == pytest.approx(want[k][1]) for k, v in got.items())


def test_fuzzy_places(spark):
    known = spark.createDataFrame([("33", "33001", "san martin del rey aurelio"), ("33", "33002", "san martin de oscos"), ("42", "42043", "burgo de osma ciudad de osma"), ("07", "07040", "palma"), ("32", "32054", "ourense"), ("32", "32001", "ourense vella")], "province_code string, code string, c string")
    asked = spark.createDataFrame([("a", "33", "san martin"), ("b", "42", "burgo de osma"), ("c", "07", "palma de mallorca"), ("d", "32", "orense"), ("e", "32", "ou"), ("f", "33", "quxquz"), ("g", None, "palma")], "entity_ulid string, province_code string, name string")
    got = {r["entity_ulid"]: r["code"] for r in geo.fuzzy_places(asked, known).collect()}
    # a short form of two places is nobody's
    assert got == {"b": "42043", "c": "07040", "d": "32054"}
    assert math.isclose(weighted("palma de mallorca", "palma"), 90.0)


def test_places_as_adapters_bring_them(spark):
    provinces = spark.createDataFrame([("07", "Balears, Illes"), ("28", "Madrid"), ("32", "Ourense")], "code string, name string")
    towns = spark.createDataFrame([("07040", "Palma", "07", 39.5, 2.6), ("28001", "Acebeda, La", "28", 41.0, -3.6), ("28079", "Madrid", "28", 40.4, -3.7), ("32054", "Ourense", "32", 42.3, -7.8), ("32001", "Vila", "32", 42.1, -7.7), ("28002", "Vila", "28", 40.5, -3.3)], "code string, name string, province_code string, lat double, lon double")
    rows = [("a", "Illes Balears", "Palma de Mallorca", None, None), ("b", "28", "La Acebeda", None, None), ("c", "nowhere", "Palma", None, None), ("d", None, "Vila", 42.0, -7.0), ("e", None, None, None, None), ("f", "7", "Quxquz", None, None), ("g", "Ourense", "Orense", None, None), ("h", "99", "Vila", None, None)]
    got = {r["id"]: (r["province"], r["town"], r["tier"]) for r in geo.adapter_places(spark.createDataFrame(rows, "id string, province_name string, town_name string, lat double, lon double"), "id", provinces, towns).collect()}
    # Vila is in two provinces, so the name alone says nothing
    assert got == {"a": ("07", "07040", "named"), "b": ("28", "28001", "named"), "c": ("07", "07040", "city"), "d": ("32", None, "nearest"), "f": ("07", None, "named"), "g": ("32", "32054", "named")}


def test_price_links_equal_all_pairs(spark):
    """links and classes of price bands without their pairs, against all pairs; nulls, zeros, bounds met exactly, copies."""
    from decimal import Decimal

    prices = ["100.00", "102.00", "102.01", "104.04", "0.00", "0.00", "100.00", None, "-5.00", "-5.00", "200.00", "204.01", "99.99", "106.12", "106.13"]
    own = [(i, "k" if i % 5 else "m", p and Decimal(p)) for i, p in enumerate(prices * 2)] + [(90, None, Decimal("100.00"))]
    near = {(i, j) for i, a, p in own for j, b, q in own if i != j and a and a == b and p is not None and q is not None and abs(p - q) <= Decimal("0.02") * min(p, q)}
    up = {i: i for i, _, _ in own}
    for _ in own:
        for i, j in near:
            up[i] = up[j] = min(up[i], up[j])
    got = similarity.price_links(spark.createDataFrame(own, "id int, k string, p decimal(12,2)"), ["k"], "id", "p").collect()
    assert sorted(map(tuple, got)) == sorted((i, sum(x == i for x, _ in near), up[i]) for i, _, _ in own)


@pytest.mark.parametrize("most", [1, 2])
def test_near_names_of_crowded_pieces_lose_nothing(spark, most):
    """Numbered names, which have their beginning in common; their candidates do not grow with the square of the block."""
    rng = random.Random(9)
    own = {f"customer{rng.randint(0, 2000):06d}" for _ in range(300)} | {"n\U0001f600z" + "".join(rng.choice("aab") for _ in range(rng.randint(0, 6))) for _ in range(200)} | {"", "c", "cu"}

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(last + (x != y), row[j] + 1, row[j + 1] + 1)
        return row[-1]

    want = sorted(("k", a, b) for a in own for b in own if a < b and abs(len(a) - len(b)) <= most and edits(a, b) <= most)
    names = spark.createDataFrame([("k", s) for s in own], "k string, s string")
    for crowd in (0, 5, 64):
        assert sorted(map(tuple, similarity.near_names(names, ["k"], "s", most, crowd).collect())) == want
    assert len(want) > 300


def test_price_bands_of_decimals_lose_nothing(spark):
    """Bounds met exactly, zeros, negative and null prices; prices of as many digits as a decimal has."""
    from decimal import Decimal

    prices = ["100.00", "102.00", "102.01", "104.04", "0.00", "0.00", "0.01", "100.00", None, "-5.00", "-5.00", "200.00", "204.01", "99.99", "9999999999.99", "9803921568.62", "9803921568.61"]
    own = [(i, "k" if i % 5 else "m", p and Decimal(p)) for i, p in enumerate(prices * 2)] + [(90, None, Decimal("100.00"))]
    want = {(i, j) for i, a, p in own for j, b, q in own if i < j and a and a == b and p is not None and q is not None and p >= 0 and q >= 0 and abs(p - q) <= Decimal("0.02") * min(p, q)}
    for kind in ("decimal(12,2)", "decimal(30,2)"):
        got = [(r["a"], r["b"]) for r in similarity.price_bands(spark.createDataFrame(own, f"id int, k string, p {kind}"), ["k"], "id", "p").collect()]
        assert set(got) == want and len(got) == len(want) > 20


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_price_band_query_returns_the_pairs(spark):
    """the query names both cars of every pair, and its SQL is that of all pairs."""
    from stockloom.plans import catalog
    from stockloom.plans.fixtures import Inputs

    cars = Inputs(spark, "/root/testdata/sf0.001").car.select("vehicle_ulid", "make", "model", "price").collect()
    want = {(x[0], y[0]) for x in cars for y in cars if x[0] < y[0] and x[1:3] == y[1:3] and abs(x[3] - y[3]) * 50 <= min(x[3], y[3])}
    got = [tuple(r) for r in catalog.QUERIES["j7_price_band"](spark, "/root/testdata/sf0.001").select("a", "b").collect()]
    assert set(got) == want and len(got) == len(want) > 0
    assert "reach" not in catalog.ORACLE_SQL["j7_price_band"]
