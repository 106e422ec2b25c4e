"""Dose limits and hazard bands as column expressions; all arithmetic in DOUBLE, invalid inputs give NULL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mean route safety factors from (low, high) pairs, and the pair of any other route.
ROUTE_FACTORS = {"oral": (10, 100), "topical": (10, 100), "inhalation": (100, 1000), "parenteral": (1000, 10000)}
OTHER_ROUTE = (100, 1000)
#: Species factors, exposure ladder (days, factor) and the same for longer studies; OEL cut-offs of bands 1 to 4.
SPECIES = {"rat": 5.0, "mouse": 12.0, "dog": 2.0, "rabbit": 2.5, "monkey": 3.0, "human": 1.0}
OTHER_SPECIES = 10.0
DURATIONS = ((28, 10.0), (90, 5.0), (180, 2.0))
BANDS = ((1000.0, 1), (100.0, 2), (10.0, 3), (1.0, 4))
ACUTE = (5.0, 50.0, 300.0, 2000.0, 5000.0)
#: Default body weight in kg, and floors of the bands of severe endpoints.
BODY_WEIGHT = 50.0
FLOORS = {"genotoxic": 5, "carcinogenic": 4, "reproductive_toxicant": 4}


def pde(pod: Column, factors: list[Column], weight: Column | float = BODY_WEIGHT) -> Column:
    """Permitted daily exposure: point of departure times weight over the product of the factors; NULL if that is 0."""
    product = reduce(lambda a, b: a * b, factors)
    return F.when(product != 0, pod * F.lit(weight) / product)


def ladder(x: Column, rungs, below, above) -> Column:
    """The value of the first rung that x doesn't exceed (below) or that it reaches, by the given test."""
    out = reduce(lambda a, r: a.when(below(x, r[0]), F.lit(r[1])), rungs[1:], F.when(below(x, rungs[0][0]), F.lit(rungs[0][1])))
    return F.when(x.isNotNull(), out.otherwise(F.lit(above)))


def duration_factor(days: Column) -> Column:
    return ladder(days, DURATIONS, lambda x, r: x <= r, 1.0)


def species_factor(species: Column) -> Column:
    table = F.create_map(*[F.lit(v) for kv in SPECIES.items() for v in kv])
    return F.coalesce(F.element_at(table, F.lower(species)), F.lit(OTHER_SPECIES))


def band(oel: Column) -> Column:
    return ladder(oel, BANDS, lambda x, r: x >= r, 5)


def acute_category(ld50: Column) -> Column:
    return ladder(ld50, tuple((r, i + 1) for i, r in enumerate(ACUTE)), lambda x, r: x <= r, len(ACUTE) + 1)


def floor_band(genotoxic: Column, carcinogenic: Column, reproductive: Column) -> Column:
    """The greatest floor of the endpoints that are TRUE; NULL if none is."""
    return F.greatest(*[F.when(c, F.lit(FLOORS[k])) for k, c in zip(FLOORS, (genotoxic, carcinogenic, reproductive), strict=True)])


def recommended_band(point: Column, floor: Column, *endpoints: Column) -> Column:
    """The greater of point and floor, and one more, 5 at most, while an endpoint is unknown."""
    known = reduce(lambda a, b: a & b, [c.isNotNull() for c in endpoints])
    base = F.greatest(point, floor)
    return F.when(point.isNotNull(), F.when(known, base).otherwise(F.least(F.lit(5), base + 1)))


def route_factor(route: Column) -> Column:
    table = F.create_map(*[F.lit(v) for k, (a, b) in ROUTE_FACTORS.items() for v in (k, (a + b) / 2)])
    return F.coalesce(F.element_at(table, F.lower(route)), F.lit(sum(OTHER_ROUTE) / 2))


def maco_methods(mbs: Column, tdd: Column, pde_: Column, dose: Column, ld50: Column, route: Column, weight: Column | float = BODY_WEIGHT) -> Column:
    """(value, place, method) of every method whose inputs are positive; NULL without a positive batch size and dose."""

    def when(c: Column, value: Column, i: int, name: str) -> Column:
        return F.when(c > 0, F.struct(value.alias("value"), F.lit(i).alias("place"), F.lit(name).alias("method")))

    methods = F.array_compact(
        F.array(
            when(pde_, pde_ * mbs / tdd, 0, "pde"),
            when(dose, dose * mbs / (F.lit(1000.0) * tdd), 1, "dose"),
            when(mbs, F.lit(10.0) * mbs, 2, "general"),
            when(ld50, ld50 * F.lit(weight) / F.lit(2000.0) * mbs / (route_factor(route) * tdd), 3, "noel"),
        )
    )
    return F.when((mbs > 0) & (tdd > 0), methods)


def maco(methods: Column) -> Column:
    """The least (value, place, method): among equal values the method named first."""
    return F.array_min(methods)
