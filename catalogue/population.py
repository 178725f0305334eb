"""Population share queries."""
from __future__ import annotations

from catalogue import query
from catalogue.sql import CITY_POP, MEETS_CITY, SETTLEMENT_POP, SHARE_CTES, ctes
from quartier.fixtures import fixture, vector_fixture
from quartier.operators.spatial import spatial_join
from quartier.operators.zonal import zonal_sum
from quartier.plans import population as plan


def inputs(spark, sf):
    return (
        vector_fixture(spark, sf, "f_cities"),
        vector_fixture(spark, sf, "f_settlements"),
        fixture(spark, sf, "f_pop"),
    )


def rounded(df):
    return df.selectExpr(
        *[c for c in df.columns if c != "proportion_informal"], "round(proportion_informal, 6) AS proportion_informal"
    )


def share(spark, sf):
    return rounded(plan.population_share(*inputs(spark, sf)))


@query("x7_population_share", SHARE_CTES + "SELECT * FROM share")
def population_share(spark, sf):
    return share(spark, sf)


@query(
    "a1_zonal_sum_settlements",
    ctes("f_settlements", "f_pop", spop=SETTLEMENT_POP)
    + "SELECT s.sid, coalesce(p.v,0) AS total FROM f_settlements s LEFT JOIN spop p ON p.sid=s.sid",
)
def zonal_settlements(spark, sf):
    _, settlements, pop = inputs(spark, sf)
    return zonal_sum(pop, settlements, ["sid"])


@query(
    "a2_masked_sum_cities",
    ctes("f_cities", "f_pop", t=CITY_POP)
    + "SELECT c.country, c.city, coalesce(t.v,0) AS total FROM f_cities c LEFT JOIN t ON t.city=c.city AND t.country=c.country",
)
def zonal_cities(spark, sf):
    cities, _, pop = inputs(spark, sf)
    return zonal_sum(pop, cities, ["country", "city"], block=800.0)


@query(
    "x7_settlement_population",
    ctes("f_settlements", "f_pop", spop=SETTLEMENT_POP)
    + "SELECT s.sid, s.country, s.kind, coalesce(p.v,0) AS estimated_population FROM f_settlements s LEFT JOIN spop p ON p.sid=s.sid",
)
def settlement_population(spark, sf):
    _, settlements, pop = inputs(spark, sf)
    return plan.settlement_population(settlements, pop).select("sid", "country", "kind", "estimated_population")


@query(
    "j3_settlement_city_pairs",
    ctes("f_cities", "f_settlements")
    + f"SELECT c.country, c.city, s.sid FROM f_cities c JOIN f_settlements s ON s.country=c.country AND {MEETS_CITY}",
)
def settlement_city_pairs(spark, sf):
    cities, settlements, _ = inputs(spark, sf)
    pairs = spatial_join(settlements, cities, 2000.0, equal=["country"])
    return pairs.selectExpr("country", "r_city AS city", "l_sid AS sid")
