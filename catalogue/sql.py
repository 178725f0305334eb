"""Pieces of checking SQL used by several queries."""
from quartier.fixtures import with_fixtures

# pixel centre inside a settlement (half-open borders, as in the library)
IN_SETTLEMENT = """(p.px>=s.xmin AND p.px<s.xmax AND p.py>=s.ymin AND p.py<s.ymax AND (s.kind='rect' OR
 (p.px-s.xmin)*(s.ymax-s.ymin)+(p.py-s.ymin)*(s.xmax-s.xmin)<(s.xmax-s.xmin)*(s.ymax-s.ymin)))"""
IN_CITY = "(p.px>=c.xmin AND p.px<c.xmax AND p.py>=c.ymin AND p.py<c.ymax)"
# closed rectangles meet, and for a triangle the nearest corner of the city lies on its side of the long edge
MEETS_CITY = """(s.xmin<=c.xmax AND c.xmin<=s.xmax AND s.ymin<=c.ymax AND c.ymin<=s.ymax AND (s.kind='rect' OR
 (greatest(c.xmin,s.xmin)-s.xmin)*(s.ymax-s.ymin)+(greatest(c.ymin,s.ymin)-s.ymin)*(s.xmax-s.xmin)
  <=(s.xmax-s.xmin)*(s.ymax-s.ymin)))"""


def ctes(*fixtures: str, **extra: str) -> str:
    """Fixture CTEs followed by further named CTEs."""
    head = with_fixtures(*fixtures) if fixtures else "WITH "
    more = ", ".join(f"{k} AS ({v})" for k, v in extra.items())
    return head + (", " if fixtures and more else "") + more + " "


SETTLEMENT_POP = f"SELECT s.sid, sum(p.b1) AS v FROM f_settlements s JOIN f_pop p ON {IN_SETTLEMENT} GROUP BY s.sid"
CITY_POP = f"SELECT c.country, c.city, sum(p.b1) AS v FROM f_cities c JOIN f_pop p ON {IN_CITY} GROUP BY 1,2"
SHARE = """SELECT c.country, c.city, coalesce(t.v,0) AS total_population, coalesce(i.v,0) AS informal_population,
 CASE WHEN coalesce(t.v,0)>0 THEN round(coalesce(i.v,0)/t.v,6) ELSE 0.0 END AS proportion_informal,
 'HRSL' AS dataset_used FROM f_cities c LEFT JOIN tot t ON t.city=c.city AND t.country=c.country
 LEFT JOIN inf i ON i.city=c.city AND i.country=c.country"""
INFORMAL = f"""SELECT c.country, c.city, sum(coalesce(sp.v,0)) AS v FROM f_cities c JOIN f_settlements s
 ON s.country=c.country AND {MEETS_CITY} LEFT JOIN spop sp ON sp.sid=s.sid GROUP BY 1,2"""
MEDIAN_POP = "SELECT px, py, median(b1) AS b1 FROM f_pop_images GROUP BY 1,2"
MEDIAN_SHARE_CTES = ctes(
    "f_cities", "f_settlements", "f_pop_images", f_pop=MEDIAN_POP, spop=SETTLEMENT_POP, tot=CITY_POP, inf=INFORMAL,
    share=SHARE.replace("HRSL", "median"),
)
SHARE_CTES = ctes("f_cities", "f_settlements", "f_pop", spop=SETTLEMENT_POP, tot=CITY_POP, inf=INFORMAL, share=SHARE)
