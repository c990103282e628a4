"""Holm products that lie half way between two values of six digits are rounded up, in the query and in its SQL."""

from decimal import ROUND_HALF_UP, Decimal

import duckdb
import pandas as pd

from barwright.plans import evidence as E


def test_halves_of_holm_products(spark):
    n, rows, wanted, k = 1500, [], {}, 0
    for place in range(n):
        m = n - place
        # The next p-value, in billionths, whose product ends with a half of the sixth digit, where there is one.
        k = next((x for x in range(k + 1, k + 1001) if x * m % 1000 == 500), k + 1)
        rows.append((place, "F", k / 1e9))
        product = Decimal(k * m) / 10 ** 9
        wanted[place] = max(wanted.get(place - 1, (Decimal(0),)), (product,))
    wanted = {place: float(min(Decimal(1), p).quantize(Decimal("0.000001"), ROUND_HALF_UP)) for place, (p,) in wanted.items()}
    table = pd.DataFrame(rows, columns=["l_suppkey", "family", "p"])
    got = {r["l_suppkey"]: r["holm_p"] for r in E.holm_rounded(spark.createDataFrame(rows, "l_suppkey bigint, family string, p double")).collect()}
    con = duckdb.connect()
    con.register("tests", table)
    ranked = "WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, l_suppkey) AS r, count(*) OVER (PARTITION BY family) AS n FROM tests)"
    sql = dict(con.execute(f"SELECT l_suppkey, holm_p FROM ({ranked} {E.HOLM_TAIL})").fetchall())
    assert got == wanted and sql == wanted
