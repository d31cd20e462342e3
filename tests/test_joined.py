"""Joined queries on tables made for one property."""

from oddslake.plans import catalogue


def test_signatures_cover_orders_of_any_size(spark, tmp_path):
    sizes = {1: 1, 2: 1, 3: 3, 4: 3, 5: 10, 6: 10, 7: 10, 8: 11}
    rows = [(order, line, "R", "F") for order, n in sizes.items() for line in range(n)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r["first_order"], r["n_orders"]) for r in catalogue.QUERIES["signature_match"](spark, str(tmp_path)).collect()}
    assert got == {(1, 2), (3, 2), (5, 3)}
