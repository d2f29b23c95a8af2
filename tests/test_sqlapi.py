from polispark.plans import sqlapi


def test_functions(spark, sf):
    sqlapi.register(spark, sf)
    sqlapi.register(spark, sf)
    row = spark.sql("SELECT trigram_similarity('Elizabeth Warren', 'warren') s, us_fiscal_year(DATE '2023-10-01') f, us_fiscal_year(NULL) u, donation_strength(10000000) d, donation_strength(-1) z, clean_key(' Ab ') k").first()
    assert (round(row.s, 6), row.f, row.u, row.d, row.z, row.k) == (round(7 / 17, 6), "FY2024", "Unknown", 0.5, 0.0, "ab")
    every = spark.sql("SELECT count(*) n FROM officials_of(NULL, NULL)").first().n
    assert every == spark.sql("SELECT count(*) n FROM civic_officials").first().n
    assert spark.sql("SELECT count(*) n FROM officials_of('AL', 'democrat')").first().n == spark.sql("SELECT count(*) n FROM civic_officials WHERE state = 'AL' AND party = 'democrat'").first().n
    hub = spark.sql("SELECT from_id FROM civic_connections GROUP BY 1 ORDER BY count(*) DESC LIMIT 1").first().from_id
    n = spark.sql(f"SELECT count(*) n FROM edges_at('{hub}')").first().n
    assert n == spark.sql(f"SELECT sum(int(from_id = '{hub}') + int(to_id = '{hub}')) n FROM civic_connections").first().n
    top = spark.sql("SELECT official_id o, sum(amount_cents) s FROM civic_contributions WHERE official_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC LIMIT 1").first()
    assert spark.sql(f"SELECT sum(cents) s FROM donors_of('{top.o}')").first().s == top.s
