from galleyproof.plans import catalog


def test_all_suppliers_take_part(spark, tmp_path):
    n = 330
    spark.range(n).select("id").withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    want, fresh = set(), set(range(0, n, 50))
    while fresh:
        want |= fresh
        fresh = {d for k in fresh if k != 7 for d in ((k * 3 + 1) % n, (k * 7 + 2) % n)} - want
    assert max(want) >= 100
    got = [r.id for r in catalog.QUERIES["skill_closure"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
