"""How the inputs of the registered queries are dealt to tasks."""

from registry import fixtures


def test_orders_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "TASK_ROWS", 100)
    cores = spark.sparkContext.defaultParallelism
    few, many = (fixtures.spread_rows(spark.range(n).coalesce(1), "id") for n in (10, 100 * cores * 3))
    assert few.rdd.getNumPartitions() == cores
    sizes = many.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 3 * cores and sum(sizes) == 300 * cores and max(sizes) < 200
    split = spark.range(0, 10, 1, 5 * cores)
    assert fixtures.spread_rows(split, "id").rdd.getNumPartitions() == 5 * cores


def test_entries_land_in_files_of_one_size_whatever_the_row_groups(spark, tmp_path, monkeypatch):
    """A table of more splits than cores may still hold its rows in one of them."""
    from registry import streams

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(fixtures, "table", lambda *_: spark.read.parquet(str(tmp_path / "orders.parquet")))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert fixtures.table().rdd.getNumPartitions() >= cores
        sizes = streams.pages(spark, "").select("start").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(sizes) == cores and sum(sizes) == orders.count() and max(sizes) < 2 * sum(sizes) / cores


def test_certificates_are_built_by_methods_that_java_compiles(spark):
    """Java leaves methods of more than 8,000 bytes to its interpreter."""
    from registry.fixtures import fx_entries

    spark.conf.set("spark.sql.adaptive.enabled", "false")  # the plan shows its code before it runs
    try:
        stages = fx_entries(spark, "/root/testdata/sf0.001")._jdf.queryExecution().debug().codegenToSeq()
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and 0 < max(sizes) < 8000
