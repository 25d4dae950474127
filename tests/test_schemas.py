from spoolworks.sources import schemas


def test_catalog_goes_up_and_down(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS catalog_test")
    assert schemas.missing_tables(spark, "catalog_test") == set(schemas.CATALOG)
    schemas.create_all(spark, "catalog_test")
    schemas.create_all(spark, "catalog_test")
    assert not schemas.missing_tables(spark, "catalog_test")
    schemas.create_all(spark, "catalog_test", up=False)
    assert schemas.missing_tables(spark, "catalog_test") == set(schemas.CATALOG)
    spark.sql("DROP DATABASE catalog_test")
