from pyspark.sql import SparkSession


def test_session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .appName("blockprep-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
