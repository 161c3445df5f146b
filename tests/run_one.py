"""python tests/run_one.py SF_DIR NAME...: runs queries once and prints rows and seconds."""

import sys
import time

sys.path.insert(0, ".")

from pyspark.sql import SparkSession

import __spark_entry__

spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[2:]:
    t = time.time()
    df = __spark_entry__.queries()[name](spark, sys.argv[1])
    df.write.mode("overwrite").parquet(f"/tmp/out/{name}")
    out = spark.read.parquet(f"/tmp/out/{name}")
    print(name, out.count(), f"{time.time() - t:.1f}s", flush=True)
    out.show(4, 80)
