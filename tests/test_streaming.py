import os
import tempfile

from pyspark.sql import types as T

from starling.streaming.scoring import decode_stream


def test_decoders_run_on_a_stream(spark):
    src = tempfile.mkdtemp(prefix="stream-src-")
    rows = [([0.7, 0.1, 0.1, 0.1],), ([0.2, 0.35, 0.05, 0.4],)]
    schema = T.StructType([T.StructField("probabilities", T.ArrayType(T.DoubleType()))])
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(os.path.join(src, "part"))
    stream = spark.readStream.schema(schema).parquet(os.path.join(src, "part"))
    q = decode_stream(stream).writeStream.format("memory").queryName("decoded").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.rating_argmax, r.rating_median) for r in spark.sql("SELECT * FROM decoded").collect())
    assert got == [(1, 1), (5, 2)]
