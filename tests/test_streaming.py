"""Streaming forms: clean + score a parquet stream into a memory sink."""
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler

from sinter.operators.models import linear_model
from sinter.streaming.score import block_medians_stream, clean_stream, score_stream


def test_clean_and_score_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(f"{i},5", f"{2 * i + 1},0", "2024-01-01 00:00:00") for i in range(20)]
    spark.createDataFrame(rows, "x string, y string, ts string").write.parquet(src)
    batch = clean_stream(spark.read.parquet(src), ["x", "y"])
    model = Pipeline(stages=[VectorAssembler(inputCols=["x"], outputCol="features"),
                             linear_model().setLabelCol("y")]).fit(batch)
    stream = clean_stream(spark.readStream.schema(spark.read.parquet(src).schema).parquet(src), ["x", "y"])
    q = (score_stream(stream, model, q_hat=1.0).writeStream.format("memory")
         .queryName("scored_stream").outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    out = spark.sql("SELECT * FROM scored_stream")
    assert out.count() == 20 and {"lower", "upper", "prediction"} <= set(out.columns)


def test_block_medians_stream(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    schema = spark.read.parquet(src).schema
    s = block_medians_stream(spark.readStream.schema(schema).parquet(src), "ts", "event_type", "value",
                             every="1 day", watermark="1 day")
    q = s.writeStream.format("memory").queryName("blk").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT * FROM blk").count() > 0
