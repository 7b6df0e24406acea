from conftest import rows

from corpuslab.functions import text as tx
from corpuslab.sources.corpus import cap_length


def test_row_operators_accept_a_stream(spark, tmp_path):
    data = [(1, "a\nb", "http://x.y/z"), (2, "long" * 50, "http://x.y/z")]
    df = spark.createDataFrame(data, "doc_id bigint, text string, url string")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    made = tx.with_domain(tx.normalize(cap_length(stream, 100)))
    query = (
        made.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "domain")
    assert rows(got) == [(1, "ab", "x.y")]
