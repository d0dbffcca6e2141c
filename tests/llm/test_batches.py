"""What a stage of the pipeline holds of texts at once stays small."""

import pyarrow as pa
import pytest

import corpus_pipeline
from inkstone.llm.common import ARROW_BYTES

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def long_texts(spark, tmp_path):
    """600 texts of 40 KB in one partition, and a benchmark, read by a session of its own."""
    texts = spark.range(600).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 8000) as text", "'en' as lang")
    texts.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    own = spark.newSession()
    return own, own.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)


def largest(docs):
    def size(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    return docs.coalesce(1).mapInArrow(size, "n long, size long").selectExpr("sum(n)", "max(size)").first()


@pytest.mark.parametrize("stage", [corpus_pipeline.drop_contaminated, corpus_pipeline.pack_sequences])
def test_workers_get_small_batches(long_texts, stage):
    own, docs, path = long_texts
    stage(own, docs, path)
    rows, size = largest(docs)
    assert rows == 600 and size < 1.5 * ARROW_BYTES


def test_a_setting_of_the_session_stays(long_texts):
    own, docs, path = long_texts
    own.conf.set(SETTING, "1m")
    corpus_pipeline.drop_contaminated(own, docs, path)
    assert own.conf.get(SETTING) == "1m"
