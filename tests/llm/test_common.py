import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lifelog.llm import common, copies

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unbound(spark):
    spark.conf.unset(BOUND)
    yield spark
    spark.conf.unset(BOUND)


@pytest.mark.parametrize("how", ["pandas", "arrow"])
def test_batches_of_texts_are_bounded_by_bytes(unbound, how):
    texts = unbound.range(0, 4000, 1, 1).select("id", F.repeat(F.lit("text "), 1000).alias("text"))
    if how == "pandas":
        lengths = common.map_rows(texts, lambda t: pd.DataFrame({"n": t["text"].str.len()}), "n long")
    else:
        lengths = copies._by_slices(
            texts, lambda part: pa.RecordBatch.from_arrays([pa.array([len(t.as_py()) for t in part.column("text")])], ["n"]), "n long")
    assert lengths.groupBy("n").count().collect() == [(5000, 4000)]

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["bytes"])

    got = [r["bytes"] for r in texts.mapInArrow(sizes, "bytes long").collect()]
    assert len(got) >= 4 and max(got) <= common.BATCH_BYTES * 1.1


def test_a_bound_of_the_session_stays(unbound):
    unbound.conf.set(BOUND, "1000000")
    common.map_rows(unbound.range(3), lambda t: t, "id long").collect()
    assert unbound.conf.get(BOUND) in ("1000000", "1000000b")
