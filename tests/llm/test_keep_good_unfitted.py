"""The quality filter where there is nothing to fit on."""

import pytest
from test_dedup import frame

from plumbline.llm import quality


@pytest.mark.parametrize("labels", [[], [(900, 1), (901, 0)], [(1, None), (None, 1)]])
def test_all_rows_stay(spark, labels):
    df = frame(spark, [(1, "some text"), (2, ""), (3, None), (None, "more text"), (1, "some text")])
    out = quality.keep_good(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert out.schema == df.schema and sorted(map(repr, out.collect())) == sorted(map(repr, df.collect()))
