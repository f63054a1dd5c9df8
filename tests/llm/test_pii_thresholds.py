"""The thresholds of kinds that hardly occur in the sample that the trees learn from."""

import random

import pytest
from test_dedup import frame

from plumbline.llm import pii


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(5)
    out = [(k, f"write to a{k}@b{k}.org" if k % 2 else f"version {rng.randrange(300, 999)}.{k % 10}.1.2 of it") for k in range(400)]
    return out + [(k, "call +1 743 555 38" + str(10 + k % 80)) for k in range(400, 420)]


def chosen(spark, docs, sample):
    """Ids of the texts that the trees may learn from, as fit takes them."""
    from pyspark.sql import functions as F
    part = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(pii.SEED)), F.lit(1 << 40))
    share = int(min(1.0, sample / len(docs)) * (1 << 40))
    return {r.doc_id for r in frame(spark, docs).filter(part < share).collect()}


def test_rare_kind_has_a_threshold(spark, docs):
    sample = chosen(spark, docs, 80)
    docs = [d for d in docs if d[0] < 400 or d[0] not in sample]  # phone numbers outside the sample only
    assert sum(k >= 400 for k, _ in docs) >= 10
    assert pii.fit(frame(spark, docs), sample=80 * len(docs) // 420).thresholds[3] is not None


def test_sample_of_one_class(spark, docs):
    sample = chosen(spark, docs, 60)
    docs = [(k, t if k % 2 or k not in sample else f"write to c{k}@d{k}.org") for k, t in docs if k < 400]
    docs += [(k, "nothing") for k in range(400, 420)]
    model = pii.fit(frame(spark, docs), sample=60)
    assert model.trees and model.thresholds[0] is not None
