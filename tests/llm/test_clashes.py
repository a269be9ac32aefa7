"""Every operator gives the same rows whatever the names of columns that it has no use for."""

import pytest
from conftest import ROWS
from pyspark.sql import functions as F

from tessera.llm import bpe, caps, exact, lm, packing, page_text, secret_scan, simhash, sstable, toxicity

#: Names that the operators use inside or return.
TAKEN = """id mark fp part n ids size root h band windows starts w k g lines chunk host path score kept queue j before base digest low high
win_id win_mark row_mark y fold l_id u v cell m_id word c first spans held_out predicted component_id fingerprint keep_id group_size p_id
p_url articles boxed text_sha256 turn pos node vec seq label sequence_id offset start length""".split()
DOCS = {
    "exact": exact.annotate,
    "exact_keep": exact.deduplicate,
    "simhash": simhash.annotate,
    "simhash_keep": simhash.deduplicate,
    "near_copies": lambda d: simhash.deduplicate(d, similarity=0.8),
    "bpe": bpe.digests,
    "lm": lm.annotate,
    "sstable": sstable.round_trip,
    "secrets": secret_scan.annotate,
    "redact": secret_scan.redact,
    "packing": packing.pack,
}


def beside(frame):
    return frame.select("*", *(F.lit(i).alias(n) for i, n in enumerate(TAKEN) if n not in frame.columns))


def same(one, other):
    columns = one.columns
    assert sorted(map(repr, one.collect())) == sorted(map(repr, other.select(*columns).collect()))


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([r[:4] for r in ROWS if len(r[1] or "") < 1000], "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize("name", sorted(DOCS))
def test_documents(few, name):
    same(DOCS[name](few), DOCS[name](beside(few)))


@pytest.mark.parametrize("act", [toxicity.annotate, toxicity.reject])
def test_toxicity(spark, few, act):
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, toxic int")
    same(act(few, labels), act(beside(few), beside(labels)))


def test_pages(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"<p>Menu</p><p>text {i}</p>") for i in range(6)] + [(None, None, None)], "page_id long, url string, html string")
    same(page_text.extract(pages), page_text.extract(beside(pages)))


def test_embeddings(spark):
    vectors = spark.createDataFrame([(i, [1.0, float(i % 3), 0.5, 2.0]) for i in range(9)] + [(9, None), (10, [0.0] * 4)], "vec_id long, embedding array<float>")
    same(caps.annotate(vectors), caps.annotate(beside(vectors)))
