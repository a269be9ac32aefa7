"""The pipeline against a slow version of each stage on what its predecessor kept."""

import public_tokenizers as P
from test_dedup import norm
from test_near_copies import slow_kept
from tokenizers import Tokenizer

import corpus_pipeline
from tessera.llm import secret_scan, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "secret_scan", "packing"]
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [i for i, r in rows.items() if model.score(r.text) < toxicity.THRESHOLD]
    first = {}
    for i in sorted(kept):
        first.setdefault(norm(rows[i].text), i)
    kept = sorted(first.values())
    kept = sorted(map(int, slow_kept([(i, rows[i].text) for i in kept])))
    now = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns
    assert sorted(r.doc_id for r in now.collect()) == kept
    formats = secret_scan.train(now)
    clean = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, now, SF).collect()}
    assert sorted(clean) == kept
    for i, t in clean.items():
        text, end, out = rows[i].text, 0, ""
        for s, _, e in formats.spans(text):
            if s >= end:
                out += text[end:s] + "[secret]"
            end = max(end, e)
        assert t == out + text[end:]
    got = corpus_pipeline.run(spark, SF).collect()
    coder = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    whole = {i: len(coder.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert {r.doc_id: r.doc_tokens for r in got} == whole
    assert sum(r.length for r in got) == sum(whole.values())


def test_odd_rows(spark, docs, tmp_path):
    """Nulls, repeats and empty tables pass through all stages."""
    for k, frame in enumerate((docs.withColumnRenamed("keep_id", "n"), docs.limit(0))):
        frame.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{k}").collect()
        assert bool(got) == (k == 0)
