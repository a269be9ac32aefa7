"""Exact and SimHash deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import exact, simhash
from tessera.llm.components import components
from tessera.llm.scratch import Scratch


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """fps: list of (id, fp) -> {row number: component id}"""
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(fps)):
        groups[find(i)].append(i)
    low = {r: min((fps[i][0] for i in g if fps[i][0] is not None), default=None) for r, g in groups.items()}
    return [low[find(i)] for i in range(len(fps))]


def test_exact_annotate(docs, real):
    for frame in (docs, real):
        rows = [(r.doc_id, norm(r.text)) for r in frame.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        want = []
        for i, t in rows:
            low = min((x for x in groups[t] if x is not None), default=None)
            want.append((i, low, len(groups[t]), i == low, hashlib.sha256(t.encode()).hexdigest()))
        got = [tuple(r) for r in exact.annotate(frame).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_exact_deduplicate(docs, no_docs):
    got = exact.deduplicate(docs)
    assert got.columns == docs.columns
    texts = [norm(r.text) for r in got.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r.text) for r in docs.collect()})
    first = {}
    for i, t in sorted((r.doc_id, norm(r.text)) for r in docs.collect() if r.doc_id is not None):
        first.setdefault(t, i)
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == sorted(first.values())
    assert exact.deduplicate(no_docs).count() == 0 and exact.annotate(no_docs).count() == 0


def test_index_persists(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    first = docs.where("doc_id < 6")
    exact.deduplicate(first, exact.DigestIndex(spark, path, 4)).count()
    again = exact.deduplicate(docs, exact.DigestIndex(spark, path, 4))
    assert {norm(r.text) for r in again.collect()} == {norm(r.text) for r in docs.collect()} - {norm(r.text) for r in first.collect()}
    index = exact.DigestIndex(spark, path, 4)
    assert index.rows().count() == len({norm(r.text) for r in docs.collect()})
    plan = index.unseen(index.rows().limit(0).unionByName(index.rows()))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_index_keeps_its_buckets(spark, docs, tmp_path):
    path = f"file://{tmp_path}/index"
    many = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    tables = {t.name for t in spark.catalog.listTables()}
    with exact.DigestIndex(spark, path, 4) as index:
        assert exact.deduplicate(many, index).count() == 50
    for other in (7, 2):
        with pytest.raises(ValueError, match="4 buckets"):
            exact.DigestIndex(spark, path, other)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        with exact.DigestIndex(spark, path) as index:
            assert index.buckets == 4 and exact.deduplicate(many, index).count() == 0 and index.rows().count() == 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert {t.name for t in spark.catalog.listTables()} <= tables


def test_index_batches_can_be_repeated(spark, tmp_path, monkeypatch):
    """A batch that failed after its append keeps the same documents when it runs again; compaction changes nothing."""
    path = f"file://{tmp_path}/index"
    batches = [spark.createDataFrame([(100 * k + i, f"text {60 * k + i}") for i in range(80)], "doc_id long, text string") for k in range(3)]
    with exact.DigestIndex(spark, path, 4) as index:
        assert exact.deduplicate(batches[0], index, batch="a").count() == 80
        once = sorted(r.doc_id for r in exact.deduplicate(batches[1], index, batch="b").collect())
        assert len(once) == 60 and sorted(r.doc_id for r in exact.deduplicate(batches[1], index, batch="b").collect()) == once
        assert index.rows().count() == 140
        half = index.rows().where("batch = 'b'").limit(30)  # an append that was lost in part
        rest = index.rows().where("batch = 'a'").unionByName(half)
        rows = spark.createDataFrame([tuple(r) for r in rest.collect()], rest.schema)
    other = f"file://{tmp_path}/other"
    monkeypatch.setattr(exact.DigestIndex, "COMPACT", 2)
    with exact.DigestIndex(spark, other, 4) as index:
        for name in ("a", "b"):
            index.append(rows.where(F.col("batch") == name), name)
        assert index._state == {"buckets": 4, "version": 1, "appends": 0} and index.rows().count() == 110
        assert len(index.rows().inputFiles()) <= 4
        assert sorted(r.doc_id for r in exact.deduplicate(batches[1], index, batch="b").collect()) == once
        assert index.rows().count() == 140 and exact.deduplicate(batches[2], index, batch="c").count() == 60
    with exact.DigestIndex(spark, other) as index:
        assert index.rows().count() == 200 and index.rows().select("digest").distinct().count() == 200


def test_simhash_brute_force(docs, real, no_docs):
    for frame in (docs, real):
        rows = [(r.doc_id, slow_fingerprint(r.text)) for r in frame.collect()]
        want = [(i, f"{fp:016x}", c) for (i, fp), c in zip(rows, slow_components(rows), strict=True)]
        got = [tuple(r) for r in simhash.annotate(frame).select("doc_id", "fingerprint", "component_id").collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert simhash.annotate(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


def test_simhash_keeps_one(docs):
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    got = simhash.deduplicate(docs)
    assert got.columns == docs.columns and got.count() == len(set(map(repr, slow_components(rows))))


@pytest.mark.parametrize("pair_up", [16, 2])
def test_simhash_links_dense_and_sparse(spark, monkeypatch, pair_up):
    """All ways a cell is served give the components of all pairs within two bits."""
    import random

    monkeypatch.setattr(simhash, "PAIR_UP", pair_up)
    rng = random.Random(5)
    fps = set()
    for _ in range(12):
        c = rng.getrandbits(64)
        fps |= {c, c ^ 3 << 31, *(c ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for _ in range(rng.choice((1, 3, 60))))}
    fps = sorted(fps)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    scratch = Scratch(spark, "t")
    frame = scratch.save(spark.createDataFrame(signed, "fp long"), "fps")
    roots = {r.node: r.root for r in components(simhash.links(frame, scratch), scratch).collect()}
    got = [roots.get(s, s) for (s,) in signed]
    want = slow_components(list(enumerate(fps)))
    assert len(set(got)) == len(set(want)) == len(set(zip(got, want, strict=True)))


def test_components_chain(spark):
    scratch = Scratch(spark, "t")
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000), (None, 3), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long"), scratch).collect()}
    assert got == {**{i: 0 for i in range(301)}, 2000: 2000, 2001: 2000}
