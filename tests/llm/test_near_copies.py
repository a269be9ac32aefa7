"""Near copies against all pairs of plain Python sets."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import near_copies, simhash
from tessera.llm.scratch import Scratch


def slow_set(text):
    w = [x for x in (text or "").encode().lower().split()]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def slow_kept(rows):
    """Ids that stay of (id, text) rows."""
    sets, parent = [slow_set(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((k is None, k or 0, k))
    return sorted(repr(min(g)[2]) for g in groups.values())


def test_pipeline_stage_removes_near_copies(spark):
    """Pairs at 0.8 that differ in more than two fingerprint bits."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001")
    assert got.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in got.collect()) == slow_kept([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("pair_up", [16, 3])
def test_all_pairs(spark, docs, no_docs, monkeypatch, pair_up):
    """Groups of near copies, a passage in texts that aren't alike, odd rows; few and many to a posting."""
    monkeypatch.setattr(near_copies, "PAIR_UP", pair_up)
    rng = random.Random(3)
    line = [f"line{i}" for i in range(30)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for g in range(4):
        base = [f"w{g}_{i}" for i in range(120)]
        for _ in range((3, 8, 25, 40)[g]):
            copy = list(base)
            for _ in range(rng.choice((1, 2, 3, 5))):
                copy[rng.randrange(120)] = f"x{rng.random()}"
            rows.append((100 + len(rows), " ".join(copy)))
    for _ in range(40):
        rows.append((100 + len(rows), " ".join([*line, *(f"y{rng.random()}" for _ in range(rng.randrange(1, 30)))])))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(r.doc_id) for r in near_copies.deduplicate(frame).collect()) == slow_kept(rows)
    assert near_copies.deduplicate(no_docs).count() == 0


def test_sketches_of_pairs_at_the_threshold():
    """Of sets at 0.8 all share a band and enough bits; sets that share a fifth hardly ever do."""
    rng = np.random.default_rng(0)
    shared, unlike = [], []
    for _ in range(300):
        x = rng.integers(0, 1 << 63, 1000, np.uint64)
        for (a, b), out in (((x[:900], x[100:]), shared), ((x[:600], x[400:]), unlike)):
            (bands, bits), (others, more) = near_copies.sketch(np.unique(a)), near_copies.sketch(np.unique(b))
            same = 128 - sum(((int(p) ^ int(q)) & (1 << 64) - 1).bit_count() for p, q in zip(bits, more, strict=True))
            out.append((bands == others).any() and same >= near_copies.SAME)
    assert all(shared) and np.mean(unlike) < 0.01


def test_candidates_grow_with_similar_pairs(spark):
    """Of a group of sets that are alike, hardly a pair below 0.8 is joined, and every pair at 0.8 is."""
    rng, base, sets = random.Random(1), [f"w{i}" for i in range(146)], []
    for _ in range(400):
        copy = list(base)
        for _ in range(rng.choice((1, 2, 3, 4, 5, 6))):
            copy[rng.randrange(146)] = f"x{rng.random()}"
        sets.append(near_copies.shingles(" ".join(copy)))
    frame = spark.createDataFrame([(k, s.tobytes(), k) for k, s in enumerate(sets)], "fp long, shingles binary, root long")
    found = near_copies._by_prefix(frame.select("fp", "root"), frame.select("fp", "shingles"), Scratch(spark, "test")).collect()
    similar = {(i, j) for j in range(400) for i in range(j) if near_copies.similar(sets[i], sets[j])}
    assert similar <= {(r.u, r.v) for r in found} and len(found) < 1.2 * len(similar)


def test_the_grid_finds_candidates(spark, monkeypatch):
    """The named method is at work: without any band it alone joins copies within two bits."""
    base = [f"w{i}" for i in range(3_000)]
    texts = [" ".join(base), " ".join([*base, "more"]), " ".join(["more", *base]), " ".join(f"z{i}" for i in range(3_000))]
    sims = [simhash.majority(near_copies.shingles(t)) for t in texts]
    assert all((sims[0] ^ s).bit_count() <= 2 for s in sims[:3])
    monkeypatch.setattr(near_copies, "_sketches", lambda *a, made=near_copies._sketches: made(*a).withColumn("bands", F.expr("cast(array() AS array<bigint>)")))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.deduplicate(frame).collect()) == [0, 3]


def test_new_components_are_joined_once_a_set(spark, monkeypatch):
    """Sets of a large group are in all 32 bands; they get their new roots as one row each."""
    base, rows, seen = [f"w{i}" for i in range(200)], [], []
    for i in range(60):
        copy = list(base)
        copy[3 * i] = f"x{i}"
        rows.append((i, " ".join(copy)))

    def watched(rooted, merged, made=near_copies._relabelled):
        key = next(c for c in ("fp", "node") if c in rooted.columns)
        seen.append((rooted.count(), rooted.select(key).distinct().count()))
        return made(rooted, merged)

    monkeypatch.setattr(near_copies, "_relabelled", watched)
    kept = near_copies.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [repr(r.doc_id) for r in kept.collect()] == slow_kept(rows)
    assert seen and all(n == distinct and n <= len(rows) for n, distinct in seen)
