"""Tokenising operators against the libraries and against brute force."""

import hashlib
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, sstable
from tessera.llm.tokens import _byte_of_char, encoder, ranks

MULTI = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks(MULTI), special_tokens={})


def u4(ids):
    return np.array(ids, "<u4").tobytes()


def test_tree_equals_library_on_tiny_windows(library, monkeypatch):
    monkeypatch.setattr(bpe, "FAR", 6)
    small, rng = bpe.TreeCodec(MULTI, P.PATTERN, leaf=8, window=2, piece=4), random.Random(1)
    parts = ["a", "th", "e", "ing", " ", "  ", "\n", "\t", "'s", "'", "'t", "9", "12", ".", "!!", "é", "東", "🎉", "\x1c", "x" * 9, "A", "ſ", "\r\n", "_", "́", "　"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(60)))
        ids = small.encode(text)
        assert ids == library.encode_ordinary(text)
        assert small.decode(ids) == text.encode()


def test_tree_long_single_match(library):
    c, rng = bpe.codec(MULTI, P.PATTERN), random.Random(2)
    for text in ("x" * 30_000, "ab" * 20_000, "".join(rng.choice("etaoin") for _ in range(30_000)), "é" * 9_000, "!" * 20_000, " " * 20_000 + "a"):
        assert c.encode(text) == library.encode_ordinary(text)


def test_certain_cuts(library):
    chars, rng = "aZ9' .\n\t\x1c\xa0é東_!ſ", random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(chars) for _ in range(8))
        for p in range(1, 8):
            if bpe.certain(text, p):
                assert library.encode_ordinary(text[:p]) + library.encode_ordinary(text[p:]) == library.encode_ordinary(text)


def test_op2_rows(docs, no_docs, real, library):
    for frame in (docs, real):
        want = []
        for r in frame.collect():
            ids = library.encode_ordinary(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(u4(ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
        got = [tuple(r) for r in bpe.digests(frame).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.digests(no_docs).count() == 0
    coded = bpe.encode(docs, MULTI, P.PATTERN)
    assert sorted(bytes(r.text) for r in bpe.decode(coded, MULTI, P.PATTERN).collect()) == sorted((r.text or "").encode() for r in docs.collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_library(name, real, docs):
    t = Tokenizer.from_file(P.path(name))
    mine, rng = encoder(P.path(name)), random.Random(4)
    parts = ["a", "th", "ING", " ", "  ", "\n", "\t", "'s", "'", "9", "_", ".", "!!", "é", "É", "ß", "µ", "¿", "Ÿ", "×", "\r\n", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>"]
    rare = [*parts, "e\u0301", "東", "🎉", "\x1c", "Σ", "İ", "\u3000", "\xa0", "\u0301", "\x85", "\u200b", "²", "½", "ª"]
    texts = ["".join(rng.choice(p) for _ in range(rng.randrange(40))) for p in (parts, rare) for _ in range(1500)]
    texts += [r.text for frame in (real, docs) for r in frame.collect()]
    if name.startswith("byte"):
        chars = _byte_of_char()
        texts += [bytes(chars[c] for c in x).decode(errors="ignore") for x in t.get_vocab() if all(c in chars for c in x)]
    else:
        texts += [x.removesuffix("</w>") for x in t.get_vocab()]
    for text, ids in zip(texts, mine.encode(texts), strict=True):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids, text


def test_op5_rows(docs, no_docs, real):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for frame in (docs, real):
        rows = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in frame.collect()]
        got = sorted((tuple(r) for r in sstable.round_trip(frame).collect()), key=lambda r: r[1])
        assert [r[1] for r in got] == list(np.cumsum([0] + [r[2] for r in got])[:-1])
        assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
        assert sorted((repr(i), len(x), zlib.crc32(u4(x))) for i, x in rows) == sorted((repr(i), n, c) for i, _, n, c in got)
    assert sstable.round_trip(no_docs).count() == 0


def test_shard_lookup(tmp_path):
    rng, path = random.Random(6), tmp_path / "one.tsst"
    rows = sorted((sstable.key_of(i, m), i, [rng.randrange(60_000) for _ in range(rng.randrange(300))]) for i in [None, -5, *range(0, 4000, 2), 7000, 7000, 7000] for m in [rng.getrandbits(60)])
    with path.open("wb") as f:
        w = sstable.Writer(f, 2, block=2000)
        for key, _, ids in rows:
            w.add(key, np.array(ids, "<u2"))
        w.finish()
    shard = sstable.Shard(f"file://{path}")
    assert [(k, x.tolist()) for k, x in shard.scan()] == [(k, x) for k, _, x in rows]
    assert len(shard.spans) > 50 and (shard.rows, shard.ids) == (len(rows), sum(len(x) for *_, x in rows))
    for i in (None, -5, 0, 1998, 3998, 7000):
        assert [x.tolist() for x in shard.get(i)] == [x for _, j, x in rows if i == j]
    assert not any(shard.get(i) for i in (-6, 1, 1999, 5000, 9999))
    assert sum(shard.may_hold(i) for i in range(1, 4000, 2)) < 100
    whole = path.read_bytes()
    for at in range(0, len(whole), len(whole) // 60):  # any damage is noticed
        path.write_bytes(whole[:at] + bytes([whole[at] ^ 4]) + whole[at + 1 :])
        with pytest.raises((ValueError, OSError)):
            bad = sstable.Shard(f"file://{path}")
            bad.may_hold(1)
            list(bad.scan())


def test_lookup_over_shards(spark, tmp_path):
    rows = [(i // 2 if i % 5 else 7, f"text {i}") for i in range(400)] + [(None, "no id"), (-3, "negative")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sstable.write(frame, f"file://{tmp_path}/shards").write.parquet(f"{tmp_path}/manifest")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    manifest = spark.read.parquet(f"{tmp_path}/manifest")
    assert manifest.count() > 2
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for i in (None, -3, 0, 7, 30, 199, -4, 1000):
        want = sorted(t.encode(x, add_special_tokens=False).ids + [2] for j, x in rows if j == i)
        assert sorted(x.tolist() for x in sstable.lookup(manifest, i)) == want


@pytest.mark.parametrize("weights", [None, "own"])
def test_schedule_brute_force(weights):
    rng = random.Random(7)
    for _ in range(60):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 7))]
        w = [rng.randrange(1, 9) for _ in sizes] if weights else None
        plan = packing.Schedule(sizes, w, length=16)
        order = sorted((Fraction(2 * j + 1, 2 * (w or sizes)[q]), q, j) for q, n in enumerate(sizes) for j in range(n))
        for k in range(-(-sum(sizes) // 16) + 1):
            first = order[: 16 * k]
            assert plan.filled(k) == [sum(q == r for _, r, _ in first) for q in range(len(sizes))]
        for at, (_, q, j) in enumerate(order):
            assert plan.window_of(q, j) == at // 16


@pytest.mark.parametrize("weights", [None, {"a": 3, "c": 1}])
def test_op10_rows(docs, no_docs, real, weights):
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for frame in (docs, real):
        rows = [(r.doc_id, r.source, t.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in frame.collect()]
        got = packing.pack(frame, weights=weights).collect()
        total, seqs = sum(len(x) for *_, x in rows), defaultdict(list)
        for p in got:
            seqs[p.sequence_id].append((p.offset, p.length))
        assert sorted(seqs) == list(range(-(-total // 4096)))
        for k, parts in seqs.items():
            end = 0
            for off, n in sorted(parts):
                assert off == end and n > 0
                end += n
            assert end == min(4096, total - 4096 * k)
        by_doc, want = defaultdict(list), defaultdict(list)
        for p in got:
            by_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        for i, _, x in rows:
            want[i].append(x)
        for i, xs in want.items():
            if len(xs) == 1:
                (x,), at = xs, 0
                for start, n, crc, whole in sorted(by_doc[i]):
                    assert start == at and whole == len(x) and crc == zlib.crc32(u4(x[at : at + n]))
                    at += n
                assert at == len(x)
            else:
                assert sum(p[1] for p in by_doc[i]) == sum(map(len, xs))
    assert packing.pack(no_docs).count() == 0


@pytest.mark.parametrize("weights", [None, {"hot": 3}])
def test_rare_sources_run_level(spark, weights):
    """Sources that share the last queue: none is ahead of another by more than a document."""
    rng, rows = random.Random(8), [(0, "hot " * 60_000, "hot")]
    for s in range(12):
        rows += [(len(rows) + i, " ".join(["some"] * rng.randrange(1, 4)), f"s{s}") for i in range(rng.randrange(1, 9))]
    rows += [(len(rows), "null source", None), (len(rows), "null source", None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), weights=weights, length=512).collect()
    source = {i: s for i, _, s in rows}
    size, n = defaultdict(int), {}
    for p in got:
        n.setdefault((p.doc_id, source[p.doc_id]), p.doc_tokens)
    pool = sorted(((p.sequence_id, p.offset, p.doc_id) for p in got if source[p.doc_id] != "hot" and p.start == 0))
    assert sum(p.length for p in got) == sum(p.doc_tokens for p in got if p.start == 0)
    for p in got:
        if p.start == 0:
            size[source[p.doc_id]] += p.doc_tokens
    assert max(v for k, v in size.items() if k != "hot") * packing.LEAST_SHARE < sum(size.values())
    served = defaultdict(int)
    tokens = {p.doc_id: p.doc_tokens for p in got}
    biggest = max(t for i, t in tokens.items() if i)
    for _, _, i in pool:
        served[source[i]] += tokens[i]
        far = [served[s] / (1 if weights else size[s]) for s in size if s != "hot" and served[s] < size[s]]
        if len(far) > 1:
            assert max(far) - min(far) <= biggest / (1 if weights else min(size.values())) + 1e-9


def test_mixture_in_every_window(real):
    got = packing.pack(real)
    share = {r.source: r.n for r in got.join(real.select("doc_id", "source"), "doc_id").groupBy("source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    total = sum(share.values())
    full = total // 4096
    for r in got.join(real.select("doc_id", "source"), "doc_id").where(f"sequence_id < {full}").groupBy("sequence_id", "source").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect():
        assert abs(r.n - 4096 * share[r.source] / total) <= 3


def test_weights_of_rare_sources(spark):
    """A weighed source has its weight however rare it is; the others weigh one each though they share a queue."""
    rows = [(0, "hot " * 40_000, "hot"), (1, "rare text here again now and then", "rare"), (2, "some other words in a row", "x"), (3, "some other words in a row", "y"), (4, "some other words in a row", "z")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights={"hot": 4, "rare": 40}, length=16).collect()
    last = {i: max(p.sequence_id for p in got if p.doc_id == i) for i in range(5)}
    n = {p.doc_id: p.doc_tokens for p in got}
    assert max(n[i] for i in (1, 2, 3, 4)) * packing.LEAST_SHARE < n[0]
    assert last[1] == 0  # 40 of 47 tokens are its own
    assert max(last[i] for i in (2, 3, 4)) <= (n[1] + sum(n[i] for i in (2, 3, 4)) * 7 / 3 + 4) // 16  # 3 of 7, then
