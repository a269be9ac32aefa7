"""Language-model scores: the fixed columns by brute force, the model by held-out texts."""

import math
import os
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tessera.llm import lm


def slow(rows):
    """(id, text) -> the columns that are fixed."""
    n = Counter()
    tokens = [[*lm.words(t), None] for _, t in rows]
    for (i, _), ts in zip(rows, tokens, strict=True):
        if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2:
            n.update(ts)
    whole = sum(n.values())
    return [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(ts), sum(n[t] > 0 for t in ts), whole, round(sum(math.log10((n[t] + 1) / (whole + len(n) + 1)) for t in ts), 6)) for (i, _), ts in zip(rows, tokens, strict=True)]


def test_op4_rows(docs, no_docs, real, monkeypatch):
    monkeypatch.setattr(lm, "PART", 50_000)  # several parts
    for frame in (docs, real):
        got = lm.annotate(frame).collect()
        want = slow([(r.doc_id, r.text) for r in frame.collect()])
        assert sorted(repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6))) for r in got) == sorted(map(repr, want))
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.annotate(no_docs).count() == 0
    nothing = docs.where("crc32(string(doc_id)) % 7 = 2")
    assert nothing.count() and lm.annotate(nothing).count() == nothing.count()


def test_gradient():
    rng = np.random.default_rng(1)
    layer = lm.Attention(rng.integers(0, 9, (lm.CLASSES + 1, lm.CLASSES)).astype(float))
    layer.p = {n: x.astype(np.float64) for n, x in layer.p.items()}
    keys, targets, real = lm.blocks(rng.integers(0, lm.CLASSES, 60), np.array([40, 20]))
    weight = np.zeros(targets.size)
    weight[real] = 1
    weight = weight.reshape(targets.shape)

    def loss():
        return -(layer.log_probs(keys, targets, np.ones(lm.CLASSES))[0] * weight.ravel()).sum() / weight.sum()

    g = layer.gradient(keys, targets, weight)
    for name, x in layer.p.items():
        at = tuple(int(rng.integers(0, s)) for s in x.shape)
        if name in ("q", "k", "v"):
            at = (int(keys[0, lm.BLOCK + 3]), at[1])
        step = 1e-3
        x[at] += step
        up = loss()
        x[at] -= 2 * step
        down = loss()
        x[at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 2e-4, name


def test_windows_score_each_class_once_and_causally():
    rng = np.random.default_rng(2)
    lengths = np.array([1, 16, 17, 50])
    classes = rng.integers(0, lm.CLASSES, lengths.sum())
    layer = lm.Attention(np.ones((lm.CLASSES + 1, lm.CLASSES)))
    keys, targets, real = lm.blocks(classes, lengths)
    assert (targets.ravel()[real] == classes).all()
    whole = layer.log_probs(keys, targets, np.ones(lm.CLASSES, np.float32))[0].ravel()[real]
    cut, starts = classes.copy(), np.cumsum(lengths) - lengths
    cut[starts[3] + 30 :] = (cut[starts[3] + 30 :] + 1) % lm.CLASSES
    keys, targets, real = lm.blocks(cut, lengths)
    again = layer.log_probs(keys, targets, np.ones(lm.CLASSES, np.float32))[0].ravel()[real]
    assert (whole[: starts[3] + 30] == again[: starts[3] + 30]).all()


def slow_scores(m, texts, count, tokens, distinct):
    """The score of each text id by id: explicit windows, softmax and mixtures."""
    lib, p, out = lm._library(m.path), {n: x.astype(float) for n, x in m.layer.p.items()}, []
    within, after, class_of = m.within.astype(float), m.endings.astype(float), m.layer.class_of
    inner = range(lm.OWN + lm.SHARED - lm.INNER, lm.OWN + lm.SHARED)
    begins = [m.begin[c] for c in range(lm.CLASSES)]
    assert all(begins[c] == 0 for c in inner) and begins[lm.END] == 1
    for t in texts:
        found = [lib.encode_ordinary(" " + w.decode()) for w in lm.words(t)]
        ids = [i for w in found for i in w]
        inputs = [int(m.inputs[i]) for i in ids] + [lm.END]

        def key(at, inputs=inputs):
            return inputs[at - 1] if 0 < at < len(inputs) else lm.PAD

        logs = []
        for at in range(len(inputs)):
            first = at // lm.BLOCK * lm.BLOCK - lm.BLOCK
            near = range(first, at + 1)
            s = np.array([p["q"][key(at)] @ p["k"][key(j)] + p["r"][at - j] + (-4 if key(j) == lm.PAD else 0) for j in near])
            s = np.exp(s - s.max())
            h = sum(a * p["v"][key(j)] for a, j in zip(s / s.sum(), near, strict=True))
            z = h @ p["w"] + m.layer.pair[class_of[key(at)]].astype(float)
            logs.append(z - z.max() - np.log(np.exp(z - z.max()).sum()))
        start = [math.log(sum(math.exp(x) for x, b in zip(row, begins, strict=True) if b)) for row in logs]
        total, at = 0.0, 0
        for w, word in zip(found, lm.words(t), strict=True):
            cls = [int(m.cls[i]) for i in w]
            spelled = within[w[0]]
            for k in range(1, len(w)):
                spelled *= (math.exp(logs[at + k][cls[k]]) * within[w[k]] + after[cls[k - 1], w[k]]) / 2
            spelled *= (math.exp(start[at + len(w)]) + after[cls[-1], -1]) / 2
            n, kinds = m.heads[cls[0]]
            known = (1 - lm.MIX) * max(0, count.get(word, 0) - lm.DISCOUNT) / n
            total += (logs[at][cls[0]] - start[at]) / math.log(10) + math.log10(known + ((1 - lm.MIX) * lm.DISCOUNT * kinds / n + lm.MIX) * spelled)
            at += len(w)
        out.append(total + (logs[at][lm.END] - start[at]) / math.log(10))
    return out


def test_score_brute_force(real):
    path, rng = lm.vocabulary_file("byte_bpe_multi_50k.tiktoken"), np.random.default_rng(4)
    texts = [r.text for r in real.limit(60).collect() if len(r.text or "") < 600][:12] + ["", None, "one", "unseen wordsthatarelong " * 12]
    count = Counter(w for t in texts[:9] for w in lm.words(t))
    names = sorted({w for t in texts for w in lm.words(t)} | {b""})
    ids = [lm._library(path).encode_ordinary(" " + w.decode()) if w else [] for w in names]
    used, size = sorted({i for w in ids for i in w}), max(lm.ranks(path).values()) + 1
    cls = rng.integers(0, lm.CLASSES - 1, size)
    inputs, class_of = lm._inputs({t: (k, 1, 1) for k, t in enumerate(used)}, cls)
    assert (class_of[inputs] == cls).all() and (inputs > lm.CLASSES).any()
    layer = lm.Attention(rng.random((lm.CLASSES + 1, lm.CLASSES)) * 50, class_of)
    layer.p = {n: (x * 8).astype(np.float32) for n, x in layer.p.items()}
    m = lm.Model(path, cls, inputs, rng.random(size), rng.random((lm.CLASSES, 2)) * 90 + 1, rng.random((lm.CLASSES, size + 1)) * 0.01, layer, sum(count.values()), len(count))
    got = m.score(iter(texts), names, np.array([count.get(w, 0) for w in names]), np.array([i for w in ids for i in w]), np.array(list(map(len, ids))))
    for (n, _, _, score), want, t in zip(got, slow_scores(m, texts, count, sum(count.values()), len(count)), texts, strict=True):
        assert n == len(lm.words(t)) + 1 and abs(score - want) < 1e-3 + 1e-4 * abs(want), t


def test_scores_do_not_depend_on_partitions(real, monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 40)
    one, other = ({r.doc_id: r.score for r in lm.annotate(frame).collect()} for frame in (real, real.repartition(7)))
    assert one.keys() == other.keys() and max(abs(one[i] - other[i]) for i in one) < 1e-6


def test_windows_cover_whole_texts():
    """Every part of a text is as likely to be trained on, and more text means more windows."""
    places = [k for i in range(400) for k in range(100) if lm.picked(i, k)]
    assert abs(len(places) * lm.NTH / 40_000 - 1) < 0.1
    assert abs(np.mean(places) - 49.5) < 3


def test_every_training_id_is_learnt_from_once(docs, real):
    """The windows of all training texts together have each id, and each text's end, as a target once."""
    path = lm.vocabulary_file("byte_bpe_multi_50k.tiktoken")
    library, size = lm._library(path), max(lm.ranks(path).values()) + 1
    for frame in (docs, real):
        want, ends = np.zeros(size, int), 0
        for r in frame.collect():
            if not lm.held_out(r.doc_id):
                ends += 1
                want += np.bincount([i for w in lm.words(r.text) for i in library.encode_ordinary(" " + w.decode())], minlength=size).astype(int)
        got = [(w, k == 0) for r in lm._parts(frame, path, "doc_id", "text").collect() for k, w in enumerate(r.windows)]
        inputs = np.arange(size) + lm.INPUTS  # stand for themselves
        _, targets, weights = lm._window_blocks([w for w, _ in got], [f for _, f in got], inputs, np.arange(size + lm.INPUTS))
        learnt = targets[weights > 0]
        assert (learnt == lm.END).sum() == ends
        assert (np.bincount(learnt[learnt != lm.END] - lm.INPUTS, minlength=size) == want).all()


def test_words_encoded_together():
    path = lm.vocabulary_file("byte_bpe_multi_50k.tiktoken")
    plain = ["one", "can't", "'s", "12ab", "...", "\u6771\u4eac", "na\u00efve\U0001f389", "x" * 300, "1"]
    for found in (plain, [*plain, "a\u00a0", "\u00a0b", "c\u2003d", "e\x1cf"], []):
        found = [w.encode() for w in found]
        assert lm.encoded(path, found) == [np.array(lm._library(path).encode_ordinary(" " + w.decode()), "<u2").tobytes() for w in found]


def test_words_are_a_distribution(real):
    """The chances of all words of a class, spelled or known, with the rest's, stay within one."""
    path = lm.vocabulary_file("byte_bpe_multi_50k.tiktoken")
    rng = np.random.default_rng(3)
    size = max(lm.ranks(path).values()) + 1
    n = {t: (int(c), int(c), 1) for t, c in zip(rng.choice(size, 300, replace=False), rng.integers(1, 90, 300), strict=True)}
    begins = np.zeros(size, bool)
    begins[[i for t, i in lm.ranks(path).items() if t[:1] == b" "]] = True
    cls, within = lm._classes(n, lambda own: np.zeros((size, lm.OWN), np.float32), begins)
    assert np.allclose(np.bincount(cls, within, lm.CLASSES)[np.unique(cls)], 1)


def test_beats_the_base_on_held_out_texts(spark):
    """(With 10,000 documents; the base gives every unseen word the same chance however many there
    are, which favours it on tables of a few hundred, where most words are unseen.)"""
    got = lm.annotate(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
    assert sum(r.score > r.base_score for r in got) > 0.6 * len(got)


def test_training_windows_are_gone_before_scoring(docs, monkeypatch):
    """Scoring sends texts and words around; the training windows' ids don't lie on the disks beside them."""
    held = {}

    class Watched(lm.Scratch):
        def save(self, frame, name):
            held[name] = frame.columns
            return super().save(frame, name)

        def drop(self, name):
            held.pop(name, None)
            super().drop(name)

    monkeypatch.setattr(lm, "Scratch", Watched)
    got = lm.annotate(docs)
    assert held and not any("windows" in columns for columns in held.values())
    assert got.count() == docs.count()


def test_gradient_in_pieces(monkeypatch):
    """Windows taken some at a time, and keys' sums joined where a window goes on, give the same sums."""
    rng = np.random.default_rng(6)
    layer = lm.Attention(rng.integers(0, 9, (lm.CLASSES + 1, lm.CLASSES)).astype(float))
    layer.p = {n: x.astype(np.float64) for n, x in layer.p.items()}
    keys, targets, _ = lm.blocks(rng.integers(0, lm.CLASSES, 330), np.array([1, 100, 16, 17, 196]))
    weight = rng.integers(0, 2, targets.shape).astype(float)
    order = rng.permutation(len(keys))
    whole, mixed = layer.gradient(keys, targets, weight), layer.gradient(keys[order], targets[order], weight[order])
    monkeypatch.setattr(lm, "LEARNT", 3)
    pieces = layer.gradient(keys, targets, weight)
    for n, x in whole.items():
        assert np.allclose(x, mixed[n], atol=1e-12) and np.allclose(x, pieces[n], atol=1e-12), n


def test_words_laid_end_to_end():
    texts = ["A b\x0bc\x0c\x0d d ", None, "", " \t\n", "İÄ  x y\x1cz\x85", "one", "\x00 q"]
    laid, lengths = lm.laid_words(pa.array(texts, pa.string()))
    assert laid.to_pylist() == [w for t in texts for w in lm.words(t)]
    assert lengths.tolist() == [len(lm.words(t)) for t in texts]


def test_rounding_does_not_depend_on_the_place():
    """With the kernels of processors that round the rows of one large product differently, too."""
    code = """if True:
        import numpy as np
        from tessera.llm import lm
        rng = np.random.default_rng(5)
        layer = lm.Attention(rng.integers(0, 99, (lm.CLASSES + 1, lm.CLASSES)).astype(float))
        keys, targets = rng.integers(0, lm.CLASSES, (400, 2 * lm.BLOCK)), rng.integers(0, lm.CLASSES, (400, lm.BLOCK))
        begin = (np.arange(lm.CLASSES) < 50).astype(np.float32)
        one = [x.reshape(targets.shape) for x in layer.log_probs(keys, targets, begin)]
        for by in (1, 5, 77):
            other = layer.log_probs(np.roll(keys, by, 0), np.roll(targets, by, 0), begin)
            assert all((np.roll(a, by, 0) == b.reshape(a.shape)).all() for a, b in zip(one, other)), by
    """
    for kernels in ("Haswell", "Zen", "SkylakeX"):  # one that this processor can't run is ignored
        subprocess.run([sys.executable, "-c", code], env=os.environ | {"OPENBLAS_CORETYPE": kernels, "PYTHONPATH": os.pathsep.join(sys.path)}, check=True, timeout=120)
