"""Cap filters against brute force."""

import math

import numpy as np

from tessera.llm import caps


def slow(rows):
    """rows: (id, vector) -> links and component of each row."""
    def unit(v):
        if not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            return None
        x = np.array(v, np.float64)
        return x / np.linalg.norm(x)

    units = [unit(v) for _, v in rows]
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and float(units[i] @ units[j]) >= 0.9] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((rows[i][0], len(near[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return out


def test_op6_brute_force(spark, monkeypatch):
    monkeypatch.setattr(caps, "TILE", 40)
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 64)).astype(np.float32))]
    for c in range(6):
        centre = rng.standard_normal(64)
        centre /= np.linalg.norm(centre)
        for _ in range((3, 3, 10, 30, 60, 90)[c]):
            noise = rng.standard_normal(64)
            rows.append((len(rows), (centre + 0.25 * noise / np.linalg.norm(noise)).astype(np.float32).tolist()))
    rows += [(len(rows) + i, rows[5][1]) for i in range(70)]
    rows += [(900, None), (901, []), (902, [0.0] * 64), (903, [float("nan")] * 64), (904, [1.0, None]), (905, [float("inf")] + [0.0] * 63), (906, [1.0, 2.0]), (907, [2.0, 4.0]), (908, [1.0]), (909, [-1.0]), (None, rows[7][1]), (906, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, 1, 0) for i, v in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in caps.annotate(frame).collect()), key=lambda r: (repr(r[0]), repr(r[2])))
    want = sorted(slow(rows), key=lambda r: (repr(r[0]), repr(r[2])))
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert len(got) == len(want) and found >= 0.97 * there
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert [g[2] for g in got] == [w[2] for w in want]
    assert caps.annotate(frame.limit(0)).count() == 0


def test_recall_at_threshold():
    """Pairs exactly at the threshold share a filter almost always; lists stay short."""
    rng = np.random.default_rng(4)
    f = caps.Filters(50_000, 64)
    x = rng.standard_normal((600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((600, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * z / np.linalg.norm(z, axis=1, keepdims=True)
    lists = []
    for v in (x, y):
        rows, names = f.decode(v)
        lists.append([set(names[rows == i]) for i in range(600)])
    assert sum(bool(a & b) for a, b in zip(*lists, strict=True)) > 0.95 * 600
    assert np.mean([len(a) for a in lists[0]]) < 2 * f.lists
