"""Secret scans and toxicity."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

from tessera.llm import secret_scan, toxicity

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def slow_base(text):
    """All matches, then those too short dropped."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_brute_force():
    rng = random.Random(1)
    parts = ["password", "Token", "api_key", "APIKEY", "ſecret", "toKen", ":", "=", " ", '"', "'", "short", "AKIA", "ABCDEF12", "deadbeef" * 3, "0123456789", "é", "🎉", "\n", "value-1+2/3_4."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [x[:3] for x in secret_scan.base_spans(text)] == slow_base(text), text


def test_op7_rows(docs, no_docs, real):
    for frame in (docs, real):
        want = {}
        for r in frame.collect():
            base = slow_base(r.text or "")
            joined = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
            want.setdefault(r.doc_id, []).append((*(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(joined.encode()).hexdigest()))
        for r in secret_scan.annotate(frame).collect():
            assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want[r.doc_id]
            base = [x for x in r.spans.split(",") if x and not x.startswith("format")]
            assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert secret_scan.annotate(no_docs).count() == 0


def _maker(seed):
    rng = random.Random(seed)

    def some(alphabet, n):
        return "".join(rng.choice(alphabet) for _ in range(n))

    return rng, some


HEX, UPPER = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SYLLABLES = ["the", "tion", "heit", "keit", "ung", "er", ".", "be", "mo"]


def _formats(rng, some):
    labelled = {"assign": [some(HEX, 18) for _ in range(100)] + [some(HEX, 40) for _ in range(100)], "access": ["AKIA" + some(UPPER, 16) for _ in range(100)], "hex": [some(HEX, 40) for _ in range(100)]}
    plain = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 7))) for _ in range(2_000)] + [str(rng.randrange(10**6)) for _ in range(200)]
    return secret_scan.Formats(labelled, plain), plain


def test_automata_keep_what_tells_states_apart():
    rng, some = _maker(2)
    fixed = secret_scan.Automaton([some(HEX, 40) for _ in range(150)])
    assert len(fixed.states) == 41 and [s.ends for s in fixed.states].count(0) == 40
    two = secret_scan.Automaton([some(HEX, n) for n in (18, 40) for _ in range(100)])
    assert sum(s.ends > 0 for s in two.states) == 2
    lengths = [8 + int(rng.expovariate(0.1)) for _ in range(400)]
    free = secret_scan.Automaton([some(HEX, n) for n in lengths])
    assert len(free.states) < max(lengths) / 2  # lengths that tell nothing became a loop
    assert free.score(some(HEX, 23)) > fixed.score(some(HEX, 23)) + 3
    prefixed = secret_scan.Automaton(["AKIA" + some(UPPER, 16) for _ in range(100)])
    assert prefixed.score("AKIA" + "B7" * 8) > prefixed.score("BZXC" + "B7" * 8) + 8


def test_formats_are_inferred():
    rng, some = _maker(2)
    model, plain = _formats(rng, some)
    for n in (18, 36, 40, 41):
        assert model.likely(some(HEX, n))
    assert model.likely("AKIA" + some(UPPER, 16)) and not model.likely(some(HEX, 200))
    assert not any(model.likely(p) for p in plain) and not model.likely("mail1.example.com") and not model.likely("x" * 5_000)
    text = f"ordinary words AKIA{'Q' * 16}{some(HEX, 18)} mail1.example.com"
    assert secret_scan.Formats({"assign": [], "access": [], "hex": []}, []).spans(text) == [(s, k, e) for s, k, e in slow_base(text)]
    beside = f"AKIA{'Q' * 16}{some(HEX, 18)}"  # what a base span leaves of a run is a candidate
    assert [k for _, k, _ in model.spans(beside)][0] == 1 and len(model.spans(beside)) <= 2


def test_the_automata_decide():
    """Credentials without their keywords are found by their format alone, and nothing else is."""
    rng, some = _maker(3)
    model, _ = _formats(rng, some)
    hit = added = planted = 0
    for _ in range(300):
        words = ["".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(1, 7))) for _ in range(40)]
        want = set()
        if rng.random() < 0.5:
            words[rng.randrange(40)] = token = rng.choice([some(HEX, 18), "AKIB" + some(UPPER, 16)])
            want.add(token)
        text = " ".join(words)
        got = {text[s:e] for s, k, e in model.spans(text) if k == 3}
        hit, added, planted = hit + len(got & want), added + len(got), planted + len(want)
    assert hit / planted > 0.95 and hit / added > 0.95


def test_added_spans_brute_force():
    """Candidates character by character, and likelihoods from the automata's own counts."""
    rng, some = _maker(4)
    model, _ = _formats(rng, some)
    assert any(k == 3 for _, k, _ in model.spans(f"{some(HEX, 25)} word"))
    allowed = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    classes = ["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", *"+/_.=-"]

    def likelihood(a, value):
        state, p = a.states[0], 0.0
        for c in value:
            k = next(i for i, x in enumerate(classes) if c in x)
            if state.seen[k]:
                p += math.log(state.seen[k] / state.n) + math.log((state.chars[c] + 1) / (sum(state.chars[x] for x in classes[k]) + len(classes[k])))
                state = a.states[state.to[k]]
            else:
                p += math.log(1e-4 / len(classes[k]))
                most = max(state.seen.values(), default=0)
                state = next((a.states[state.to[i]] for i in range(len(classes)) if state.seen[i] == most), state) if most else state
        return p + math.log(max(1e-4, state.ends / state.n))

    def slow(text):
        base = slow_base(text)
        free = [c in allowed and not any(s <= i < e for s, _, e in base) for i, c in enumerate(text)]
        out, i = [], 0
        while i < len(text):
            j = i
            while j < len(text) and free[j]:
                j += 1
            if j > i and any(likelihood(a, text[i:j]) - model.plain.score(text[i:j]) >= math.log(secret_scan.ODDS) for a in model.kinds):
                out.append((i, 3, j))
            i = max(j, i + 1)
        return sorted(base + out)

    for _ in range(400):
        parts = [rng.choice([some(HEX, rng.choice((18, 25, 39, 40, 41))), "AKIA" + some(UPPER, 16), "word", "toKen=", "password: ", " ", "é", "x" * rng.randrange(60), some(HEX, 5), "-"]) for _ in range(rng.randrange(8))]
        text = "".join(parts)
        assert model.spans(text) == slow(text), text


def test_redact(docs):
    got = {r.doc_id: r.text for r in secret_scan.redact(docs).collect()}
    assert got[12] == "[secret] [secret] [secret]" and got[3] is None and got[6] == "one"
    assert secret_scan.redact(docs).columns == docs.columns and secret_scan.redact(docs).count() == docs.count()


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = toxicity.annotate(docs, labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.predicted and r.toxic for r in rows)
    assert hit / sum(r.toxic for r in rows) > 0.9 and hit / sum(r.predicted for r in rows) > 0.9
    for r in got.limit(200).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    # the label isn't an input: flipping held-out labels changes nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 4 = 2 THEN 1 - toxic ELSE toxic END AS toxic")
    again = {r.doc_id: r.score for r in toxicity.annotate(docs, flipped).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def slow_evidence(sample, texts):
    """Toxic less ordinary log-likelihood a word, by the formula of the module, of models of ``sample(text, y)``."""

    def split(t):
        return re.findall(r"[^\W\d_]+", (t or "").lower())

    def orders(found):
        return [[("", w[:4]) for w in found], [("", w) for w in found], list(zip(["", *found], found, strict=False))]

    n, whole = [Counter(), Counter()], [Counter(), Counter()]
    for t, y in sample:
        for order, found in enumerate(orders(split(t))):
            for u, w in set(found):
                n[y][order, u, w] += 1
                whole[y][order, u] += 1

    def kept(y, order, u, w):
        mine = whole[y][order, u]
        if not mine:
            return 0.0
        expected = mine * (n[0][order, u, w] + n[1][order, u, w]) / (whole[0][order, u] + whole[1][order, u])
        return max(0.0, (n[y][order, u, w] - expected - 3 * math.sqrt(expected) - 0.75) / mine)

    lost = [defaultdict(float), defaultdict(float)]
    for y in (0, 1):
        for order, u, w in n[y]:
            lost[y][order, u] += kept(y, order, u, w)

    def ratio(y, order, u, w, lower):
        seen = n[0][order, u, w] + n[1][order, u, w]
        own = kept(y, order, u, w) * (whole[0][order, u] + whole[1][order, u]) / seen if seen else 0.0
        return own + (1 - lost[y][order, u]) * lower

    out = []
    for t in texts:
        found, total = split(t), 0.0
        for u, w in zip(["", *found], found, strict=False):
            p = [ratio(y, 2, u, w, ratio(y, 1, "", w, ratio(y, 0, "", w[:4], 1.0))) for y in (0, 1)]
            total += math.log(p[1] / p[0])
        out.append(total / len(found) if found else 0.0)
    return out


def test_toxicity_brute_force(spark):
    """Every text's evidence against the formula, pairs and words seen once included."""
    rng, rows, labels = random.Random(4), [], []
    plain = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    for i in range(600):
        found = [rng.choice(plain) for _ in range(rng.randrange(30))]
        if i % 5 == 0:
            found[len(found) // 2 : 0] = ["vile", rng.choice(["person", "persona", "thing"])] if i % 2 else ["stupid"]
        rows.append((i, " ".join(found) if found else None))
        labels.append((i, int(i % 5 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    learnt = [(t, y) for (i, t), (_, y) in zip(rows, labels, strict=True) if zlib.crc32(str(i).encode()) % 4 != 2]
    for got, want in zip((model.evidence(t) for _, t in rows), slow_evidence(learnt, [t for _, t in rows]), strict=True):
        assert abs(got - want) < 1e-9
    assert {order for order, _, _ in model.kept} == {0, 1, 2}
    scores = {r.doc_id: r.score for r in toxicity.annotate(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    for i, t in rows:
        assert abs(scores[i] - 1 / (1 + math.exp(-(model.slope * model.evidence(t) + model.intercept)))) < 1e-9


def test_toxicity_edges(spark, docs, no_docs):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (2, None, None), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    got = toxicity.annotate(docs, labels)
    assert got.count() == docs.count() and all(0 <= r.score <= 1 for r in got.collect())
    assert toxicity.annotate(no_docs, labels).count() == 0
    none = toxicity.annotate(docs, labels.limit(0))
    assert {r.predicted for r in none.collect()} == {0}
    kept = toxicity.reject(docs.withColumnRenamed("keep_id", "score"), labels.limit(0))
    assert kept.count() == docs.count() and kept.columns == [*docs.columns[:-1], "score"]
