"""Main text of pages."""

import random
from collections import Counter
from html.parser import HTMLParser

from tessera.llm import page_text


class Article(HTMLParser):
    """The blocks of an article, with a parser of its own."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.parts, self.out = False, [], []
        self.feed(page)
        self.close()

    def flush(self):
        if text := " ".join("".join(self.parts).split()):
            self.out.append(text)
        self.parts = []

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "br", "article"):
            self.flush()
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "article") and self.inside:
            self.flush()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_op8_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: "\n".join(Article(r.html).out) for r in pages.collect()}
    got = page_text.extract(pages).collect()
    assert len(got) == len(want)
    for r in got:
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def test_edges(spark):
    rows = [
        (1, "http://h/a", None, 1),
        (2, None, "", 1),
        (3, "http://h/b/1", "<body><div>Site name</div><p>First &amp; only\n\n text</p><div>All rights</div></body>", 1),
        (4, "http://h/b/2", "<body><div>Site name</div><p>Second<br>line</p><div>All rights</div></body>", 1),
        (4, "http://h/b/2", "<body><div>Site name</div><p>Second<br>line</p><div>All rights</div></body>", 1),
        (5, "http://h/c", "plain &lt;b&gt; text <script>var a='<p>no</p>'</script> on<!-- no --> ", 1),
        (6, "x", "<article><header>Mine</header><p>One<aside>no</aside><div class='ad-box'>no</div><div class='adventure'>yes</div><form>no</form></article><p>out", 1),
        (None, "http://other/", "<main><p>A <b>b</b>old<p>c &#8364; &nbsp; d</main><section id=comments><p>no</section>", 1),
        (7, "http://h/d", "<p>" + "word " * 100_000, 1),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, bucket int")
    got = [(r.page_id, r.text) for r in page_text.extract(frame).collect()]
    assert sorted((i, t) for i, t in got if i and i < 7) == [(1, ""), (2, ""), (3, "First & only text"), (4, "Second\nline"), (4, "Second\nline"), (5, "plain <b> text on"), (6, "Mine\nOne\nyes")]
    assert [t for i, t in got if i is None] == ["A bold\nc € d"]
    assert [len(t) for i, t in got if i == 7] == [499_999]
    assert page_text.extract(frame.limit(0)).count() == 0


def test_large_directory(spark, monkeypatch):
    """Chunks of a large directory, of one path with many queries, and of null URLs, under any partitioning."""
    monkeypatch.setattr(page_text, "CHUNK", 24)
    html = "<div>Menu</div><p>text {}</p><div>Foot</div>"
    rows = [(i, f"http://h/d/{i}", html.format(i)) for i in range(300)]
    rows += [(1000 + i, f"http://q/index.php?id={i}", html.format(i)) for i in range(300)]
    rows += [(2000 + i, None, html.format(i)) for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in page_text.extract(frame).collect()}
    again = {r.page_id: r.text for r in page_text.extract(frame.repartition(7)).collect()}
    assert got == again and len(got) == 900
    assert sum(got[i] == f"text {i % 1000}" for i in got) > 890  # a chunk's only page has no neighbour


def test_the_difference_decides(spark, monkeypatch):
    """Unmarked lines of a site go by differencing alone, inside articles too; with it turned off they stay."""
    rows, want = [], {}
    for i in range(60):
        mine = [f"story {i} part {k}" for k in range(3)]
        lines = ["The Daily Site", *mine, "Read our terms"]
        rows.append((i, f"http://plain/{i % 2}/{i}", "".join(f"<p>{x}</p>" for x in lines)))
        rows.append((100 + i, f"http://art/{i}", f"<main><article>{''.join(f'<p>{x}</p>' for x in lines)}</article></main>"))
        want[i] = want[100 + i] = "\n".join(mine)
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")

    def right():
        return sum(r.text == want[r.page_id] for r in page_text.extract(frame).collect())

    assert right() == 120
    monkeypatch.setattr(page_text, "frame_lines", lambda *_: set())
    pages = [(i, u, *zip(*page_text.blocks(h), strict=True)) for i, u, h in rows[:2]]
    assert [t for *_, t in page_text._finish([(i, u, "", list(x), list(a), list(b)) for i, u, x, a, b in pages])] != [want[0], want[100]]  # in this process, without it


def slow_text(rows, i):
    """The text of page ``i`` of one host's pages in order, by the rules written out."""

    def lcs(a, b):
        if not a or not b:
            return frozenset()
        best = {}
        for x in range(len(a), -1, -1):
            for y in range(len(b), -1, -1):
                if x == len(a) or y == len(b):
                    best[x, y] = ()
                elif a[x] == b[y]:
                    best[x, y] = (x, *best[x + 1, y + 1])
                else:
                    best[x, y] = max(best[x + 1, y], best[x, y + 1], key=len)
        return frozenset(best[0, 0])

    def near(a, b):
        a, b = (Counter({t: n * len(t) for t, n in Counter(x).items()}) for x in (a, b))
        return 5 * sum((a & b).values()) >= 4 * max(sum(a.values()), sum(b.values()))

    runs = []
    for k, lines in enumerate(rows):
        if runs and near(rows[runs[-1][-1]], lines):
            runs[-1].append(k)
        else:
            runs.append([k])
    r = next(r for r, run in enumerate(runs) if i in run)
    left, right = [rows[run[-1]] for run in runs[:r]], [rows[run[0]] for run in runs[r + 1 :]]
    others = left[-2:] + right[:2]
    if len(left) < 2:
        others = left + right[: 4 - len(left)]
    elif len(right) < 2:
        others = left[-(4 - len(right)) :] + right
    votes = Counter(k for x in others for k in lcs(rows[i], x))
    need = len(others) if len(others) < 3 else len(others) - 1
    return "\n".join(t for k, t in enumerate(rows[i]) if not others or votes[k] < need)


def test_differencing_brute_force():
    """Distinct short lines, so that a longest common subsequence is one only in its length's sense where it matters."""
    rng = random.Random(5)
    for _ in range(300):
        rows = []
        for k in range(rng.randrange(1, 9)):
            if rows and rng.random() < 0.3:
                rows.append(list(rows[-1]))
            else:
                rows.append([f"head {rng.randrange(2)}", *(f"line {k} {rng.random():.6f}" for _ in range(rng.randrange(4))), *[x for x in ("menu", "terms") if rng.random() < 0.8]])
        got = list(page_text._finish([(k, None, "", x, [0] * len(x), [False] * len(x)) for k, x in enumerate(rows)]))
        assert {k: t for k, _, t in got} == {k: slow_text(rows, k) for k in range(len(rows))}


def test_many_lines():
    """Pages of very many lines are aligned in little memory."""
    rng = random.Random(6)
    a = [str(rng.randrange(50)) for _ in range(6_000)]
    b = [x for x in a if rng.random() < 0.9]
    assert len(page_text.shared_lines(["x", *a, "y"], ["z", *b, "w"])) == len(b)


def test_common_subsequence_brute_force(monkeypatch):
    rng = random.Random(1)

    def longest(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for turn in range(500):
        monkeypatch.setattr(page_text, "CELLS", 8 if turn % 2 else 1 << 20)
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        got = page_text.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == longest(a, b) and all(a[i] in rest for i in sorted(got))


def test_copies_and_boxed_articles_keep_their_text(spark):
    def page(*lines):
        return f"<div>Menu</div>{''.join(f'<p>{x}</p>' for x in lines)}<div>Foot</div>"

    rows = [(i, f"http://c/d/{i}", page("copied story", "its end")) for i in range(3)]  # copies under neighbouring URLs
    rows += [(3, "http://c/d/3", page("one", "two")), (4, "http://c/d/4", page("three"))]
    rows += [(10, "http://n/d/0", page("first")), (11, "http://n/d/1", page("long shared", "mine")), (12, "http://n/d/2", page("long shared", "yours")), (13, "http://n/d/3", page("last"))]
    rows += [(20, "http://b/x", "<main><p>story</p></main><section id=comments><article>reply</article></section>")]
    rows += [(21, "http://t/x", "<main><p>story</p></main><article>card 1</article><article>card 2</article>")]
    got = {r.page_id: r.text for r in page_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(5)] == ["copied story\nits end"] * 3 + ["one\ntwo", "three"]
    assert [got[i] for i in range(10, 14)] == ["first", "long shared\nmine", "long shared\nyours", "last"]
    assert got[20] == "story" and got[21].split("\n")[0] == "story"
