"""Language-model scores from a causal self-attention model trained here in numpy.

Words become subword ids (byte-level BPE).  A single causal attention layer reads the ids: the
``OWN + EXTRA`` most frequent have queries, keys and values of their own, the others share those of
their class.  It predicts the next id in two steps, as a class and an id within the class.  The
most frequent ids are classes of their own; the others share classes, formed by which frequent ids
they stand near.  The layer works on top of class pair counts; an id's probability within its class
comes from the counts of all training text.  A text is scored in windows of ``BLOCK`` positions that
also see ``BLOCK`` positions before them, so windows overlap and each id is scored once, many
windows to a batch under one causal mask.  A word's probability mixes the product over its ids with
its discounted share of all training words.

All counts cover every training text from its start to its end, and so does the layer: the ids of a
text are cut into windows that overlap by the ``BLOCK`` ids they see before their first target, so
the layer, the class pairs and the neighbours that form the classes learn from each id exactly once.

Windows are dealt to groups by hash and sorted in them, so scores don't depend on how the input is
partitioned.  Groups train side by side and their parameters are averaged after every round, in two
steps, so that the driver receives a number of parameter sets that grows with the root of the
groups.  Word counts aren't broadcast: each part of the corpus (of bounded size) is sent the counts
of the words it holds and is scored beside them.
"""

from __future__ import annotations

import gc
import math
import operator
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch, slices
from tessera.llm.tokens import ranks, vocabulary_file

OWN, SHARED, INNER = 47, 16, 6  # of the shared classes, so many hold ids that don't begin a word
END, PAD = OWN + SHARED, OWN + SHARED + 1  # PAD: start of a text, and what stands before it
CLASSES = OWN + SHARED + 1
#: Ids without a class of their own that have vectors of their own; inputs of the layer are the classes, PAD and these.
EXTRA = 4_000
INPUTS = CLASSES + 1 + EXTRA
BLOCK = 16
WIDTH, VALUE = 8, 16
#: Ids of a training window, the BLOCK before its targets included; one window in NTH is trained on: all.
WINDOW, NTH = 512 + BLOCK, 1
ROUNDS, BATCH, RATE = 4, 8, 0.02
#: Windows of a group that trains on its own, about.
GROUP = 8_192
#: Windows scored at once; always so many, so that a window's rounding doesn't depend on the others.
SCORED = 128
#: Windows learnt from at once, of a batch; their gradients are summed.
LEARNT = 64
#: Parameters updated at once.
STEP = 16_384
#: Words whose scores are put together at once, about, and bytes of texts whose words are looked up at once, at most.
TOGETHER, JOINED = 16_000, 1 << 29
#: Words whose ids a task remembers.
KNOWN = 200_000
#: Characters of a part of the corpus, about.
PART = 24_000_000
#: Parts up to which they get names that spread them evenly.
NAMED = 1_000
DISCOUNT, MIX = 0.75, 0.05


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words between runs of space and U+0009..U+000D, in UTF-8."""
    return text.encode().lower().split() if text else []


def laid_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """``words`` of all texts end to end, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    flat, bounds = split.values, split.offsets.to_numpy()
    real = pc.binary_length(flat).to_numpy() > 0  # white space at an end of a text leaves an empty word there
    before = np.append(0, np.cumsum(real))
    return flat.filter(pa.array(real)).cast(pa.binary()), before[bounds[1:]] - before[bounds[:-1]]


def _bounds(column: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes under a binary column without nulls, and where each of its rows begins and the last ends."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int32)
    return memoryview(column.buffers()[2] or b""), bounds


def _rows(column: pa.Array) -> list[bytes]:
    """A binary column's rows; ``to_pylist`` takes several times as long."""
    data, bounds = _bounds(column)
    held, ends = bytes(data[bounds[0] : bounds[-1]]), (bounds - bounds[0]).tolist()
    return [held[a:b] for a, b in zip(ends, ends[1:], strict=False)]


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


@lru_cache(maxsize=2)
def _library(path: str):
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


# -- the attention layer ------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _bytes(path: str) -> np.ndarray:
    """How many bytes each id stands for."""
    out = np.zeros(max(ranks(path).values()) + 1, np.int64)
    for token, i in ranks(path).items():
        out[i] = len(token)
    return out


def encoded(path: str, found: list[bytes]) -> list[bytes]:
    """The subword ids (two bytes each) of each word after a space.

    No match of the pattern goes on after a word that holds no white space, so such words are
    encoded in one call and told apart by the bytes their ids stand for.
    """
    library, text = _library(path), b"".join(b" " + w for w in found).decode()
    if len(text.split()) != len(found):
        return [np.array(library.encode_ordinary(" " + w.decode()), "<u2").tobytes() for w in found]
    ids = library.encode_to_numpy(text)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    cuts = [0, *(2 * np.searchsorted(np.cumsum(_bytes(path)[ids]), ends) + 2).tolist()]
    coded = ids.astype("<u2").tobytes()
    return [coded[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _summed(index: np.ndarray, rows: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``rows`` by input: those of an input are brought together and added as one run."""
    order = np.argsort(index.astype(np.uint16), kind="stable")
    found = index[order]
    starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
    if out is None:
        out = np.zeros((INPUTS, rows.shape[1]), rows.dtype)
    else:
        out.fill(0)
    out[found[starts]] = np.add.reduceat(rows.take(order, 0), starts, axis=0)
    return out


class _Space:
    """Arrays that are written again for every piece of work, so that they stay in a core's cache."""

    def __init__(self, dtype) -> None:
        self.dtype, self.held = dtype, {}

    def __call__(self, name: str, rows: int, *shape: int) -> np.ndarray:
        found = self.held.get(name)
        if found is None or len(found) < rows:
            found = self.held[name] = np.empty((rows, *shape), self.dtype)
        return found[:rows]


class Attention:
    """One causal attention layer from inputs (classes, ``PAD``, ids) to classes."""

    SHAPES = {"q": (INPUTS, WIDTH), "k": (INPUTS, WIDTH), "v": (INPUTS, VALUE), "r": (2 * BLOCK,), "w": (VALUE, CLASSES)}
    #: Each input's query, key and value side by side.
    VECTORS = (INPUTS, 2 * WIDTH + VALUE)

    def __init__(self, pairs: np.ndarray, class_of: np.ndarray | None = None) -> None:
        """``pairs``: how often each class (or PAD) is followed by each class; ``class_of``: of every input."""
        self.class_of = np.concatenate([np.arange(CLASSES + 1), np.zeros(EXTRA, int)]) if class_of is None else class_of
        rng = np.random.default_rng(1)
        self.p = {n: (rng.standard_normal(s) * 0.1).astype(np.float32) for n, s in self.SHAPES.items()}
        one = (pairs.sum(0) + 0.5) / (pairs.sum() + 0.5 * CLASSES)
        self.pair = np.log((pairs + 20 * one) / (pairs.sum(1, keepdims=True) + 20)).astype(np.float32)
        i, j = np.arange(BLOCK)[:, None] + BLOCK, np.arange(2 * BLOCK)[None, :]
        self.back = np.clip(i - j, 0, 2 * BLOCK - 1)
        self.mask = np.where(j <= i, 0, -1e9).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([self._vectors().ravel(), self.p["r"], self.p["w"].ravel()])

    def load(self, flat: np.ndarray) -> None:
        self.view(flat.astype(np.float32))

    def view(self, flat: np.ndarray) -> np.ndarray:
        """Make the parameters parts of ``flat``, so that what is written there changes them; its part that holds the vectors."""
        vectors, self.p["r"], self.p["w"] = self.parts(flat)
        self.p["q"], self.p["k"], self.p["v"] = self._sides(vectors)
        return vectors

    @classmethod
    def parts(cls, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``flat``: vectors, ``r`` and ``w``."""
        one = math.prod(cls.VECTORS)
        two = one + 2 * BLOCK
        return flat[:one].reshape(cls.VECTORS), flat[one:two], flat[two:].reshape(cls.SHAPES["w"])

    @staticmethod
    def _sides(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return x[..., :WIDTH], x[..., WIDTH : 2 * WIDTH], x[..., 2 * WIDTH :]

    def _vectors(self) -> np.ndarray:
        return np.concatenate([self.p["q"], self.p["k"], self.p["v"]], 1)

    def _bias(self) -> np.ndarray:
        """What the distance adds to each place's weight on each key."""
        return self.mask + self.p["r"][self.back]

    def _forward(self, keys: np.ndarray, vectors: np.ndarray, bias: np.ndarray, space: _Space):
        """Queries, keys, values, weights and their sums, mixed values, and logits.

        Products are taken window by window, so a window's rounding doesn't depend on the others or on
        its place among them: BLAS may round the rows of one product of matrices differently.
        """
        n = len(keys)
        x = vectors.take(keys, 0, out=space("x", n, 2 * BLOCK, self.VECTORS[1]), mode="clip")
        q, k, v = self._sides(x)
        q = q[:, BLOCK:]
        s = np.matmul(q, k.transpose(0, 2, 1), out=space("s", n, BLOCK, 2 * BLOCK))
        s += bias
        early = np.flatnonzero(keys[:, 0] == PAD)  # before a window's first key that isn't PAD all are
        if len(early):
            s[early] += _PENALTY[keys[early]][:, None, :]
        if s.size and s.max() > 60:
            np.minimum(s, 60, out=s)
        np.exp(s, out=s)
        total = (s.reshape(-1, 2 * BLOCK) @ _ONES[: 2 * BLOCK].astype(s.dtype)).reshape(n, BLOCK, 1)
        h = np.matmul(s, v, out=space("h", n, BLOCK, VALUE))
        h /= total
        logits = np.matmul(h, self.p["w"], out=space("logits", n, BLOCK, CLASSES)).reshape(-1, CLASSES)
        near = space("pair", n * BLOCK, CLASSES) if self.pair.dtype == space.dtype else None
        logits += self.pair.take(self.class_of.take(keys[:, BLOCK:].ravel()), 0, out=near, mode="clip")
        return q, k, v, s, total, h, logits

    def log_probs(self, keys: np.ndarray, targets: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of each target, and of all classes that ``begin`` (0 or 1) marks,
        at each target's place; keys (windows x 2 BLOCK), targets (windows x BLOCK)."""
        out, starts = np.empty(targets.size, np.float32), np.empty(targets.size, np.float32)
        sums, vectors, row = np.stack([np.ones_like(begin), begin], 1), self._vectors(), np.arange(SCORED * BLOCK) * CLASSES
        bias, space = self._bias(), _Space(vectors.dtype)
        for a in range(0, len(keys), SCORED):
            part, some = targets[a : a + SCORED].ravel(), keys[a : a + SCORED]
            if len(some) < SCORED:
                some = np.concatenate([some, np.full((SCORED - len(some), 2 * BLOCK), PAD, some.dtype)])
            logits = self._forward(some, vectors, bias, space)[-1]
            picked = logits.ravel().take(row[: len(part)] + part)
            np.exp(logits, out=logits)
            whole, first = np.log(logits @ sums)[: len(part)].T
            np.subtract(picked, whole, out=out[a * BLOCK : a * BLOCK + len(part)])
            np.subtract(first, whole, out=starts[a * BLOCK : a * BLOCK + len(part)])
        return out, starts

    def gradient(self, keys: np.ndarray, targets: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability, ``weight`` (0 or 1) choosing the targets."""
        vectors = self._vectors()
        out = np.empty(vectors.size + 2 * BLOCK + VALUE * CLASSES, vectors.dtype)
        self.gradient_into(out, keys, targets, weight, vectors, _Space(vectors.dtype))
        each, r, w = self.parts(out)
        return dict(zip("qkvrw", (*self._sides(each), r, w), strict=True))

    def gradient_into(self, out: np.ndarray, keys: np.ndarray, targets: np.ndarray, weight: np.ndarray, vectors: np.ndarray, space: _Space) -> None:
        """The gradient, laid out as ``flat`` is.

        Some windows at a time, so that what they need stays in a core's cache.  A window that goes
        on from the one before it has that one's keys, whose sums meet there before they are dealt to inputs.
        """
        n, both, w = len(keys), WIDTH + VALUE, self.p["w"]
        begun = np.flatnonzero(np.append(True, (keys[1:, :BLOCK] != keys[:-1, BLOCK:]).any(axis=1)))
        rows = space("rows", (n + len(begun)) * BLOCK, self.VECTORS[1])
        own = rows[: n * BLOCK].reshape(n, BLOCK, -1)
        early = space("early", n, BLOCK, both)  # of the keys and values that stand before
        each, r, dw = self.parts(out)
        dw.fill(0)
        back, share = np.zeros((BLOCK, 2 * BLOCK)), (weight * (1 / max(1.0, weight.sum()))).astype(vectors.dtype)
        bias, ones, row, wt = self._bias(), _ONES.astype(vectors.dtype), np.arange(LEARNT * BLOCK) * CLASSES, np.ascontiguousarray(w.T)
        for a in range(0, n, LEARNT):
            b = min(n, a + LEARNT)
            q, k, v, s, total, h, logits = self._forward(keys[a:b], vectors, bias, space)
            s /= total
            d, part = np.exp(logits, out=logits), share[a:b].ravel()
            d *= (part / (d @ ones))[:, None]
            d.ravel()[row[: len(d)] + targets[a:b].ravel()] -= part
            dw += h.reshape(-1, VALUE).T @ d
            dh = np.matmul(d, wt, out=space("dh", len(d), VALUE)).reshape(h.shape)
            dv = np.matmul(s.transpose(0, 2, 1), dh, out=space("dv", b - a, 2 * BLOCK, VALUE))
            ds = np.matmul(dh, v.transpose(0, 2, 1), out=space("ds", b - a, BLOCK, 2 * BLOCK))
            h *= dh
            ds -= (h.reshape(-1, VALUE) @ ones[:VALUE]).reshape(total.shape)
            ds *= s
            back += ds.sum(axis=0)
            dk = np.matmul(ds.transpose(0, 2, 1), q, out=space("dk", b - a, 2 * BLOCK, WIDTH))
            own[a:b, :, :WIDTH] = np.matmul(ds, k, out=space("dq", b - a, BLOCK, WIDTH))
            own[a:b, :, WIDTH : 2 * WIDTH], early[a:b, :, :WIDTH] = dk[:, BLOCK:], dk[:, :BLOCK]
            own[a:b, :, 2 * WIDTH :], early[a:b, :, WIDTH:] = dv[:, BLOCK:], dv[:, :BLOCK]
        rows[n * BLOCK :, :WIDTH] = 0
        rows[n * BLOCK :, WIDTH:] = early[begun].reshape(-1, both)
        early[begun] = 0
        own[:-1, :, WIDTH:] += early[1:]
        r[:] = np.bincount(self.back.ravel(), back.ravel(), 2 * BLOCK)
        _summed(np.concatenate([keys[:, BLOCK:].ravel(), keys[begun, :BLOCK].ravel()]), rows, each)


_ONES = np.ones(max(2 * BLOCK, CLASSES), np.float32)
#: What stands before a text's start weighs little.
_PENALTY = np.where(np.arange(INPUTS) == PAD, -4, 0).astype(np.float32)


def blocks(inputs: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts laid end to end, each text's end included in its length.

    Returns keys, the inputs that are to be predicted and, for each of ``inputs``, its place among them.
    """
    counts = -(-lengths // BLOCK)
    first, ends = np.cumsum(counts) - counts, np.cumsum(lengths)
    place = np.arange(len(inputs)) + np.repeat(first * BLOCK - (ends - lengths), lengths)
    targets = np.zeros((counts.sum(), BLOCK), inputs.dtype)
    targets.ravel()[place] = inputs
    before = np.full(targets.shape, PAD, inputs.dtype)  # the input at i is the class before target i
    known = np.ones(len(inputs), bool)
    known[ends[lengths > 0] - 1] = False
    before.ravel()[place[known] + 1] = inputs[known]
    keys = np.empty((len(targets), 2 * BLOCK), inputs.dtype)
    keys[:, BLOCK:] = before
    keys[1:, :BLOCK] = before[:-1]
    keys[first[lengths > 0], :BLOCK] = PAD
    return keys, targets, place


# -- training -----------------------------------------------------------------------------------


def picked(doc_id, k: int) -> bool:
    """Whether the ``k``-th window of a document is trained on: every one is."""
    return zlib.crc32(f"{doc_id}/{k}".encode()) % NTH == 0


def cut(ids: bytes) -> list[bytes]:
    """A text's windows, two bytes an id.  A window that is full has one after it, which begins with
    its last ``BLOCK`` ids and may hold no more than these and the text's end."""
    full, step = 2 * WINDOW, 2 * (WINDOW - BLOCK)
    return [ids[a : a + full] for a in range(0, max(0, len(ids) - full + step) // step * step + 1, step)]


def _parts(docs: DataFrame, path: str, id_col: str, text: str) -> DataFrame:
    """``(id, text, part, windows)``: documents with the part they belong to, parts being bounded runs
    of a partition, and the training windows' subword ids (two bytes each)."""

    def run(batches):
        pid, piece, size, known = TaskContext.get().partitionId(), 0, 0, {}
        for b in slices(batches):
            parts, windows = [], []
            unseen = np.array(list(map(held_out, b.column(0).to_pylist())), bool)
            chars = pc.fill_null(pc.utf8_length(b.column(1)), 0).to_numpy().tolist()
            laid, lengths = laid_words(b.column(1).filter(pa.array(~unseen)))
            found = laid.dictionary_encode()
            names = _rows(found.dictionary)
            if len(known) > KNOWN:
                known.clear()
            new = [w for w in names if w not in known]
            known.update(zip(new, encoded(path, new), strict=True))
            coded, bounds = map([known[w] for w in names].__getitem__, found.indices.to_numpy().tolist()), iter(lengths.tolist())
            for t, out in zip(chars, unseen.tolist(), strict=True):
                if size > PART:
                    piece, size = piece + 1, 0
                size += t
                parts.append(pid << 24 | piece)
                windows.append([] if out else cut(b"".join(islice(coded, next(bounds)))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(parts, pa.int64()), pa.array(windows, pa.list_(pa.binary()))], ["id", "text", "part", "windows"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, text string, part long, windows array<binary>")


_THE_END = pa.array([b""])


def _counted(parts: DataFrame) -> DataFrame:
    """``(part, word, n)``: every word of a part with its count in training documents; "" is the end."""

    def run(batches):
        part, learnt, unseen = None, [_THE_END[:0]], [_THE_END[:0]]

        def rows():
            found = pa.chunked_array(learnt + unseen).dictionary_encode()
            names, codes = found.chunk(0).dictionary, np.concatenate([c.indices.to_numpy() for c in found.chunks])
            n = np.bincount(codes[: sum(map(len, learnt))], minlength=len(names)).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part)), names, pa.array(n)], ["part", "word", "n"])

        for b in batches:
            of = b.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y > x and of[x] != part:
                    if part is not None:
                        yield rows()
                    part, learnt, unseen = int(of[x]), [_THE_END[:0]], [_THE_END[:0]]
                texts, out = b.column(1).slice(x, y - x), np.array(list(map(held_out, b.column(0).slice(x, y - x).to_pylist())), bool)
                for held, keep in ((learnt, ~out), (unseen, out)):
                    held.append(laid_words(texts.filter(pa.array(keep)))[0])
                    held.append(_THE_END.take(pa.array(np.zeros(keep.sum(), np.int64))))
        if part is not None:
            yield rows()

    return parts.select("id", "text", "part").mapInArrow(run, "part long, word binary, n long")


def _vocabulary(counted: DataFrame, path: str) -> DataFrame:
    """``(part, word, c, ids, first)``: for every word of a part its count in all parts and its
    subword ids (two bytes each); ``first`` marks one row of each word.

    A word has as many rows as parts hold it, at most one each.  One shuffle brings them together
    in word order, so each word's counts are summed and its ids made once, as a run of equal rows;
    the last run of a batch waits for the next batch.
    """

    def run(batches):
        names = ["part", "word", "c", "ids", "first"]

        def finish(t: pa.RecordBatch, starts: np.ndarray):
            sizes = np.diff(np.append(starts, t.num_rows))
            total = np.add.reduceat(t.column(2).to_numpy(), starts)
            named = _rows(t.column(1).take(pa.array(starts)))
            coded = iter(encoded(path, [w for w in named if w]))
            ids = [next(coded) if w else b"" for w in named]
            which = pa.array(np.repeat(np.arange(len(starts)), sizes))
            first = np.zeros(t.num_rows, bool)
            first[starts] = True
            return pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(np.repeat(total, sizes)), pa.array(ids, pa.binary()).take(which), pa.array(first)], names)

        held = None
        for b in batches:
            t = b if held is None else pa.concat_batches([held, b])
            if not t.num_rows:
                continue
            w = t.column(1)
            starts = np.append(0, np.flatnonzero(pc.not_equal(w.slice(1), w.slice(0, len(w) - 1)).to_numpy(zero_copy_only=False)) + 1)
            cut = int(starts[-1])
            if cut:
                yield finish(t.slice(0, cut), starts[:-1])
            held = t.slice(cut)
        if held is not None:
            yield finish(held, np.zeros(1, int))

    together = counted.select("part", "word", "n").repartition("word").sortWithinPartitions("word")
    return together.mapInArrow(run, "part long, word binary, c long, ids binary, first boolean")


def _laid_out(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows of a binary column end to end, and how many each row has."""
    data, bounds = _bounds(b.column(column))
    return np.frombuffer(data[bounds[0] : bounds[-1]], "<u2").astype(np.int64), np.diff(bounds).astype(np.int64) // 2


def _cells(counted: DataFrame, size: int) -> np.ndarray:
    """The sums of ``counted(cell, n)`` as an array of ``size`` cells, a number that the model fixes."""
    found = counted.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.float32)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


def _token_counts(trained: DataFrame, size: int) -> dict[int, tuple[int, int, int]]:
    """Of each subword id in training words (at most the vocabulary's size): its count, and the
    count and number of the words it begins.  ``trained(c, ids)``: each word once."""

    def run(batches):
        n, first, kinds = np.zeros((3, size))
        for b in batches:
            c = b.column(0).to_numpy()
            ids, sizes = _laid_out(b, 1)
            heads = ids[np.cumsum(sizes) - sizes]
            n += np.bincount(ids, np.repeat(c, sizes), size)
            first += np.bincount(heads, c, size)
            kinds += np.bincount(heads, minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at].astype(np.int64)) for x in (n, first, kinds))], ["token", "n", "first", "kinds"])

    rows = trained.mapInArrow(run, "token long, n long, first long, kinds long").groupBy("token").agg(*(F.sum(c).alias(c) for c in ("n", "first", "kinds")))
    return {r.token: (r.n, r.first, r.kinds) for r in rows.collect()}


def _endings(trained: DataFrame, cls: np.ndarray, size: int) -> np.ndarray:
    """Probability, over distinct training words, of the id (or the stop, at ``size``) after
    each class: classes x (size + 1), smoothed towards all classes together."""

    def run(batches):
        n = np.zeros(CLASSES * (size + 1), np.int64)
        for b in batches:
            ids, sizes = _laid_out(b, 1)
            after = np.append(ids[1:], size)
            after[np.cumsum(sizes) - 1] = size
            n += np.bincount(cls[ids] * (size + 1) + after, minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    n = _cells(trained.mapInArrow(run, "cell long, n long"), CLASSES * (size + 1)).reshape(CLASSES, size + 1)
    one = (n.sum(0) + 0.1) / (n.sum() + 0.1 * (size + 1))
    return ((n + 50 * one) / (n.sum(1, keepdims=True) + 50)).astype(np.float32)


def _near(windows: DataFrame, own: np.ndarray, size: int) -> np.ndarray:
    """How often each tail id has each own class among the ``BLOCK`` - 1 ids before it, in ``windows(w, first)``."""

    def run(batches):
        total = np.zeros(size * OWN, np.int64)
        for b in slices(batches, 512):
            ids, sizes = _laid_out(b, 0)
            window, cls = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), own[ids]
            within = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            tail = (cls < 0) & ((within >= BLOCK) | np.repeat(b.column(1).to_numpy(zero_copy_only=False), sizes))
            cells = []
            for back in range(1, BLOCK):
                ok = (window[back:] == window[:-back]) & tail[back:] & (cls[:-back] >= 0)
                cells.append(ids[back:][ok] * OWN + cls[:-back][ok])
            total += np.bincount(np.concatenate(cells), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    return _cells(windows.mapInArrow(run, "cell long, n long"), size * OWN).reshape(size, OWN)


def _clusters(x: np.ndarray, weight: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the heaviest points far from each other."""
    centre = [x[0]]
    for _ in range(k - 1):
        far = 1 - np.max([x @ c for c in centre], axis=0)
        centre.append(x[np.argmax(far * np.sqrt(weight))])
    c = np.stack(centre)
    for _ in range(12):
        label = (x @ c.T).argmax(1)
        for g in range(k):
            m = label == g
            if m.any():
                c[g] = weight[m] @ x[m]
                c[g] /= np.linalg.norm(c[g]) + 1e-6
    return label


def _inputs(counts: dict[int, tuple[int, int, int]], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The layer's input for each id, and the class of each input."""
    own = sorted(counts, key=lambda t: (-counts[t][0], t))[OWN : OWN + EXTRA]
    inputs, class_of = cls.copy(), np.concatenate([np.arange(CLASSES + 1), np.zeros(EXTRA, int)])
    inputs[own] = CLASSES + 1 + np.arange(len(own))
    class_of[CLASSES + 1 : CLASSES + 1 + len(own)] = cls[own]
    return inputs, class_of


def _classes(counts: dict[int, tuple[int, int, int]], near, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each id, and its probability within it: for ids that begin words by
    distinct words, for the others by count.  ``begins`` marks the former."""
    size, n = len(begins), np.full(len(begins), 0.5)
    for t, (whole, _, _) in counts.items():
        n[t] += whole
    order = sorted(counts, key=lambda t: (-counts[t][0], t))
    own = np.full(size, -1)
    own[order[:OWN]] = np.arange(len(order[:OWN]))
    cls = np.where(own >= 0, own, np.where(begins, OWN, OWN + SHARED - INNER))
    tail = np.array(order[OWN:], np.int64)
    close = near(own)
    for mine, low, k in ((tail[begins[tail]], OWN, SHARED - INNER), (tail[~begins[tail]], OWN + SHARED - INNER, INNER)):
        x = close[mine]
        if len(mine) > k and x.sum():
            x = np.log1p(x / (x.sum(1, keepdims=True) + 1) / (x.sum(0) / x.sum() + 1e-6))
            x /= np.linalg.norm(x, axis=1, keepdims=True) + 1e-6
            cls[mine] = low + _clusters(x, n[mine], k)
    for t, (_, _, kinds) in counts.items():
        if begins[t]:
            n[t] = kinds + 0.5
    return cls, n / np.bincount(cls, n, CLASSES)[cls]


def _window_blocks(raw: list[bytes], first: list[bool], inputs: np.ndarray, class_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, target classes and weights of training windows; the first block of a window from within a
    text is context only, and a window that isn't full ends its text."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw)) // 2
    ends = (sizes < WINDOW).astype(np.int64)
    lengths = sizes + ends
    laid = np.insert(inputs[np.frombuffer(b"".join(raw), "<u2")], np.cumsum(sizes)[ends > 0], END)
    keys, targets, real = blocks(laid, lengths)
    targets = class_of[targets]
    weights = np.zeros(targets.size, np.float32)
    weights[real] = 1
    weights = weights.reshape(targets.shape)
    counts = -(-lengths // BLOCK)
    weights[(np.cumsum(counts) - counts)[~np.array(first, bool)]] = 0
    return keys, targets, weights


def _free(frame: DataFrame) -> None:
    """Have Spark delete the shuffle files of frames that nothing refers to any more."""
    gc.collect()
    frame.sparkSession._jvm.System.gc()


def _train(windows: DataFrame, inputs: np.ndarray, class_of: np.ndarray, groups: int) -> Attention:
    """The layer on top of class pair counts, trained in rounds of averaged parameters by ``windows(g, h, w, first)``."""

    inputs = inputs.astype(np.uint16)

    def count(batches):
        n = np.zeros((CLASSES + 1) * CLASSES, np.int64)
        for b in slices(batches, 64):
            k, t, w = _window_blocks(b.column(0).to_pylist(), b.column(1).to_pylist(), inputs, class_of)
            n += np.bincount((class_of[k[:, BLOCK:]] * CLASSES + t)[w > 0].ravel(), minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["cell", "n"])

    pairs = _cells(windows.select("w", "first").mapInArrow(count, "cell long, n long"), (CLASSES + 1) * CLASSES).reshape(-1, CLASSES).astype(float)
    flat = Attention(pairs).flat()
    sets = max(1, math.isqrt(groups))

    def learner(start: np.ndarray, turn: int):
        rate = RATE / (1 + turn)

        def learn(table):
            table = table.sort_by([("h", "ascending"), ("w", "ascending")])
            raw, first, g = table.column("w").to_pylist(), table.column("first").to_pylist(), table.column("g")[0].as_py()
            model, step = Attention(pairs, class_of), 0
            flat = start.astype(np.float32)
            vectors, space = model.view(flat), _Space(flat.dtype)
            m1, m2, grown, t = (np.zeros_like(flat) for _ in range(4))
            for a in range(0, len(raw), BATCH):
                model.gradient_into(grown, *_window_blocks(raw[a : a + BATCH], first[a : a + BATCH], inputs, class_of), vectors, space)
                step += 1
                # Adam with decays 0.9 and 0.99; the sums are kept without the factors 0.1 and 0.01 of what is added
                up = (0.01 / (1 - 0.99**step)) ** 0.5
                down = 0.1 * rate / (1 - 0.9**step) / up
                for x in range(0, len(flat), STEP):  # in pieces that stay in a core's cache
                    new, sums, squares, held = grown[x : x + STEP], m1[x : x + STEP], m2[x : x + STEP], t[x : x + STEP]
                    sums *= 0.9
                    sums += new
                    squares *= 0.99
                    new *= new
                    squares += new
                    np.sqrt(squares, out=held)
                    held += 1e-8 / up
                    np.divide(sums, held, out=held)
                    held *= down
                    flat[x : x + STEP] -= held
            return pa.table({"s": [g % sets], "g": [g], "n": [float(len(raw))], "p": pa.array([(model.flat() * np.float32(len(raw))).astype("<f4").tobytes()], pa.binary())})

        return learn

    def add(table):
        table = table.sort_by("g")
        total = sum(np.frombuffer(x, "<f4").astype(np.float64) for x in table.column("p").to_pylist())
        return pa.table({"s": [table.column("s")[0].as_py()], "n": [float(sum(table.column("n").to_pylist()))], "p": pa.array([total.tobytes()], pa.binary())})

    for turn in range(ROUNDS):
        mine = windows.where(F.pmod(F.shiftright("h", 20), F.lit(ROUNDS)) == turn)  # each window in one round
        learnt = mine.groupBy("g").applyInArrow(learner(flat, turn), "s long, g long, n double, p binary")
        sums = sorted(learnt.groupBy("s").applyInArrow(add, "s long, n double, p binary").collect())
        del mine, learnt
        _free(windows)
        n = sum(r.n for r in sums)
        if n:
            flat = (sum(np.frombuffer(r.p, "<f8") for r in sums) / n).astype(np.float32)
    layer = Attention(pairs, class_of)
    layer.load(flat)
    return layer


# -- scoring ------------------------------------------------------------------------------------


class Model:
    """All that scoring needs but the word counts."""

    def __init__(self, path: str, cls: np.ndarray, inputs: np.ndarray, within: np.ndarray, heads: np.ndarray, endings: np.ndarray, layer: Attention, tokens: int, distinct: int) -> None:
        """``heads``: of each class the count and number of training words that begin with it."""
        self.inputs = inputs.astype(np.uint16)
        self.path, self.cls, self.within, self.heads, self.endings = path, cls.astype(np.uint8), within.astype(np.float32), heads, endings
        self.layer, self.tokens, self.distinct = layer, tokens, distinct
        begin = np.ones(CLASSES, np.float32)
        begin[OWN + SHARED - INNER : OWN + SHARED] = 0
        for t in np.flatnonzero(self.cls < OWN):
            begin[self.cls[t]] = _library(path).decode_single_token_bytes(int(t))[:1] == b" "
        self.begin = begin

    def _words(self, end: int, c: np.ndarray, ids: np.ndarray, size: np.ndarray):
        """What is needed of each distinct word: numbers, and its ids laid end to end."""
        first = np.cumsum(size) - size
        ids = np.insert(ids, first[end], 0)  # a place for the end, which has no id
        size = size.copy()
        size[end] = 1
        first = np.cumsum(size) - size
        cls = self.cls[ids]
        cls[first[end]] = END
        inputs = self.inputs[ids]
        inputs[first[end]] = END
        head, last = cls[first], cls[first + size - 1]
        total, kinds = self.heads[head].T
        share = (1 - MIX) * np.maximum(c - DISCOUNT, 0) / np.maximum(1, total)
        spell = np.where(total > 0, (1 - MIX) * DISCOUNT * kinds / np.maximum(1, total) + MIX, 1.0)
        share[end], spell[end] = 1.0, 0.0
        after = self.endings[np.concatenate([cls[:1], cls[:-1]]), ids]
        return {"c": c, "end": end, "size": size, "first": first, "cls": cls, "inputs": inputs, "within": self.within[ids], "after": after, "share": share, "spell": spell, "stop": self.endings[last, -1], "base": np.log10((c + 1) / (self.tokens + self.distinct + 1))}

    def score(self, texts, names, counts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float, float]]:
        """``(n_tokens, n_known, base_score, score)`` of each text; ``names`` has all their words,
        with counts, and with ids end to end, so many each."""
        names = pa.array(names, pa.binary())
        v = self._words(pc.index(names, b"").as_py(), counts, ids, sizes)
        out = []
        for numbers, todo in _numbered(texts, names):
            for w, lengths in _some(numbers, todo, v["end"]):
                out += self._scored(v, w, lengths)
        return out

    def _scored(self, v: dict, w: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int, float, float]]:
        """The same of texts whose words' numbers, each text's end included, are ``w``."""
        starts = np.cumsum(lengths) - lengths
        n = v["size"][w]
        at = np.cumsum(n) - n
        flat = np.repeat(v["first"][w] - at, n) + np.arange(n.sum())
        keys, targets, real = blocks(v["inputs"][flat], np.add.reduceat(n, starts))
        logs, begin = self.layer.log_probs(keys, self.layer.class_of[targets], self.begin)
        logs, begin = logs[real], begin[real]
        each = np.exp(logs)
        each *= v["within"][flat]
        each += v["after"][flat]
        each *= 0.5
        each[at] = v["within"][flat[at]]
        stop = np.append(np.exp(begin[at[1:]]), 1)  # the next word's place tells whether this one stops
        stop = 0.5 * (stop + v["stop"][w])
        spelled = np.exp(np.maximum(np.add.reduceat(np.log(each).astype(np.float64), at) + np.log(stop), -700))
        scores = (logs[at].astype(np.float64) - begin[at]) / math.log(10) + np.log10(v["share"][w] + v["spell"][w] * spelled)
        known = v["c"][w] > 0
        return list(zip(lengths.tolist(), *(np.add.reduceat(x, starts).tolist() for x in (known.astype(np.int64), v["base"][w], scores)), strict=True))


def _numbered(texts, names: pa.Array):
    """Of an array of texts, or of any other iterable, piece by piece: all words' places in ``names``, and how many words each text has."""
    texts = texts if isinstance(texts, pa.ChunkedArray) else pa.chunked_array([pa.array(list(texts), pa.string())])
    for piece in texts.chunks if texts.nbytes > JOINED else [pa.concat_arrays(texts.chunks)] if texts.num_chunks else []:
        laid, lengths = laid_words(piece)
        found = laid.dictionary_encode()
        places = pc.index_in(found.dictionary, value_set=names)
        if places.null_count:
            raise KeyError("a text has words that names lacks")
        yield places.to_numpy().take(found.indices.to_numpy()), lengths


def _some(numbers: np.ndarray, lengths: np.ndarray, end: int):
    """Whole texts at a time, about ``TOGETHER`` words if they aren't longer: words with each text's end, and how many."""
    ends = np.cumsum(lengths)
    a = 0
    while a < len(lengths):
        before = ends[a] - lengths[a]
        b = max(a + 1, int(np.searchsorted(ends, before + TOGETHER, "right")))
        yield np.insert(numbers[before : ends[b - 1]], ends[a:b] - before, end), lengths[a:b] + 1
        a = b


def _spread(parts: DataFrame):
    """A function that renames the parts in a frame so that a shuffle deals them out evenly.

    A part is a task's work, so two in one partition take twice as long.  The new names are numbers
    whose hashes fall on the partitions in turn; of more than ``NAMED`` parts the old names will do.
    """
    spark = parts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    old = [r.part for r in parts.select("part").distinct().limit(NAMED + 1).collect()]
    if not 0 < len(old) <= NAMED:
        return lambda frame: frame
    free: dict[int, list[int]] = {}
    for r in spark.range(64 * max(n, len(old))).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).collect():
        free.setdefault(r.p, []).append(r.id)
    turns = [free[p][k] for k in range(max(map(len, free.values()))) for p in sorted(free) if k < len(free[p])]
    names = spark.createDataFrame(list(zip(sorted(old), turns, strict=False)), "old_part long, new_part long")
    return lambda frame: frame.join(F.broadcast(names), F.col("part") == F.col("old_part")).select(*(F.col("new_part").alias("part") if c == "part" else c for c in frame.columns))


def annotate(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    A null text is empty: its only token is the end.  A null id counts as the text "" in the
    split, so its row is learnt from.  Texts of any length are scored whole.  Repeated rows are
    documents of their own; extra columns are ignored, whatever their names; no rows give no rows.
    Without training documents every class is equally likely.
    """
    path, scratch = path or vocabulary_file("byte_bpe_multi_50k.tiktoken"), Scratch(docs.sparkSession, "lm")
    parts = scratch.save(_parts(docs, path, id_col, text), "parts")
    vocab = scratch.save(_vocabulary(_counted(parts), path), "vocab")
    _free(vocab)
    one = scratch.save(vocab.where("first AND c > 0").select("word", "c", "ids"), "trained")
    tokens, distinct = one.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    trained = one.where("length(word) > 0").select("c", "ids")
    groups = max(1, (parts.agg(F.sum(F.size("windows"))).first()[0] or 0) // GROUP)
    mark = F.xxhash64("id", "k", "w")
    windows = parts.select("id", F.posexplode("windows").alias("k", "w")).select(F.pmod(mark, F.lit(groups)).alias("g"), mark.alias("h"), "w", (F.col("k") == 0).alias("first"))
    size = max(ranks(path).values()) + 1
    begins = np.zeros(size, bool)
    begins[[i for t, i in ranks(path).items() if t[:1] == b" "]] = True
    counts = _token_counts(trained, size)
    cls, within = _classes(counts, lambda own: _near(windows.select("w", "first"), own, size), begins)
    inputs, class_of = _inputs(counts, cls)
    at = cls[list(counts)].astype(int) if counts else np.zeros(0, int)
    heads = np.stack([np.bincount(at, [x[i] for x in counts.values()], CLASSES) for i in (1, 2)], 1)
    model = Model(path, cls, inputs, within, heads, _endings(trained, cls, size), _train(windows, inputs, class_of, groups), tokens, distinct)
    texts = scratch.save(parts.select("id", "text", "part"), "texts")  # scoring needs no training windows beside them
    for old in ("parts", "trained"):
        scratch.drop(old)

    def run(texts, vocabulary):
        coded = vocabulary.column("ids").cast(pa.binary()).combine_chunks()
        bounds = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset : coded.offset + len(coded) + 1]
        laid = np.frombuffer(coded.buffers()[2], "<u2", (bounds[-1] - bounds[0]) // 2, bounds[0])
        ids = texts.column("id").to_pylist()
        out = model.score(texts.column("text"), vocabulary.column("word").combine_chunks(), vocabulary.column("c").to_numpy(), laid, np.diff(bounds).astype(np.int64) // 2)
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.table([pa.array(ids, pa.int64()), pa.array(map(held_out, ids), pa.bool_()), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array([tokens] * len(ids), pa.int64()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.float64())], names=[id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    even = _spread(texts)
    both = even(texts).groupBy("part").cogroup(even(vocab.select("part", "word", "c", "ids")).groupBy("part"))
    return both.applyInArrow(run, f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
