"""Toxic spans with a linear-chain conditional random field.

Labels stand on documents, the field learns from tokens. So the words and word
beginnings that best explain the toxic documents are chosen first (few that
cover most of them and are next to absent from clean ones); tokens that carry
one in a toxic document are the labelled tokens. The field then learns weights
of words, word beginnings and transitions. Scoring runs forward and backward
over every whole text; the marginals give the offending spans, and their sum
and maximum, calibrated on document labels, give the document's score.

Training takes about ``SAMPLE`` labelled documents of each class, chosen by a
hash of the id, ``CHAINS_EACH`` chains of each kind of them and ``MOST_KEYS``
candidate words, and so does not grow with the corpus. Scoring takes every word:
texts are worked on in pieces of ``CHAIN`` words, and the odds that pass from
piece to piece, forward and backward, give the marginals of the whole text.

Repeated rows each have a score; an empty table gives no rows; other columns
are ignored, by ``keep_clean`` carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yardline.llm import textcols as tc
from yardline.llm.storage import stored

SAMPLE = 3000
PREFIXES = (4, 5, 6)
WEIGHT_BITS = 18
#: Words in a chain of the training sample, and in a piece of a text that is scored; the odds pass from piece to piece.
CHAIN = 64
#: The training sample takes so many chains with a telling word of a document, and of clean ones so many others.
CHAINS_EACH = 2
#: Words and beginnings that may explain toxic documents of the training sample: the commonest so many.
MOST_KEYS = 5000
LEAST_SHARE, LEAST_PRECISION = 0.004, 0.97
#: Log likelihood ratio from which a key explains toxic documents whether or not another key covers them.
SURPRISE = 18.0
#: Near copies of a text are one where that is reckoned: texts that share so much of a signature of so many hashes.
SIGNATURE, COPY_SHARE = 32, 0.5
ROUNDS, RATE, DECAY = 40, 0.5, 1e-4
#: Chains whose odds are reckoned at once in training.
FIT_BLOCK = 1024


@dataclass
class Model:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << WEIGHT_BITS, np.float32))
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    calibration: np.ndarray = field(default_factory=lambda: np.zeros(3))
    #: Set where there was nothing to tell apart: the share of toxic labels.
    constant: float | None = None


def _keys(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each word and its beginnings (words x keys), and start, end and first word of each text. ``data`` is lower-cased."""
    starts, ends, firsts = tc.words(data, offs, tc.NO_ALNUM)
    keys = np.empty((len(starts), 1 + len(PREFIXES)), np.uint64)
    sums = tc._sums(tc._BYTE[data])
    back = tc._powers(len(data) + 1, True)[starts]
    for j, n in enumerate((None, *PREFIXES)):
        stop = ends if n is None else np.minimum(ends, starts + n)
        keys[:, j] = tc.mix((sums[stop] - sums[starts]) * back + np.uint64(977 * j))
    return keys, starts, ends, firsts


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - WEIGHT_BITS)).astype(np.int32)


def _chains(firsts: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of each piece of up to ``piece`` words."""
    counts = np.diff(firsts)
    per = -(-counts // piece)
    text = np.repeat(np.arange(len(counts)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    start = firsts[:-1][text] + place * piece
    return start, np.minimum(piece, firsts[1:][text] - start), text


def _marginals(
    emission: np.ndarray, length: np.ndarray, transitions: np.ndarray, before: np.ndarray | None = None, behind: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward on chains (steps x chains) of two states, kept as odds of the toxic one.

    ``before`` are the odds forward at the word before each chain (below 0: there is none),
    ``behind`` the odds backward at its last word. Returns the marginal of the
    toxic state, and the odds after each step forward and backward.
    """
    steps = np.arange(len(emission))[:, None]
    inside = steps < length
    grow = np.exp(np.clip(np.where(inside, emission, 0), -30, 30))
    (oo, ot), (to, tt) = np.exp(transitions)
    forward, backward = np.empty_like(grow), np.empty_like(grow)
    odds = grow[0]
    if before is not None:
        odds = np.where(before < 0, odds, grow[0] * (before * tt + ot) / (before * to + oo))
    forward[0] = odds
    for t in range(1, len(grow)):
        odds = grow[t] * (odds * tt + ot) / (odds * to + oo)
        forward[t] = odds
    last = np.ones(grow.shape[1]) if behind is None else behind
    odds = last
    backward[-1] = odds
    for t in range(len(grow) - 2, -1, -1):
        ahead = grow[t + 1] * odds
        odds = np.where(inside[t + 1], (ahead * tt + to) / (ahead * ot + oo), last)
        backward[t] = odds
    both = forward * backward
    return np.where(inside, both / (1 + both), 0.0), forward, backward


def _passes(emission: np.ndarray, length: np.ndarray, transitions: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How each piece (steps x pieces) changes the odds that enter it: 2 x 2 x pieces, forward and backward.

    A step maps odds x to (a x + b) / (c x + d); a piece is the product of its
    steps' matrices. At the first word of a text no odds enter.
    """
    inside = np.arange(len(emission))[:, None] < length
    grow = np.exp(np.clip(np.where(inside, emission, 0), -30, 30))
    (oo, ot), (to, tt) = np.exp(transitions)
    forward = np.repeat(np.eye(2)[:, :, None], grow.shape[1], axis=2)
    backward = forward.copy()
    for t in range(len(grow)):
        (a, b), (c, d) = forward
        g = grow[t]
        step = np.array([[g * (tt * a + ot * c), g * (tt * b + ot * d)], [to * a + oo * c, to * b + oo * d]])
        if t == 0:
            none, one = np.zeros_like(g), np.ones_like(g)
            step = np.where(begins, np.array([[none, g], [none, one]]), step)
        forward = np.where(inside[t], step / step.max(axis=(0, 1)), forward)
        (a, b), (c, d) = backward
        step = np.array([[g * (a * tt + b * ot), a * to + b * oo], [g * (c * tt + d * ot), c * to + d * oo]])
        backward = np.where(inside[t], step / step.max(axis=(0, 1)), backward)
    return forward, backward


def _boundary_odds(forward: np.ndarray, backward: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds before (below 0: none) and behind each piece, carried from piece to piece along each text."""
    n = len(text)
    before, behind = np.full(n, -1.0), np.ones(n)
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if n else np.zeros(0, np.int64)
    held = np.diff(np.append(first, n))
    place = np.arange(n) - np.repeat(first, held)
    for where, from_, passes, odds in ((place, -1, forward, before), (np.repeat(held, held) - 1 - place, 1, backward, behind)):
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(np.bincount(where, minlength=1))
        for k in range(1, len(ends)):
            at = order[ends[k - 1] : ends[k]]
            (a, b), (c, d) = passes[:, :, at + from_]
            odds[at] = (a * odds[at + from_] + b) / (c * odds[at + from_] + d)
    return before, behind


def _fit_field(features: np.ndarray, labels: np.ndarray, length: np.ndarray, model: Model) -> None:
    """Gradient ascent on the likelihood of the labelled chains (chains x CHAIN), with AdaGrad steps.

    Runs on the driver, in little memory: keys are looked up and summed step by
    step, the odds of ``FIT_BLOCK`` chains at once. Held for all words are a few
    numbers of each, and nothing once per key but the features themselves.
    """
    steps, n = features.shape[1], len(features)
    inside = np.arange(steps)[:, None] < length
    ends = np.cumsum(inside.sum(axis=1))
    truth = labels.T * inside
    weights, moved = np.zeros(len(model.weights)), np.full(len(model.weights), 1e-8)
    small, small_moved = np.zeros(5), np.full(5, 1e-8)
    pair = inside[1:]
    seen = np.array([((truth[:-1] == a) & (truth[1:] == b) & pair).sum() for a in (0, 1) for b in (0, 1)])
    total = inside.sum()
    for _ in range(ROUNDS):
        emission = np.zeros((steps, n))
        for t in range(steps):
            emission[t, inside[t]] = weights[features[inside[t], t]].sum(axis=1) + small[4]
        transitions = small[:4].reshape(2, 2)
        marginal, forward, backward = (np.empty((steps, n)) for _ in range(3))
        for a in range(0, n, FIT_BLOCK):
            of = slice(a, a + FIT_BLOCK)
            marginal[:, of], forward[:, of], backward[:, of] = _marginals(emission[:, of], length[of], transitions)
        gap = truth[inside] - marginal[inside]
        del marginal
        gradient = np.zeros(len(weights))
        for t, own in enumerate(np.split(gap, ends[:-1])):
            keys = features[inside[t], t]
            np.add.at(gradient, keys.ravel(), np.repeat(own, keys.shape[1]))
        gradient = gradient / total * 100 - DECAY * weights
        moved += gradient**2
        weights += RATE * gradient / np.sqrt(moved)
        expected = _expected_pairs(emission, forward, backward, pair, small[:4])
        gradient = np.append(seen - expected, gap.sum()) / total * 100 - DECAY * small
        small_moved += gradient**2
        small += RATE * gradient / np.sqrt(small_moved)
    model.weights[:] = weights
    model.bias, model.transitions = float(small[4]), small[:4].reshape(2, 2)


def _expected_pairs(emission: np.ndarray, forward: np.ndarray, backward: np.ndarray, pair: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """How often the field expects each pair of states (clean or toxic, then clean or toxic) at the steps in ``pair``."""
    (oo, ot, to, tt), share, expected = np.exp(transitions), np.empty(pair.shape), np.empty(4)
    for k, joint in enumerate((lambda f, x: oo, lambda f, x: x * ot, lambda f, x: f * to, lambda f, x: f * x * tt)):
        for t in range(len(pair)):
            f, x = forward[t], np.exp(np.clip(emission[t + 1], -30, 30)) * backward[t + 1]
            share[t] = joint(f, x) / (oo + x * ot + f * to + f * x * tt) * pair[t]
        expected[k] = share.sum()
    return expected


def _fit_calibration(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(len(beta))
        beta += np.linalg.solve(hessian, design.T @ (y - p) - 0.1 * beta)
    return beta


def tag(data: np.ndarray, offs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marginal, start and end byte of each word, first words, and the two aggregates of each text."""
    data = tc.LOWER[data]
    keys, starts, ends, firsts = _keys(data, offs)
    emission = model.weights[_buckets(keys)].sum(axis=1, dtype=np.float64) + model.bias
    start, length, text = _chains(firsts, CHAIN)

    def parts() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Pieces in groups: which, the words of their steps, and whether a step is one of the piece."""
        for a in range(0, len(start), 8192):
            of = slice(a, a + 8192)
            yield of, start[of] + np.arange(CHAIN)[:, None], np.arange(CHAIN)[:, None] < length[of]

    at_step = lambda words: emission[np.minimum(words, len(emission) - 1)]
    begins = np.append(True, text[1:] != text[:-1]) if len(text) else np.zeros(0, bool)
    passes = [_passes(at_step(words), length[of], model.transitions, begins[of]) for of, words, _ in parts()]
    before, behind = _boundary_odds(*(np.concatenate(x, axis=2) for x in zip(*passes)), text) if passes else (None, None)
    marginal = np.zeros(len(starts))
    for of, words, inside in parts():
        p, _, _ = _marginals(at_step(words), length[of], model.transitions, before[of], behind[of])
        marginal[words[inside]] = p[inside]
    full = np.flatnonzero(np.diff(firsts))
    total, top = np.zeros(len(offs) - 1), np.zeros(len(offs) - 1)
    if len(full):
        total[full] = np.add.reduceat(marginal, firsts[full])
        top[full] = np.maximum.reduceat(marginal, firsts[full])
    top = np.clip(top, 1e-9, 1 - 1e-9)
    return marginal, starts, ends, firsts, np.column_stack([np.log(total + 1e-3), np.log(top / (1 - top))])


def _map(df: DataFrame, f, schema: str) -> DataFrame:
    """``f(text bytes, offsets, batch part)`` gives a record batch or none for each slice of texts (last column)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tc.utf8(batch.column(batch.num_columns - 1))
            for first, end, part, part_offs in tc.slices(data, offs):
                yield f(part, part_offs, batch.slice(first, end - first))

    return df.mapInArrow(scan, schema)


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> Model:
    """Learn from the rows of ``labels`` (``doc_id``, ``toxic`` 0 or 1) whose documents are in ``docs``.

    Null labels and texts are left out; of conflicting labels the toxic one
    counts, and equal texts are one. Without both classes the score is a constant.
    """
    labels = labels.where(F.col("toxic").isNotNull()).groupBy(id_column).agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r[0]: r[1] for r in labels.groupBy("toxic").count().collect()}
    model = Model()
    if not counts.get(0) or not counts.get(1):
        model.constant = 1.0 if counts.get(1) else 0.0
        return model
    place = F.pmod(F.xxhash64(F.lit("toxic"), F.col(id_column)), F.lit(1 << 30)) / float(1 << 30)
    chosen = labels.where(place < F.when(F.col("toxic") == 1, min(1.0, SAMPLE / counts[1])).otherwise(min(1.0, SAMPLE / counts[0])))
    texts = docs.where(F.col("text").isNotNull()).select(id_column, "text").join(F.broadcast(chosen), id_column)
    sample = stored(texts.select("toxic", "text").groupBy("text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"))

    def count(data, offs, part):
        keys, _, _, firsts = _keys(tc.LOWER[data], offs)
        toxic = part.column(0).to_numpy()
        own = [np.unique(keys[firsts[i] : firsts[i + 1]]) for i in range(len(toxic))]
        every, where = np.unique(np.concatenate(own), return_inverse=True)
        marks = np.repeat(toxic, [len(x) for x in own])
        sums = [np.bincount(where, marks == c, len(every)).astype(np.int64) for c in (1, 0)]
        return pa.RecordBatch.from_arrays([pa.array(every.view(np.int64)), *map(pa.array, sums)], ["key", "bad", "clean"])

    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    bad, clean = sizes.get(1, 0), max(1, sizes.get(0, 0))
    sums = _map(sample, count, "key long, bad long, clean long").groupBy("key").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))
    likely = sums.where(F.col("bad") >= max(3, LEAST_SHARE * bad)).where(F.col("bad") / bad >= LEAST_PRECISION * (F.col("bad") / bad + F.col("clean") / clean))
    found = likely.orderBy(F.desc("bad"), "clean", "key").limit(MOST_KEYS).collect()
    candidates = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    order = np.argsort(candidates)
    candidates = candidates[order]
    clean_of = np.array([r["clean"] for r in found], np.int64)[order]

    def present(keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(candidates, keys), max(0, len(candidates) - 1))
        return np.where(candidates[at] == keys, at, -1) if len(candidates) else np.full(keys.shape, -1)

    def cover(data, offs, part):
        keys, _, _, firsts = _keys(tc.LOWER[data], offs)
        at = present(keys)
        words = [slice(firsts[i], firsts[i + 1]) for i in range(len(offs) - 1)]
        found = [np.unique(at[own]) for own in words]
        marks = [_signature(keys[own, 0]).view(np.int64) for own in words]
        columns = [pa.array([x[x >= 0] for x in found], pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, ["found", "marks"])

    rows = _map(sample.where("toxic = 1"), cover, "found array<long>, marks array<long>").collect()
    having = [set(r["found"]) for r in rows]
    seeds = _cover(having, max(3, LEAST_SHARE * bad))
    texts = _copies(np.array([r["marks"] for r in rows], np.int64).reshape(-1, SIGNATURE))
    seen = {(int(t), k) for t, own in zip(texts, having) for k in own}
    apart = np.bincount([k for _, k in seen], minlength=len(candidates))
    strong = _surprise(np.column_stack([apart, clean_of]).astype(float), len(set(texts.tolist())), clean) >= SURPRISE
    wanted = np.append(strong, False)
    wanted[list(seeds)] = True

    def chains(data, offs, part):
        keys, _, _, firsts = _keys(tc.LOWER[data], offs)
        toxic = part.column(0).to_numpy().astype(bool)
        marked = wanted[present(keys)].any(axis=1)
        start, length, text = _chains(firsts, CHAIN)
        at = np.minimum(start[:, None] + np.arange(CHAIN), max(0, len(keys) - 1))
        inside = np.arange(CHAIN) < length[:, None]
        held = marked[at] & inside if len(keys) else np.zeros_like(inside)
        own, kind = held & toxic[text][:, None], held.any(axis=1)
        chance = tc.mix(keys[start, 0] + (start - firsts[:-1][text]).astype(np.uint64))  # the same wherever the text stands
        order = np.lexsort([chance, kind, text])
        group = text[order] * 2 + kind[order]
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.zeros(0, np.int64)
        rank = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        take = order[rank < CHAINS_EACH]
        take = take[~toxic[text[take]] | own[take].any(axis=1)]  # the rest of a toxic document may hold what no seed names
        features = _buckets(keys[at[take]]) if len(keys) else np.zeros((0, CHAIN, 1 + len(PREFIXES)), np.int32)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([x.tobytes() for x in features], pa.binary()),
                pa.array([x.astype(np.int8).tobytes() for x in own[take]], pa.binary()),
                pa.array(length[take], pa.int64()),
            ],
            ["features", "marks", "length"],
        )

    got = _map(sample, chains, "features binary, marks binary, length long").toArrow()
    if got.num_rows:
        # In a fixed order, so that sums and with them the model are the same in each run.
        rows = sorted(zip(*(got[c].to_pylist() for c in ("features", "marks", "length"))))
        features = np.frombuffer(b"".join(r[0] for r in rows), np.int32).reshape(-1, CHAIN, 1 + len(PREFIXES))
        marks = np.frombuffer(b"".join(r[1] for r in rows), np.int8).reshape(-1, CHAIN)
        length = np.array([r[2] for r in rows], np.int64)
        del got, rows  # The field takes memory of the driver: what it was put together from goes first.
        _fit_field(features, marks, length, model)

    def aggregates(data, offs, part):
        x = tag(data, offs, model)[-1]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "total", "top"])

    rows = _map(sample, aggregates, "toxic int, total double, top double").toArrow().sort_by([(c, "ascending") for c in ("toxic", "total", "top")])
    model.calibration = _fit_calibration(np.column_stack([rows["total"].to_numpy(), rows["top"].to_numpy()]), rows["toxic"].to_numpy())
    return model


def _signature(words: np.ndarray) -> np.ndarray:
    """Least hashes of the words of a text under several hash functions; texts that share most of them are copies."""
    salts = tc.mix(np.arange(1, SIGNATURE + 1, dtype=np.uint64))
    return np.array([tc.mix(words ^ s).min() if len(words) else s for s in salts], np.uint64)


def _copies(marks: np.ndarray) -> np.ndarray:
    """The least place of a near copy of each text, by their signatures."""
    least = np.arange(len(marks))
    for i in range(len(marks)):
        near = (marks[i + 1 :] == marks[i]).mean(axis=1) >= COPY_SHARE
        least[i + 1 :][near] = np.minimum(least[i + 1 :][near], least[i])
    return least


def _surprise(counts: np.ndarray, bad: int, clean: int) -> np.ndarray:
    """How much more likely the counts (toxic and clean documents with a key) are if the key tells the classes apart: the log of the ratio."""
    out = np.zeros(len(counts))
    if len(counts):
        share = counts.sum(axis=1) / (bad + clean)
        for held, of in ((counts[:, 0], bad), (counts[:, 1], clean)):
            for n, p in ((held, share), (of - held, 1 - share)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    out += np.where(n > 0, n * np.log(n / (of * p)), 0.0)
    return out


def _cover(having: list[set[int]], least: float) -> set[int]:
    """Greedy cover: the key in most documents not yet covered, while it is in ``least`` of them."""
    chosen: set[int] = set()
    inverse: dict[int, set[int]] = {}
    for d, keys in enumerate(having):
        for k in keys:
            inverse.setdefault(k, set()).add(d)
    while inverse:
        best = max(inverse, key=lambda k: (len(inverse[k]), -k))
        docs = inverse.pop(best)
        if len(docs) < least:
            break
        chosen.add(best)
        gone = set(docs)
        for k in {k for d in gone for k in having[d]} & inverse.keys():
            inverse[k] -= gone
    return chosen


def _scores(x: np.ndarray, model: Model) -> np.ndarray:
    if model.constant is not None:
        return np.full(len(x), model.constant)
    return 1 / (1 + np.exp(-np.clip(model.calibration[0] + x @ model.calibration[1:], -30, 30)))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with scores below ``threshold``, with all their columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = tc.utf8(batch.column(at))
            for first, end, part, part_offs in tc.slices(data, offs):
                scores = _scores(tag(part, part_offs, sent.value)[-1], sent.value)
                yield batch.slice(first, end - first).filter(pa.array(scores < threshold))

    return docs.mapInArrow(scan, docs.schema)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, score, spans`` per row; spans are (start, end, probability) in code points of maximal runs of toxic words.

    Null and empty texts have no spans and the score of a text without toxic words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def judge(data, offs, part):
        m = sent.value
        marginal, starts, ends, firsts, x = tag(data, offs, m)
        scores = _scores(x, m)
        hot = np.flatnonzero(marginal >= 0.5) if m.constant is None else []
        spans: list[list[dict]] = [[] for _ in range(len(x))]
        if len(hot):
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            text = np.searchsorted(firsts, hot, "right") - 1
            for w, t in zip(hot.tolist(), text.tolist()):
                a, b = int(points[starts[w]] - points[offs[t]]), int(points[ends[w]] - points[offs[t]])
                own = spans[t]
                if own and own[-1]["word"] == w - 1:
                    own[-1].update(end=b, word=w, probability=max(own[-1]["probability"], float(marginal[w])))
                else:
                    own.append({"start": a, "end": b, "word": w, "probability": float(marginal[w])})
            for own in spans:
                for s in own:
                    del s["word"]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(spans, span_type)], ["doc_id", "score", "spans"])

    schema = f"doc_id {docs.schema[id_column].dataType.simpleString()}, score double, spans array<struct<start:long,end:long,probability:double>>"
    return _map(docs.select(id_column, "text"), judge, schema)
