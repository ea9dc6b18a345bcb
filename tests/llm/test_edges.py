"""Rows that operators must not lose: other vector lengths, repeated and null ids, several benchmark blocks, long texts."""

from __future__ import annotations

import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from yardline.llm import decontamination, itq, langid, suffix_sort, suffix_tree, toxicity, warc
from yardline.llm import textcols as tc

# ---- vectors


def cosine(x, y):
    return sum(a * b for a, b in zip(x, y)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in y))


def brute_links(rows):
    """By row: links to other distinct vectors, least id of the component."""
    sound = sorted({(i, tuple(v)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}, key=str)
    near = {r: [o for o in sound if o != r and len(o[1]) == len(r[1]) and cosine(r[1], o[1]) >= 0.9] for r in sound}
    component = {}
    for r in sound:
        if r not in component:
            seen, open_ = {r}, [r]
            while open_:
                for o in near[open_.pop()]:
                    if o not in seen:
                        seen.add(o)
                        open_.append(o)
            least = min(x[0] for x in seen)
            component |= dict.fromkeys(seen, least)
    out = []
    for i, v in rows:
        key = (i, tuple(v)) if v else None
        out.append((i, len(near[key]), component[key], component[key] == i) if key in near else (i, 0, i, True))
    return sorted(out)


@pytest.mark.parametrize("exact", [0, 12, 10_000])
def test_vectors_of_every_length_link(spark, monkeypatch, exact):
    monkeypatch.setattr(itq, "EXACT", exact)
    rng = random.Random(4)
    rows = []
    for dims, groups in ((8, 6), (3, 4), (20, 5), (1, 2)):
        for _ in range(groups):
            base = [rng.gauss(0, 1) for _ in range(dims)]
            rows += [[x + rng.gauss(0, 0.02) for x in base] for _ in range(4)] + [base, base]
    rows = [(i, v) for i, v in enumerate(rows)]
    rows += [(500, None), (501, []), (502, [0.0, 0.0]), (503, [1.0, None]), (504, [float("nan")] * 3), (505, [0.3, 0.3])]
    rows += [(600, rows[0][1]), (600, rows[-6 - 8][1]), (600, rows[0][1]), (7, rows[40][1])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, raw string, id int")
    got = sorted(map(tuple, itq.link(frame).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == brute_links(rows)


# ---- benchmark text


@pytest.mark.parametrize("block_bytes", [60, 400, 1 << 24])
@pytest.mark.parametrize("id_type", ["smallint", "bigint", "string"])
def test_the_benchmark_may_have_any_number_of_blocks(spark, monkeypatch, block_bytes, id_type):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block_bytes)
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") * rng.randrange(1, 4)
    items = [" ".join(word() for _ in range(rng.randrange(1, 40))) for _ in range(12)] + [None, "", "Short One", "a a a a a a a a a a a a a a a a"]
    texts = [" ".join(word() for _ in range(rng.randrange(0, 60))) for _ in range(30)]
    texts += [f"{texts[0]} {items[k]} {texts[1]}" for k in range(12)] + ["x short one y", None, "", "a " * 400, items[0], items[0] + " ÿ " + items[1]]
    rows = [(None if k % 7 == 3 else k % 20, t) for k, t in enumerate(texts)] + [(5, texts[31]), (5, texts[31]), (None, texts[31])]
    name = (lambda k: f"i{k}") if id_type == "string" else (lambda k: k)
    bench = [(name(k), t) for k, t in enumerate(items)] + [(name(2), items[3]), (None, items[4])]
    docs = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, n_words int, key string, spans int")
    frame = spark.createDataFrame(bench, f"item_id {id_type}, text string")

    def words(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        return "".join(c if ord(c) >= 0x80 or c.isalnum() else " " for c in lowered).split(" ")

    clean = lambda text: [w for w in words(text) if w]
    windows = {}
    for i, t in bench:
        own = clean(t)
        n = min(13, len(own))
        for k in range(len(own) - n + 1) if n else ():
            windows.setdefault(tuple(own[k : k + n]), set()).add(i)
    want = []
    for i, t in rows:
        own = clean(t)
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for k in range(len(own) - n + 1):
                if (names := windows.get(tuple(own[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= names
        names = ",".join(sorted(str(x) for x in found if x is not None))
        want.append((i, len(own), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)))
    got = decontamination.score(docs, frame).drop("longest").collect()
    assert Counter(map(tuple, got)) == Counter(want) and sum(w[5] for w in want) > 10
    kept = decontamination.decontaminate(docs, frame)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(r for r, w in zip(rows, want) if not w[5])
    assert decontamination.score(docs, frame.where("false")).where("n_hit > 0").isEmpty()
    assert decontamination.score(docs.where("false"), frame).isEmpty()


# ---- archives


@pytest.mark.parametrize("id_type", ["bigint", "smallint", "string"])
def test_archives_keep_rows_with_repeated_and_null_ids(spark, id_type):
    long, other = "x" * 150, "é" * 90
    rows = [(1, "u", long), (1, "u", other), (2, "u", long), (2, None, long), (None, "u", long), (None, "u", None), (3, "v", "short"), (3, "v", "short"), (4, "v", other), (None, "w", other)]
    if id_type == "string":
        rows = [(None if i is None else f"p{i}", u, t) for i, u, t in rows]
    frame = spark.createDataFrame([(i, u, t, "x", 1) for i, u, t in rows], f"page_id {id_type}, url string, html string, first string, n int")
    least = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 100:
            least[t] = min(least.get(t, i), i)
    want = []
    for i, _, t in rows:
        data = (t or "").encode()
        revisit = i is not None and t in least and least[t] < i
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", least[t] if revisit else None))
    got = warc.archive(frame).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert Counter(map(tuple, got)) == Counter(want)
    assert warc.archive(frame.where("false")).isEmpty()


# ---- toxic spans


def model_with(weights: dict[str, float], transitions) -> toxicity.Model:
    model = toxicity.Model(transitions=np.array(transitions, float), bias=-1.0, calibration=np.array([0.0, 1.0, 0.0]))
    for word, weight in weights.items():
        data, offs = tc.utf8(pa.array([word]))
        keys, _, _, _ = toxicity._keys(data, offs)
        model.weights[toxicity._buckets(keys)[0, 0]] = weight
    return model


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 64])
def test_marginals_do_not_depend_on_the_piece_length(monkeypatch, piece):
    rng = random.Random(2)
    model = model_with({"bad": 4.0, "vile": 2.5, "good": -3.0}, [[1.5, -1.5], [-1.0, 2.0]])
    texts = [" ".join(rng.choice(["bad", "vile", "good", "so", "it", "is"]) for _ in range(n)) for n in (0, 1, 2, 63, 64, 65, 128, 129, 1000, 5, 0, 300)]
    texts += [" ".join(["it"] * 60 + ["bad"] * 4 + ["it"] * 40)]
    data, offs = tc.utf8(pa.array(texts))
    monkeypatch.setattr(toxicity, "CHAIN", 2000)
    whole = toxicity.tag(data, offs, model)
    monkeypatch.setattr(toxicity, "CHAIN", piece)
    cut = toxicity.tag(data, offs, model)
    assert np.allclose(whole[0], cut[0], atol=1e-9) and np.allclose(whole[-1], cut[-1], atol=1e-6)
    assert 0.3 < whole[0][-40] < 0.95  # the word behind the run is drawn along


def test_spans_are_not_cut(spark):
    model = model_with({"bad": 6.0}, [[1.0, -1.0], [-1.0, 1.0]])
    text = " ".join(["fine"] * 60 + ["bad"] * 10 + ["fine"] * 200)
    frame = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, None, "y"), (2, "", "z"), (3, "bad " * 3000, "x")], "doc_id long, text string, score string")
    rows = toxicity.score(frame, model).collect()
    assert len(rows) == 5
    spans = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in rows}
    assert spans[1] == [(300, 339)] and spans[3] == [(0, 11_999)] and spans[2] == [] and spans[None] == []
    assert toxicity.score(frame.where("false"), model).isEmpty()
    assert toxicity.keep_clean(frame, model).columns == frame.columns


# ---- languages


def test_no_language_is_left_out(spark, monkeypatch):
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    letters = [chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k) for k in range(80)]
    rng = random.Random(1)
    words = lambda k, n: " ".join("".join(rng.choices(letters[k], k=5)) for _ in range(n))
    train = [(k * 10 + j, words(k, 30), f"l{k:02d}") for k in range(80) for j in range(3 if k % 9 else 1)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert len(model[0]) == 80
    rows = [(k, words(k, 20), "x", 1) for k in range(80)] + [(5, words(9, 4000), "x", 1), (5, words(9, 4000), "x", 1), (None, None, "x", 1), (6, "1 2", "x", 1)]
    got = langid.predict(spark.createDataFrame(rows, "doc_id long, text string, lang string, score int"), model).collect()
    assert len(got) == len(rows)
    named = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert all((k, f"l{k:02d}") in named for k in range(80)) and named.count((5, "l09")) == 2 and (6, "und") in named


def brute_language(train, text):
    """Naive Bayes over the same buckets, with plain loops."""
    def buckets(t):
        return [(int(b), k) for k, (bucket, whole) in enumerate(langid._grams([t])[1]) for b, w in zip(bucket, whole) if w]

    counts = {}
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(b for b, _ in buckets(t))
    sums = {}
    for lang, own in counts.items():
        total = sum(own.values()) + langid.SMOOTHING * (1 << langid.BUCKET_BITS)
        sums[lang] = sum(math.log((own[b] + langid.SMOOTHING) / total) for b, _ in buckets(text))
    best = min(sums, key=lambda x: (-sums[x], x))
    return best, 1 / sum(math.exp(s - sums[best]) for s in sums.values())


def test_scores_equal_plain_bayes(spark):
    train = [("the cat sat", "en"), ("la casa es", "es"), ("der hund und", "de"), ("the dog ran", "en"), ("una casa", "es"), ("equal", "aa"), ("equal", "bb")]
    texts = ["the hund", "casa", "a", "equal", "Der CAT casa 12 !", "x" * 50]
    model = langid.train(spark.createDataFrame([(i, *r) for i, r in enumerate(train)], "doc_id long, text string, lang string"))
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        lang, score = brute_language(train, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-3


def test_telling_words_are_learned_though_others_cover_their_documents(spark):
    rng = random.Random(7)
    prose = lambda n: [rng.choice(["river", "stone", "field", "cloud"]) + str(rng.randrange(4000)) for _ in range(n)]
    rows, labels = [], []
    for i in range(300):
        own, toxic = prose(60), i % 3 == 0
        if toxic:
            own[10] = "vile"
            if i % 2:
                own[30] = "nasty"  # always beside the other
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    copied = prose(80) + ["vile"]
    for i in range(300, 330):  # near copies of one toxic text: its other words tell nothing
        rows.append((i, " ".join(copied[:i % 40] + [f"edit{i}"] + copied[i % 40 :])))
        labels.append((i, 1))
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    asked = [(1, " ".join([*prose(40), "nasty", *prose(20)])), (2, " ".join([*prose(20), *copied[:12], *prose(20)])), (3, " ".join(prose(50)))]
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert scores[1] >= 0.5 and scores[2] < 0.5 and scores[3] < 0.5


# ---- repeated passages


def test_texts_without_an_id_come_last_and_do_not_remove_each_other(spark):
    passage = " ".join(f"w{k}" for k in range(20))
    alone = [(None, f"a b {passage} c"), (None, f"d {passage} e f")]
    frame = spark.createDataFrame(alone, "doc_id long, text string")
    assert [r["n_removed"] for r in suffix_tree.deduplicate(frame).collect()] == [0, 0]
    frame = spark.createDataFrame([*alone, (9, f"g {passage}"), (9, f"g {passage}")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in suffix_tree.deduplicate(frame).collect())
    assert got == [("9", 21, 0), ("9", 21, 0), ("None", 23, 20), ("None", 23, 20)]
    assert suffix_tree.deduplicate(frame.where("false")).isEmpty()


def test_repeated_rows_repeat_their_byte_strings(spark):
    text = "".join(chr(97 + (k * k) % 26) + str(k) for k in range(120))
    for parts in (1, 4):
        rows = [(1, text), (1, text), (2, "x" * 30), (3, text[:199]), (4, text[:250] + "!")]
        frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = sorted((r["doc_id"], r["n_removed"]) for r in suffix_sort.deduplicate(frame).collect())
        assert got == [(1, len(text)), (1, len(text)), (2, 0), (3, 0), (4, 250)]
        frame = frame.where("doc_id <> 4").dropDuplicates()
        assert all(r["n_removed"] == 0 for r in suffix_sort.deduplicate(frame).collect())


def test_training_holds_little_of_the_drivers_memory(monkeypatch):
    """The field is fitted on the driver: a few numbers a word, not several a key; and the same in blocks as at once."""
    rng = np.random.default_rng(7)
    n = 6000
    features = rng.integers(0, 1 << toxicity.WEIGHT_BITS, (n, toxicity.CHAIN, 4)).astype(np.int32) >> rng.integers(0, 12, (n, toxicity.CHAIN, 1)).astype(np.int32)
    labels, length = (rng.random((n, toxicity.CHAIN)) < 0.1).astype(np.int8), rng.integers(1, toxicity.CHAIN + 1, n)
    monkeypatch.setattr(toxicity, "ROUNDS", 2)
    model = toxicity.Model()
    tracemalloc.start()
    toxicity._fit_field(features, labels, length, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20  # 62 MB when all keys and pairs of states were held at once
    monkeypatch.setattr(toxicity, "FIT_BLOCK", n)
    whole = toxicity.Model()
    toxicity._fit_field(features, labels, length, whole)
    assert np.array_equal(model.weights, whole.weights) and model.bias == whole.bias and np.array_equal(model.transitions, whole.transitions)
    assert np.any(model.weights) and model.weights[np.setdiff1d(np.arange(len(model.weights)), features)].sum() == 0
