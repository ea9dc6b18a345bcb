"""Every operator against brute force on small tables with nulls, empty, long, tied and repeated texts and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from yardline.llm import decontamination, itq, jaccard, langid, mixing, pii, suffix_sort, suffix_tree, toxicity, warc
from yardline.llm import textcols as tc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, gram int, part long, spans string, size int, a int"
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, words=400):
    return " ".join(rng.choice(["alpha", "beta", "né", "été", "straße", "x", "Of", "the"]) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage, base = prose(rng, 60), prose(rng, 160).split()
    out = [None, "", " \t\n", "word", "two words", "aa " * 300, "b" * 700, prose(rng, 20_000), "\x1cnot a separator\x85 here\x0bbut this"]
    out += ["same text " + prose(random.Random(1), 50)] * 5
    for i in range(40):
        copy = list(base)
        for _ in range(i % 9):
            copy[rng.randrange(len(copy))] = f"edit{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    out += [prose(rng, 30) + " " + passage + "\n" + prose(rng, 25) for _ in range(12)]
    out += [prose(rng, rng.randrange(1, 200), 10**6) for _ in range(40)]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, None if i % 5 == 0 else f"s{i % 5}", len(t or ""), "x", 1, 2, "y", 3, 4) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA)


def by_id(frame, *columns):
    return {r[0]: tuple(r)[1:] for r in frame.select(*columns).collect()}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, y in links:
        x, y = find(x), find(y)
        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_hashes_and_words_agree_with_python():
    data, offs = tc.utf8(__import__("pyarrow").array(["a bb", None, "", "bb\ta", "x"]))
    starts, ends, firsts = tc.words(data, offs, tc.SPACE)
    raw = data.tobytes()
    assert [raw[a:b] for a, b in zip(starts, ends)] == [b"a", b"bb", b"bb", b"a", b"x"]
    assert firsts.tolist() == [0, 2, 2, 2, 4, 5]
    h = tc.word_hashes(data, starts, ends)
    assert h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3
    assert tc.sliding_min(np.array([5, 3, 4, 9, 1], np.uint64), 3).tolist() == [3, 3, 1]


def test_jaccard_equals_brute_force(docs, texts):
    sets = {}
    for i, t in texts.items():
        w = SPACED.findall(low(t))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    part = components(sets, links)
    assert by_id(jaccard.join(docs), "doc_id", "n_shingles", "component_id") == {i: (len(sets[i]), part[i]) for i in sets}
    assert len(set(part.values())) < len(part) - 10
    kept = jaccard.keep_one(docs.union(docs.where("doc_id > 80")))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(part.values()))


def test_overlap_blocks():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    pairs = [(np.unique(rng.integers(-(2**63), 2**63 - 1, 50)), None) for _ in range(20)]
    pairs = [(a, np.sort(np.concatenate([a[: 50 - k], rng.integers(-(2**63), 2**63 - 1, k)]))) for k, (a, _) in enumerate(pairs)]
    overlap, alive = jaccard.overlaps(pa.array([a for a, _ in pairs]), pa.array([b for _, b in pairs]), 90)
    for (a, b), o, live in zip(pairs, overlap, alive):
        exact = len(set(a.tolist()) & set(b.tolist()))
        assert live == (100 * exact >= 90 * len(set(a.tolist()) | set(b.tolist())))
        assert not live or o == exact


def test_decontamination_equals_brute_force(spark, docs, texts, monkeypatch):
    words = {i: ALNUM.findall(low(t)) for i, t in texts.items()}
    long_ = words[7]
    items = {1: " ".join(long_[100:140]), 2: "word", 3: None, 4: "", 5: " ".join(words[60][32:45]), 6: "same  TEXT", 10: "nothing like it at all in any text", 11: " ".join(long_[100:140])}
    bench = spark.createDataFrame([*items.items(), (1, items[1])], "item_id long, text string")
    windows = {}
    for i, t in items.items():
        w = ALNUM.findall(low(t))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    expected = {}
    for i, w in words.items():
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[g]
        expected[i] = (len(w), len(hit), len(found), sha(",".join(sorted(map(str, found))).encode()), bool(hit) and 20 * len(hit) >= len(w))
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert by_id(decontamination.score(docs, bench), *columns) == expected
    clean = decontamination.decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {i for i, x in expected.items() if not x[4]}
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 100)
    assert by_id(decontamination.score(docs, bench), *columns) == expected


def test_suffix_trees_equal_brute_force(docs, texts):
    words = {i: SPACED.findall(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 12):
            first.setdefault(tuple(words[i][k : k + 13]), i)
    expected = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        expected[i] = (len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone).encode()))
    for limit in (suffix_tree.GROUP, 5):
        assert by_id(suffix_tree.deduplicate(docs, limit=limit), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    twice = suffix_tree.deduplicate(docs.union(docs))
    assert twice.count() == 2 * len(texts) and by_id(twice, "doc_id", "n_words", "n_removed", "kept_sha256") == expected


def test_prefix_groups_are_bounded_and_keep_prefixes_together():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 3, 500)
    starts = np.arange(480)
    groups = list(suffix_tree.prefix_groups(words, starts, 13, 40))
    assert sorted(np.concatenate(groups).tolist()) == list(range(480)) and max(map(len, groups)) <= 40
    where = {}
    for n, own in enumerate(groups):
        for s in own:
            assert where.setdefault(tuple(words[s : s + 13]), n) == n


def test_suffix_sort_equals_brute_force(docs, texts):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    count = Counter(b[k : k + 200] for b in raw.values() for k in range(len(b) - 199))
    expected = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 2, int)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k + 1 : k + 201] = 1
        kept = bytes(x for x, g in zip(b, gone[1:-1]) if not g)
        expected[i] = (len(b), int(gone.sum()), int((np.diff(gone) == 1).sum()), sha(kept))
    assert by_id(suffix_sort.deduplicate(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_deep_shallow_orders_suffixes():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 70).astype(np.uint8)
    text = np.concatenate([base if k % 2 else rng.integers(0, 4, 70).astype(np.uint8) for k in range(30)])
    starts = rng.permutation(len(text) - 48)[:900]
    order, same = suffix_sort.deep_shallow(text, starts, 48, 8)
    keys = [bytes(text[s : s + 48]) for s in starts[order]]
    assert keys == sorted(keys) and [bool(x) for x in same[1:]] == [a == b for a, b in zip(keys, keys[1:])]


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    found = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                found.append((m.start(), list(BASE).index(kind), m.end()))
    return sorted(found)


def test_base_identifiers_equal_the_patterns():
    rng = random.Random(8)
    parts = ["a@b.co", "x", "@", ".", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8.9", "..", "4111 1111-1111 1111", "+1 (555) 010-9999", "+", " ", "é", "12", "a.b+c@d-e.f.g", "@@", "-", "(", "4111111111111111", "0000001.2.3.4"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert pii.identifiers(text) == plain_spans(text), text
    assert pii.identifiers("a" * 200_000 + "1" * 100_000) == plain_spans("1" * 10) == []


@pytest.mark.parametrize(
    ("text", "kind", "found"),
    [
        ("mail bob (at) example [dot] com now", "email", "bob (at) example [dot] com"),
        ("é bob at example dot com", "email", "bob at example dot com"),
        ("bоb@exаmple.com", "email", "bоb@exаmple.com"),
        ("b​ob@exam​ple.org", "email", "b​ob@exam​ple.org"),
        ("４２.144.35.２５４ x", "ip", "４２.144.35.２５４"),
        ("call plus one five five five two three four five six seven eight", "phone", "plus one five five five two three four five six seven eight"),
    ],
)
def test_disguises(text, kind, found):
    base, every = pii.find(text)
    assert base == [] and [(pii.KINDS[k], text[a:b]) for a, k, b in every] == [(kind, found)]
    assert pii.mask(text, every) == text.replace(found, f"<{kind}>")


def test_plain_prose_has_no_identifiers():
    for text in ("look at this.That is it", "he was at the dot. One two", "one of two or three", None, ""):
        assert pii.find(text) == ([], [])


def test_summary_of_personal_data(spark, docs):
    frame = spark.createDataFrame([(1, "x a@b.co +1 555 010 9999 y bob at example dot com", 9), (2, None, 9), (2, None, 9)], "doc_id long, text string, spans int")
    rows = pii.summary(frame).orderBy("doc_id").collect()
    assert len(rows) == 3 and (rows[0].n_email, rows[0].n_phone, rows[0].spans) == (1, 1, "email:2:8,phone:9:24,email:27:49")
    assert rows[0].base_sha256 == sha(b"email:2:8,phone:9:24") and rows[1].spans == "" and rows[1].base_sha256 == sha(b"")
    assert pii.summary(docs).count() == docs.count()


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 2000)
    body = "ü" * 60
    html = {1: body, 2: body, 3: None, 4: "", 5: "short", 6: "short", 7: "z" * 300_000, 9: body, 8: "a\r\n\r\nWARC/1.1\r\n" * 20}
    pages = spark.createDataFrame([(i, None if i == 4 else f"http://x/{i}\n", h, 1) for i, h in html.items()], "page_id long, url string, html string, bundle int")
    rows = {r.page_id: r for r in warc.archive(pages).collect()}
    assert set(rows) == set(html)
    for i, h in html.items():
        data, again = (h or "").encode(), i in (2, 9)
        assert (rows[i].payload_bytes, rows[i].payload_digest) == (len(data), sha(data))
        assert (rows[i].record_type, rows[i].refers_to) == (("revisit", 1) if again else ("response", None))
        assert bytes(rows[i].payload) == (b"" if again else data)
    assert warc.archive(pages.where("false")).count() == 0


def test_mix(spark, docs, texts):
    rows = mixing.mix(docs).collect()
    assert rows and sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    sizes = {i: len(SPACED.findall(t or "")) for i, t in texts.items()}
    assert {r.doc_id: r.size for r in rows} == sizes
    assert all(r.taken % r.size == 0 and r.taken <= 3 * r.size if r.size else r.taken == 0 for r in rows)
    source = {i: None if i % 5 == 0 else f"s{i % 5}" for i in texts}
    held = Counter()
    for i, n in sizes.items():
        held[source[i]] += n
    order = sorted(held, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, free, rest = {}, set(order), float(sum(held.values()))
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= 3 * held[s]}
        target |= {s: 3 * held[s] for s in over} if over else share
        rest -= sum(3 * held[s] for s in over)
        free = free - over if over else set()
    for r in rows:
        assert r.source_size == held[source[r.doc_id]] and r.target == pytest.approx(target[source[r.doc_id]])
    assert sum(r.taken for r in rows) <= sum(sizes.values())


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((300, 32))
    near = base[:60] + 0.05 * rng.standard_normal((60, 32))
    x = np.concatenate([base, near, base[:5], base[5:8] * 7, np.repeat(base[9:10], 30, axis=0)])
    rows = [(i, [float(v) for v in e], i) for i, e in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 32, 0), (1002, [float("nan")] + [1.0] * 31, 0), (1003, [None] + [1.0] * 31, 0), (1004, [1.0, 2.0], 0), (1005, [], 0)]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n long")
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    part = components(range(len(x)), [(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j])
    expected = {i: (int(near[i].sum()), part[i], part[i] == i) for i in range(len(x))} | {i: (0, i, True) for i, *_ in odd}
    assert by_id(itq.link(frame), "vec_id", "n_links", "component_id", "kept") == expected
    assert itq.link(frame.where("false")).count() == 0


def test_vector_recall(spark):
    rng = np.random.default_rng(9)
    base = rng.standard_normal((500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal((500, 64))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate([base, base + noise * rng.uniform(0.05, 0.45, (500, 1))])
    frame = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = int((unit @ unit.T >= 0.9).sum()) - len(x)
    assert itq.link(frame).agg(F.sum("n_links")).first()[0] >= 0.9 * links


def test_toxicity_held_out(spark):
    rng = random.Random(12)
    rows, marks = [], []
    for i in range(900):
        bad = i % 5 == 0
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 90))]
        for _ in range(3 if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vile", f"grub{rng.randrange(999)}", "Scum!"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(bad)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (1002, "ä nasty grub7 thing")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (1000, 1), (5000, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = sum((got[i].score >= 0.5) == bool(t) for i, t in marks if i % 3 == 1)
    assert right >= 0.95 * len([1 for i, _ in marks if i % 3 == 1])
    assert got[1000].score < 0.5 and got[1001].score < 0.5 and got[1000].spans == []
    assert [(s.start, s.end) for s in got[1002].spans] == [(2, 13)]
    assert {r.doc_id for r in toxicity.keep_clean(docs, model).collect()} == {i for i, r in got.items() if r.score < 0.5}
    none = toxicity.train(docs, labels.where("false"))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_forward_backward_sums_over_all_paths():
    rng = np.random.default_rng(1)
    emission, transitions = rng.standard_normal((5, 3)), rng.standard_normal((2, 2))
    length = np.array([5, 3, 1])
    got, _, _ = toxicity._marginals(emission, length, transitions)
    for c, n in enumerate(length):
        weight = np.zeros(n)
        total = 0.0
        for path in range(2**n):
            state = [(path >> t) & 1 for t in range(n)]
            w = np.exp(sum(emission[t, c] * state[t] for t in range(n)) + sum(transitions[a, b] for a, b in zip(state, state[1:])))
            total += w
            weight += w * np.array(state)
        assert got[:n, c] == pytest.approx(weight / total) and (got[n:, c] == 0).all()


def test_languages_held_out(spark):
    rng = random.Random(3)
    alphabets = {"aa": "abcdef", "bb": "defghi", "cc": "éèàçmn"}
    rows = [(i, " ".join("".join(rng.choice(alphabets[k]) for _ in range(5)) for _ in range(20)), k) for i, k in enumerate(list(alphabets) * 100)]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (903, "abcabc fade", None)], "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id % 4 <> 2"))
    got = by_id(langid.predict(docs, model), "doc_id", "lang_pred", "score")
    assert all(got[i][0] == k for i, _, k in rows if i % 4 == 2)
    assert [got[i][0] for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert {r.lang_pred for r in langid.predict(docs, langid.train(docs.where("false"))).collect()} == {"und"}


def test_empty_tables(docs, spark):
    none = docs.where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    for frame in (jaccard.join(none), suffix_tree.deduplicate(none), suffix_sort.deduplicate(none), mixing.mix(none), pii.summary(none), decontamination.score(none, bench)):
        assert frame.count() == 0
    assert decontamination.decontaminate(docs, bench).count() == docs.count()


def test_null_ids(spark):
    frame = spark.createDataFrame([(None, "some words here " * 30), (1, "some words here " * 30), (None, None)], "doc_id long, text string")
    assert jaccard.keep_one(frame).count() == 3
    assert by_id(suffix_tree.deduplicate(frame), "doc_id", "n_removed")[1] == (0,)
    assert suffix_sort.deduplicate(frame).agg(F.sum("n_removed")).first()[0] == 2 * 480
    assert mixing.mix(frame.withColumn("source", F.lit(None).cast("string"))).count() == 3
    assert decontamination.score(frame, spark.createDataFrame([(1, "some words here")], "item_id long, text string")).count() == 3


def test_pipeline_stages(spark, docs, tmp_path):
    labels = [(i, int(i % 2)) for i in range(60, 80)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "alpha1 beta2 gamma3 " * 6)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    mail = spark.createDataFrame([(500, "write to bob at example dot com soon", "en", "s1", 36, "x", 1, 2, "y", 3, 4)], SCHEMA)
    frame = docs.union(mail).union(docs.where("doc_id > 90"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, str(tmp_path))
        assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in docs.schema], name
        assert stage(spark, frame.where("false"), str(tmp_path)).count() == 0, name
        if name == "pii":
            row = got.where("doc_id = 500").first()
            assert (row.text, row.n_chars, row.spans) == ("write to <email> soon", 21, "y") and got.count() == frame.count()
    mixed = corpus_pipeline.mix_sources(spark, frame, str(tmp_path))
    assert mixed.columns == [c for c in docs.columns if c != "size"] + ["size", "source_size", "target", "taken"]
    assert mixed.where("taken <= 0").isEmpty() and mixed.where("doc_id > 90").count() == mixed.where("doc_id > 90").select("doc_id").distinct().count()
