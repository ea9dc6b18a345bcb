"""Spelling variants, hard negatives and byte-pair ids against brute force and the public library."""

from __future__ import annotations

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from yardline.llm import byte_bpe, hard_negatives, queries, spelling

# ---- spelling


def near(x: str, y: str) -> bool:
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) == 1
    return len(y) == len(x) + 1 and any(y[:i] + y[i + 1 :] == x for i in range(len(y)))


def brute_near(words):
    return {tuple(sorted(p)) for p in itertools.combinations(words, 2) if near(*p)}


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted({"".join(p) for k in (2, 3) for p in itertools.product("ab", repeat=k)})
    acceptor = spelling.Acceptor(words)
    used, open_ = set(), [0]
    while open_:
        p = open_.pop()
        if p not in used:
            used.add(p)
            open_ += acceptor.arcs[p].values()
    assert len(used) == 4  # one state per number of symbols read
    assert sorted(acceptor.common(0, 0)) == words


@pytest.mark.parametrize("seed", range(20))
def test_composition_gives_each_near_pair_once(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice([4, 5]))) for _ in range(60)})
    found = [tuple(sorted(p)) for p in spelling.Acceptor(words).one_edit_pairs()]
    assert len(found) == len(set(found)) and set(found) == brute_near(words)


@pytest.mark.parametrize("most", [2, 7, 20_000])
def test_near_pairs_of_any_partition_size(spark, most):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(260)} | {"a" * n for n in range(1, 30)}
    words |= {"prefix" * 20 + w for w in ("", "x", "xy", "yx")} | {"ÿ" * 9, "ÿ" * 8 + "À"}
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(sorted(words))], "word string, n long")
    number = {w: i + 1 for i, w in enumerate(sorted(words))}
    rows = spelling.near_pairs(frame, most).collect()
    found = [tuple(sorted((r["x"], r["y"]))) for r in rows]
    assert len(found) == len(set(found)) and set(found) == brute_near(words)
    assert all(r["x_n"] == number[r["x"]] and r["y_n"] == number[r["y"]] for r in rows)


def brute_variants(texts):
    counts = Counter()
    for name, text in texts:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for inside, run in itertools.groupby(lowered, lambda c: "a" <= c <= "z" or "À" <= c <= "ÿ"):
            if inside:
                run = "".join(run)
                h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
                if h % 31 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] += len(run) >= 7
    counts = {w: n for w, n in counts.items() if n >= 2}
    partners = {w: [] for w in counts}
    for x, y in brute_near(counts):
        partners[x].append(y)
        partners[y].append(x)
    form = {}
    for w, own in partners.items():
        best = min(own, key=lambda o: (-counts[o], o), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(partners[w]), counts.get(form[w]))
    return out


def test_variants_equal_brute_force(spark):
    rng = random.Random(8)
    chain = ["receave"] * 2 + ["receive"] * 25 + ["receives"] * 260 + ["Straßen"] * 3 + ["straßenn"] * 30 + ["Müllerei"] * 40 + ["MÜLLEREI"] * 4
    texts = [(None, None), (1, ""), (2, " 12 "), (3, "short words only"), (4, "naïveté×÷ naïveté×÷"), (5, "z" * 9000 + " " + "z" * 9000), (6, "z" * 9001), (6, "z" * 9001)]
    texts += [(None, " ".join(chain))] + [(7, "tietied tietied")] + [(8, "tietiec tietied xtietied xtietied")] * 2
    vocabulary = ["".join(rng.choice("abcd") for _ in range(rng.randrange(6, 9))) for _ in range(60)]
    texts += [(100 + i, " ".join(rng.choices(vocabulary, [1 + (k % 7) ** 3 for k in range(60)], k=120))) for i in range(120)]
    texts += [(9, texts[-1][1])] * 2
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in texts], "doc_id long, text string, n long, word string, m int")
    rows = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect()}
    assert rows == brute_variants(texts)
    assert rows["receave"][0] == "receive" and rows["receave"][1] == "receives"
    assert spelling.variants(frame.where("doc_id = 0")).collect() == []


def test_counts_of_many_texts(spark):
    text = " ".join(f"{a}{b}wordlike" for a in "abcdefgh" for b in "abcdefgh") * 2
    frame = spark.createDataFrame([(i, text) for i in range(9)], "doc_id long, text string")
    whole = sorted(map(tuple, spelling.vocabulary(frame).collect()))
    assert len(whole) >= 64 and sum(n for _, n in whole) > 500


# ---- hard negatives


def brute_mine(rows):
    own = set()
    for i, vector, label in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            own.add((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(math.floor(256 * x) for x in vector)))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for anchor in own:
        if anchor[0] is None or anchor[0] % 100:
            continue
        scored = [(sum(a * b for a, b in zip(anchor[2], r[2])), r[0], r[1]) for r in own if r != anchor and len(r[2]) == len(anchor[2])]
        for score, name, _ in sorted((x for x in scored if x[2] == anchor[1]), key=order)[:5]:
            fits = sorted((x for x in scored if x[2] != anchor[1] and 80 * score <= 100 * x[0] <= 100 * score), key=order)[:5]
            out += [(anchor[0], name, k + 1, x[1], score, x[0]) for k, x in enumerate(fits)]
    return sorted(out, key=str)


def test_tables_and_planes_give_exact_products():
    rng = np.random.default_rng(4)
    for dims in (1, 7, 8, 30):
        anchors, vectors = rng.integers(-300, 300, (5, dims)), rng.integers(-90, 4000, (70, dims))
        got = hard_negatives.scores(hard_negatives.subset_sums(anchors), anchors.sum(axis=1), *hard_negatives.bit_planes(vectors))
        assert (got == vectors @ anchors.T).all()
    same = np.full((3, 4), -5)
    assert (hard_negatives.scores(hard_negatives.subset_sums(same), same.sum(axis=1), *hard_negatives.bit_planes(same)) == 100).all()


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(6)
    point = lambda d: [rng.choice([-0.5, -0.25, 0.0, 0.125, 0.3, 0.5]) for _ in range(d)]
    rows = [(i, point(6), rng.randrange(3)) for i in range(0, 900, 2)] + [(i, point(11), rng.randrange(2)) for i in range(901, 1402)]
    rows += [(1500, point(3), 1), (1600, point(6), None), (1700, None, 2), (1800, [0.5, None, 0.1], 2), (1900, [0.5, float("nan")], 1), (2000, [float("inf")] * 6, 1)]
    rows += [(100, point(6), 1), rows[50], rows[50], (None, point(6), 0), (None, point(6), 1), (2100, [], 1), (2200, [], 1), (2203, [], 2), (-300, point(6), 2)]
    rows += [(2301 + i, [0.5, -0.5, 0.5, 0.25, 0.25, 0.5], i % 2) for i in range(40)]
    return rows


def test_hard_negatives_equal_brute_force(spark, vectors, monkeypatch):
    frame = spark.createDataFrame([(i, v, x, 1, 2, "c") for i, v, x in vectors], "vec_id long, embedding array<float>, label int, row int, dims int, i string")
    want = brute_mine([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], x) for i, v, x in vectors])
    assert len(want) > 100
    assert sorted(map(tuple, hard_negatives.mine(frame).collect()), key=str) == want
    monkeypatch.setattr(hard_negatives, "TABLE_BYTES", 256 * 6 * 4)
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(hard_negatives, "STRIP", 13)
    assert sorted(map(tuple, hard_negatives.mine(frame).collect()), key=str) == want
    assert hard_negatives.mine(frame.where("vec_id = -1")).collect() == []


def test_scores_past_64_bits_are_an_error(spark):
    frame = spark.createDataFrame([(100, [1e15], 1), (101, [1e15], 1), (102, [2.0], 2)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="64 bits"):
        hard_negatives.mine(frame).collect()


# ---- byte-level pairs


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.Tokenizer.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tokenizer):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.ranks, special_tokens={})


def samples():
    rng = random.Random(2)
    alphabet = " \n\t'srelvemd 1.é՘֋\U00011de0中 　\x1c²٣"
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 400))) for _ in range(60)]
    out += ["", " ", "a" * 700, " " * 300 + "x", "word " * 200, "it's we're they'll " * 60, "'re" * 200, "\n \n" * 100, "one two" + " " * 200 + "\n" + "three" * 90]
    return out + ["ab" * k + "  \n\tyes'd I'd" * (k % 7) for k in range(30)]


def test_merges_equal_the_library(tokenizer, library):
    encoder = tokenizer.ready()
    for text in samples():
        assert encoder.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("chunk,overlap", [(32, 16), (64, 64), (100, 40), (1 << 14, 1 << 10)])
def test_chunks_give_the_ids_of_whole_texts(spark, tokenizer, library, chunk, overlap):
    texts = [*samples(), None]
    rows = [(None if k % 9 == 0 else k % 40, t, "x", 1, "y") for k, t in enumerate(texts)] + [(5, texts[66], "x", 2, "y")] * 3
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string, i int, key string")
    encoded = byte_bpe.encode(frame, tokenizer, chunk=chunk, overlap=overlap)
    got = byte_bpe.decode(encoded, tokenizer).collect()
    want = [(i, library.encode_ordinary(t or "")) for i, t, *_ in rows]
    assert sorted(((r["doc_id"], list(r["ids"])) for r in got), key=str) == sorted(want, key=str)
    assert all(bytes(r["decoded"]).decode() == library.decode(r["ids"]) for r in got)
    assert byte_bpe.encode(frame.where("i = 7"), tokenizer).collect() == []


def test_neighbours_meet_at_boundaries_of_the_whole_text(tokenizer):
    encoder, chunk, overlap = tokenizer.ready(), 64, 32
    for text in samples():
        true = {0, *encoder.boundaries(text)}
        windows = [text[i : i + chunk + overlap] for i in range(0, max(1, len(text)), chunk)]
        ends = [byte_bpe.overlaps(w, encoder, chunk, overlap, i * chunk + chunk + overlap >= len(text)) for i, w in enumerate(windows)]
        for i in range(1, len(ends)):
            met = set(ends[i - 1][1]) & set(ends[i][0])
            if not met:
                break
            assert i * chunk + min(met) in true


def test_decoding_tells_null_and_unknown_ids(spark, tokenizer):
    frame = spark.createDataFrame([(1, None), (2, []), (3, [0, 1])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(frame, tokenizer).collect()}
    assert got[1] is None and bytes(got[2]) == b"" and len(got[3]) > 0
    with pytest.raises(Exception, match="no token has the id 99999999"):
        byte_bpe.decode(spark.createDataFrame([(1, [99_999_999])], frame.schema), tokenizer).collect()


def test_the_new_queries_are_registered():
    names = set(queries.queries())
    assert {"op11_spelling", "op12_hard_negatives", "op13_byte_bpe"} <= names
    assert "op12_hard_negatives" in queries.statements()
