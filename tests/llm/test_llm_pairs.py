"""Near-duplicates and neighbours, against all pairs."""

import random
import re

import numpy as np
import pytest

from tidelog.llm import ann, minhash, vecdedup
from tidelog.llm.components import components


def smallest_reachable(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_components(spark):
    rnd = random.Random(2)
    n = 200
    links = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rnd.randrange(140, n), rnd.randrange(140, n)) for _ in range(30)] + [(5, 5), (7, 6), (6, 7)]
    got = {r["id"]: r["component_id"] for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    want = smallest_reachable(n, links)
    assert all(got.get(k, k) == want[k] for k in range(n)) and len(got) == len({x for a, b in links if a != b for x in (a, b)})
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\x1c", "\x1c")
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", words)
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)}


def near_texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefgh", k=4))
    base = [[word() for _ in range(rnd.choice([3, 8, 60, 200]))] for _ in range(25)]
    passage = [word() for _ in range(60)]
    texts = []
    for ws in base:
        for _ in range(rnd.choice([1, 2, 6])):
            own = list(ws)
            for _ in range(rnd.choice([0, 1, 2, 5])):
                own[rnd.randrange(len(own))] = word()
            texts.append(" ".join(own))
    texts += [" ".join(passage + [word() for _ in range(rnd.choice([5, 20, 60]))]) for _ in range(40)]
    return texts + [None, "", "  \n ", "one", "ONE", "one two", texts[0].upper(), texts[0], "é x " * 9]


@pytest.mark.parametrize("block", [512, 8])
def test_minhash_links_what_all_pairs_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = near_texts()
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = smallest_reachable(len(sets), links)
    docs = spark.createDataFrame([(k, t, "x", "y", 1.5) for k, t in enumerate(texts)], "doc_id long, text string, id string, sketch string, n double")
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs).collect()}
    assert [got[k]["n_shingles"] for k in range(len(sets))] == [len(s) for s in sets]
    assert [got[k]["component_id"] for k in range(len(sets))] == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("block", [16, 40])
def test_minhash_groups_that_quote_a_crowded_passage(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SHORT", 3)
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choices("abcdefgh", k=6))
    text = lambda n: [word() for _ in range(n)]
    passage = min((text(20) for _ in range(60)), key=lambda ws: minhash.shingles(" ".join(ws))[0])  # has the smallest value of its texts
    groups = [text(100) for _ in range(6)]
    texts = [passage + own[:k] + [word()] + own[k + 1 :] for own in groups for k in range(3, 99, 8)]
    texts += [passage + text(100) for _ in range(20)]
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()}
    assert [got[k] for k in range(len(texts))] == [k // 12 * 12 if k < 72 else k for k in range(len(texts))]


def test_minhash_small_sets_meet_larger_ones_in_a_list(spark):
    rnd = random.Random(3)
    text = lambda n: ["".join(rnd.choices("abcdefgh", k=6)) for _ in range(n)]
    shown = lambda ws: set(minhash.sketch(minhash.shingles(" ".join(ws))).tolist())
    while True:  # a text of 64 shingles, and longer ones that begin with it and whose sketches together show less than 3/4 of it
        own, tail = text(68), text(20)
        longer = [own + tail[:-1] + text(1) for _ in range(30)]
        if len(shown(own) & set().union(*map(shown, longer))) < 48:
            break
    docs = spark.createDataFrame([(k, " ".join(ws)) for k, ws in enumerate([own, *longer])], "doc_id long, text string")
    got = minhash.near_duplicates(docs).collect()
    assert sorted(r["n_shingles"] for r in got) == [64] + [84] * 30 and {r["component_id"] for r in got} == {0}


def test_minhash_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted(map(tuple, minhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True)], key=str)
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in minhash.deduplicated(docs).collect()) == ["1", "None"]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, vector string, dim int")


ODD = [(900, None, 1), (901, [0.0] * 8, 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] * 8, 1), (904, [float("inf")] + [0.0] * 7, 1), (905, [1.0] * 5, 1), (906, [], 1), (None, [1.0] * 8, 1)]


def some_vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    rows = []
    for k in range(260):
        v = base[rng.integers(40)] + rng.normal(size=8) * rng.choice([0, 0.02, 0.1, 0.5])
        rows.append((k, [float(np.float32(x)) for x in v], [0, 1, None][int(rng.choice(3, p=[0.6, 0.3, 0.1]))]))
    return rows


@pytest.mark.parametrize("block", [1024, 30])
def test_vector_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vecdedup, "BLOCK", block)
    rows = some_vectors()
    links = []
    for a, x, p in rows:
        for b, y, q in rows[:a]:
            if p is not None and p == q:
                u, v = np.array(x), np.array(y)
                if u @ v / np.sqrt((u @ u) * (v @ v)) >= vecdedup.COSINE:
                    links.append((a, b))
    want = smallest_reachable(len(rows), links)
    got = {r["vec_id"]: r for r in vecdedup.near_duplicates(vectors(spark, rows + ODD)).collect()}
    assert len(got) == len(rows) + len(ODD)
    for k in range(len(rows)):
        assert (got[k]["n_links"], got[k]["component_id"]) == (sum(k in x for x in links), want[k])
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in range(900, 907))
    assert vecdedup.near_duplicates(vectors(spark, rows).limit(0)).count() == 0


def test_a_needed_count_is_rarely_missed():
    need = vecdedup.needed_collisions()
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    r = vecdedup.directions(64)
    width = vecdedup.HALF_WINDOW * np.sqrt(2 - 2 * 0.98)
    assert ((np.abs(x @ r - y @ r) <= width).sum(1) >= need).all() and need > vecdedup.DIRECTIONS // 2


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 16)).astype(np.float32) * rng.choice([0.5, 1, 2], size=(600, 1)).astype(np.float32)
    x[100:130] = x[7]  # equal vectors
    rows = [(k, [float(c) for c in v], 0) for k, v in enumerate(x)]
    df = vectors(spark, rows + [(k, v, n) for k, v, n in ODD if v is None or len(v) != 5])
    got = ann.search(df, df.where("vec_id % 20 = 0")).collect()
    full = x.astype(np.float64)
    hit = total = 0
    for q in range(0, 600, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        score = full @ full[q]
        assert [r["rank"] for r in own] == list(range(1, 21)) and all(abs(r["score"] - score[r["vec_id"]]) < 1e-9 for r in own)
        best = sorted((-round(s, 9), k) for k, s in enumerate(score) if k != q)[:20]
        hit += len({k for _, k in best} & {r["vec_id"] for r in own})
        total += 20
    assert hit / total >= 0.9


def test_few_neighbours_are_all_found(spark):
    df = vectors(spark, [(k, [float(k + 1), 1.0, 0.5], 0) for k in range(5)])
    got = ann.search(df, df.where("vec_id = 0")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [4, 3, 2, 1]
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def thue_morse(n):
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word[:n]


@pytest.mark.parametrize("n", [64, 65, 1024, 2048, 4096])
def test_words_with_colliding_polynomials_are_told_apart(n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    assert not set(minhash.shingles(word)) & set(minhash.shingles(other))
    assert len(minhash.shingles(f"one two {word} three four {other}")) == 2


def test_shingle_sets_have_as_many_members_as_the_true_sets():
    rnd = random.Random(5)
    words = ["a", "A", "bb", "ünï", "日本", "x" * 70, "y" * 8, "z" * 9, "\x00", "."]
    texts = [rnd.choice([" ", "\n", " \t "]).join(rnd.choices(words, k=rnd.choice([0, 1, 4, 5, 6, 60]))) for _ in range(200)] + [None, "", " \n"]
    for text, found in zip(texts, minhash.shingle_sets(texts)):
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
        true = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        assert len(found) == len(true)
        assert (found == minhash.shingles(text)).all()


def test_minhash_two_texts_under_one_doc_id(spark):
    rnd = random.Random(8)
    make = lambda: [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    one, two, three = make(), make(), make()
    near = lambda ws: " ".join([*ws[:-2], "new"])
    rows = [(5, " ".join(one)), (5, " ".join(two)), (5, " ".join(two)), (7, near(one)), (9, near(two)), (3, " ".join(three)), (11, near(three)), (3, " ".join(make())), (20, " ".join(make()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(docs).collect())
    assert found == [(3, 3), (3, 3), (5, 5), (5, 5), (5, 5), (7, 5), (9, 5), (11, 3), (20, 20)]
    kept = [r["doc_id"] for r in minhash.deduplicated(docs).collect()]
    assert sorted(kept) == [3, 5, 20]


def test_minhash_links_hold_where_most_of_a_text_is_hot(spark, monkeypatch):
    """Texts that are four fifths a passage of more than BLOCK texts, so what differs stands in the values that are not crowded."""
    monkeypatch.setattr(minhash, "BLOCK", 64)
    rnd = random.Random(12)
    passage = [f"p{k}" for k in range(200)]
    texts = []
    for _ in range(90):
        own = [f"o{rnd.randrange(10**9)}" for _ in range(rnd.choice([20, 40, 120, 400]))]
        texts.append(" ".join([*passage, *own]))
    sets = [set(minhash.shingles(t).tolist()) for t in texts]
    want = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                low, high = sorted((want[i], want[j]))
                want = [low if w == high else w for w in want]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs).collect()} == dict(enumerate(want))
    assert len(set(want)) < len(want)


def test_vectors_in_cells_link_as_all_pairs_do(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(300, 16))
    x = np.concatenate([centres, *(c + 0.012 * rng.normal(size=(rng.integers(1, 6), 16)) * np.sqrt((c * c).sum()) / 4 for c in centres[:150])])
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    whole = sorted(map(tuple, vecdedup.near_duplicates(frame).collect()))
    assert sorted(map(tuple, vecdedup.near_duplicates(frame, whole=100, block=32).collect())) == whole
    assert sum(r[1] for r in whole) > 0


def test_collisions_count_windows():
    rng = np.random.default_rng(1)
    p, q = rng.normal(size=(300, 7)), rng.normal(size=(170, 7))
    assert (vecdedup.collisions(p, q, 0.3) == (np.abs(p[:, None, :] - q[None, :, :]) <= 0.3).sum(2)).all()


def test_the_share_of_candidates_falls_as_rows_grow():
    rng = np.random.default_rng(2)
    share = []
    for n in (2000, 16_000):
        x = rng.normal(size=(n, 16))
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        stored, asked = ann.unit(x, 1.0), ann.unit(x[:30], None)
        sizes = ann.hash_sizes(n, 16, 16)
        score = asked[:, :-1] @ x.T
        near = np.argsort(-score, 1)[:, 1:21]
        owner = np.repeat(np.arange(30), 20)
        need = np.sort(ann.needed_probes(asked, stored[near.ravel()], owner, sizes, 16, 1024))
        probes = int(need[int(np.ceil(0.95 * len(need))) - 1])
        seen = np.zeros((30, n), bool)
        for t in range(16):
            buckets, looked = ann.buckets(stored, t, sizes), ann.probes(asked, t, sizes, probes)
            for k in range(30):
                seen[k] |= np.isin(buckets, looked[k])
        assert np.take_along_axis(seen, near, 1).mean() >= 0.95
        share.append(seen.mean())
    assert share[1] < 0.8 * share[0]


@pytest.mark.parametrize("at_a_time", [7, 100, 10**6])
def test_full_sets_compare_alike_range_by_range(monkeypatch, at_a_time):
    monkeypatch.setattr(minhash, "AT_A_TIME", at_a_time)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 60, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(1, 60), replace=False), rng.integers(0, 2**64, rng.integers(0, 9), np.uint64)])) for _ in range(25)] + [np.unique(base), np.unique(base)[1:]]
    apart = rng.random((27, 27)) < 0.8
    want = [(i, j) for i in range(27) for j in range(i + 1, 27) if apart[i, j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))]
    assert sorted(map(tuple, minhash._linked(sets, apart).tolist())) == want and want
