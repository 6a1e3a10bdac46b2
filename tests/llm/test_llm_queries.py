"""The queries over whole tables, as they are registered, and the pipeline's stages: against plain rules over the same rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tidelog.llm import langid, minhash, packing, queries, secrets, tokens, toxicity, wavelet


@pytest.fixture(scope="module")
def docs(spark, small):
    return [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public_path())


def run(spark, small, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, small).collect()]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = want.columns
    rows = run(spark, small, name)
    assert sorted(rows[0]) == sorted(columns)
    key = lambda row: [str(round(x, 9) if isinstance(x, float) else x) for x in row]
    assert sorted(key([r[c] for c in columns]) for r in rows) == sorted(key(row) for row in want.fetchall())


def test_toxicity_query(spark):
    small = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id").collect()
    rows = {r["doc_id"]: r for r in run(spark, small, "op1_toxicity")}
    assert set(rows) == {d["doc_id"] for d in docs} and len(rows) == len(docs)
    for k, r in rows.items():
        assert r["held_out"] == (remainder(k, 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    truth = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{small}/labels.parquet").collect() if r["toxic"] is not None}
    held = [(truth[k], r["score"]) for k, r in rows.items() if r["held_out"] and k in truth]
    toxic, clean = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.8


def test_packing_query(spark, small, docs, plain):
    pieces = defaultdict(list)
    filled = Counter()
    for r in run(spark, small, "op3_packing"):
        pieces[r["doc_id"]].append(r)
        filled[r["sequence_id"]] += r["length"]
    assert len({d["doc_id"] for d in docs}) == len(docs) == len(pieces)
    for d in docs:
        ids, at = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[at : at + r["length"]]) and r["offset"] + r["length"] <= 1024
            at += r["length"]
        assert at == len(ids)
    assert sum(n < 1024 for n in filled.values()) <= 1


def test_token_output_query(spark, small, docs, plain):
    rows = {r["doc_id"]: r for r in run(spark, small, "op4_token_output")}
    at = 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = [*plain.encode(d["text"] or "", add_special_tokens=False).ids, 2]
        r = rows[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert len(rows) == len(docs)


def plain_targets(sizes):
    """Shares by weight, what is over three passes going round again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    out, total = {}, sum(sizes.values())
    while True:
        left = [s for s in names if s not in out]
        rest = total - sum(out.values())
        over = [s for s in left if rest * weight[s] / sum(weight[x] for x in left) > 3 * sizes[s]]
        if not over:
            return out | {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        out |= {s: 3.0 * sizes[s] for s in over}


def test_mixing_query(spark, small, docs):
    rows = run(spark, small, "op5_mixing")
    words = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in docs}
    source = {d["doc_id"]: d["source"] for d in docs}
    sizes, taken = Counter(), Counter()
    for k, n in words.items():
        sizes[source[k]] += n
    want = plain_targets(sizes)
    for r in rows:
        assert r["size"] == words[r["doc_id"]] and r["source_size"] == sizes[source[r["doc_id"]]] and 0 <= r["taken"] <= 3 * r["size"]
        assert math.isclose(r["target"], want[source[r["doc_id"]]], rel_tol=1e-9)
        taken[source[r["doc_id"]]] += r["taken"]
    assert len(rows) == len(docs)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, run(spark, small, "op5_mixing")))


def test_secret_query(spark, small, docs):
    rows = {r["doc_id"]: r for r in run(spark, small, "op7_secret_scan")}
    for d in docs:
        text, r = d["text"] or "", rows[d["doc_id"]]
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        base += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        base += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        kinds = Counter(k for k, _, _ in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        base.sort(key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in r["spans"].split(",") if x]
        assert [x for x in spans if x[0] != "guess"] == [(k, str(a), str(b)) for k, a, b in base]


def test_neighbour_query(spark, small):
    table = spark.read.parquet(f"{small}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in table]), np.array([r["embedding"] for r in table], np.float64)
    found = defaultdict(list)
    for r in run(spark, small, "op8_nearest_neighbours"):
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    asked = [k for k in ids.tolist() if k % 20 == 0]
    assert set(found) == set(asked)
    hit = 0
    for q in asked:
        score = x @ x[ids == q][0]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 21)) and [(-s, v) for _, v, s in got] == sorted((-s, v) for _, v, s in got)
        assert all(math.isclose(s, score[ids == v][0], rel_tol=1e-12) for _, v, s in got)
        hit += len({int(ids[k]) for k in order} & {v for _, v, _ in got})
    assert hit >= 0.9 * 20 * len(asked)


def test_language_query(spark, small, docs):
    rows = {r["doc_id"]: r for r in run(spark, small, "op10_language_id")}
    learned = {d["lang"] for d in docs if d["lang"] is not None and remainder(d["doc_id"], 4) != 2}
    right = []
    for d in docs:
        r = rows[d["doc_id"]]
        assert r["held_out"] == (remainder(d["doc_id"], 4) == 2) and 0 <= r["score"] <= 1
        if not d["text"] or not any(c.isalpha() for c in d["text"]):
            assert r["lang_pred"] == "und"
        else:
            assert r["lang_pred"] in learned
            if r["held_out"] and d["lang"] is not None:
                right.append(r["lang_pred"] == d["lang"])
    assert len(rows) == len(docs) and np.mean(right) > 0.9


def test_pipeline_is_its_stages_one_by_one(spark, small, plain):
    now = spark.read.parquet(f"{small}/documents.parquet")
    columns, kept = now.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, small).collect(), now.schema)
        assert now.columns == columns
        kept.append([r.asDict() for r in now.collect()])
    first = [r.asDict() for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    clean, single, masked, mixed = kept

    net = toxicity.train(spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet"))
    scores = {d["doc_id"]: net.score([d["text"]])[0] for d in first}
    sure = {k for k, s in scores.items() if abs(s - 0.7) > 1e-4}
    assert {d["doc_id"] for d in clean} & sure == {k for k in sure if scores[k] < 0.7}

    sets = {d["doc_id"]: set(minhash.shingles(d["text"]).tolist()) for d in clean}
    group = {k: k for k in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((group[a], group[b]))
                group = {k: low if g == high else g for k, g in group.items()}
    assert sorted(d["doc_id"] for d in single) == sorted(set(group.values()))

    texts = {d["doc_id"]: d["text"] for d in single}
    assert {d["doc_id"] for d in masked} == set(texts)
    for d in masked:
        text, out, at = texts[d["doc_id"]], [], 0
        for _, a, b, _ in secrets.find_secrets(text):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        assert d["text"] == (text if text is None else "".join([*out, text[at:]]))

    size = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    sizes, taken = Counter(), Counter()
    for d in masked:
        sizes[d["source"]] += size(d["text"])
    for d in mixed:
        taken[d["source"]] += size(d["text"])
    want = plain_targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)

    def digest(rows):
        return sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows if r["start"] == 0 and r["length"] == r["doc_tokens"])

    packed = corpus_pipeline.STAGES[-1][1](spark, now, small).collect()
    ids = sum(len(plain.encode(d["text"] or "", add_special_tokens=False).ids) + 1 for d in mixed)
    assert sum(r["length"] for r in packed) == ids
    whole = corpus_pipeline.run(spark, small).collect()
    assert sum(r["length"] for r in whole) == ids and Counter(r["doc_id"] for r in whole if r["start"] == 0) == Counter(d["doc_id"] for d in mixed)
    assert digest(whole) and all(r["offset"] + r["length"] <= 1024 for r in whole)


def test_large_doc_ids_beside_null_ones_keep_their_digits(spark):
    big = [(1 << 60) + 1, (1 << 60) + 3, -(1 << 58) - 7]
    table = spark.createDataFrame([(k, f"text number {n} under the mit license") for n, k in enumerate(big)] + [(None, "no name"), (None, None)], "doc_id long, text string").coalesce(1)
    want = sorted([*big, None, None], key=str)
    ids = lambda frame: sorted((r["doc_id"] for r in frame.select("doc_id").collect()), key=str)
    assert ids(toxicity.score(table, toxicity.fit([], []))) == want
    assert ids(packing.pack(table, tokens.public_path())) == want
    assert ids(wavelet.read_shards(wavelet.write_shards(table, tokens.public_path(), 2))) == want
    assert ids(minhash.near_duplicates(table)) == want
    assert ids(secrets.scan(table)) == want
    assert ids(langid.identify(table, langid.fit([], []))) == want
