"""Each operator against a brute-force version, with nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from plenum.llm import chat, covertree, langid, lm, neardup, neighbours, packing, pieces, quality, suffixes  # noqa: E402
from plenum.llm.components import components  # noqa: E402

COLUMNS = "doc_id long, text string, block long, key string, bucket int"  # the last three clash with inner names
LONG = " ".join(f"word{k % 97} of{k % 31}" for k in range(3000))
SHARED = "this passage of some length stands in more than one of the documents here, word by word. "
TEXTS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, None), (3, ""), (4, SHARED + "first"), (5, "Ünïcode — " + SHARED), (6, LONG), (7, LONG + " tail"), (8, SHARED + "first"), (9, "a"), (10, "x  y\n\n z \t"), (11, "12345 !!"), (12, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 0, "k", 1) for i, t in TEXTS], COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, size=64, with_ids=True).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(by.setdefault(r.doc_id, [])) and r.length == len(r.ids) <= 64
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.doc_id] += r.ids
    assert by == {i: own.encode(t or "", add_special_tokens=False).ids + [0] for i, t in TEXTS}
    ends = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 64 and len(ends) <= 1.1 * sum(ends.values()) / 64 + 1
    assert packing.pack(empty, path).count() == 0


def test_plan_uses_exact_complements():
    n = np.zeros(101, np.int64)
    n[[60, 25, 10, 5, 40, 100]] = [3, 2, 2, 2, 1, 4]
    got = Counter({tuple(sorted(k)): m for k, m in packing.plan(n, 100)})
    assert got[(100,)] == 4 and got[(40, 60)] == 1 and got[(5, 10, 25, 60)] == 2


def brute_suffixes(rows, span):
    first = {}
    for d, t in rows:
        for i in range(len(t) - span + 1):
            w = t[i : i + span]
            first[w] = min(first.get(w, d), d)
    out = {}
    for d, t in rows:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - span + 1):
            if first[t[i : i + span]] < d:
                gone[i : i + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out[d] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def test_suffixes(docs, empty):
    rows = suffixes.remove_later_copies(docs, block_mb=0.01).collect()
    want = brute_suffixes([(i, (t or "").encode()) for i, t in TEXTS], 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert want[8][1] > 0 and want[12][1] == len(LONG)
    assert suffixes.remove_later_copies(empty).count() == 0


def test_suffixes_of_one_phrase_in_many_contexts(spark, docs):
    """One anchor's bucket goes to several tasks, with the same result."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), 30))
    some = [word() for _ in range(9)]
    phrase = "a phrase that many documents hold in their own contexts"[:34]
    rows = [(k, f"{rng.choice(some) if k % 3 else word()} {phrase} {rng.choice(some) if k % 2 else word()}") for k in range(400)] + [(k + 1000, t) for k, t in TEXTS]
    got = suffixes.remove_later_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), block_mb=0.004, bucket_mb=0.002).collect()
    want = brute_suffixes([(i, (t or "").encode()) for i, t in rows], 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
    assert sum(v[1] > 0 for v in want.values()) > 100


def test_smaller_values():
    v = np.random.default_rng(0).integers(0, 9, 400)
    before, after = suffixes.smaller(v)
    for i in range(len(v)):
        assert before[i] == max((j for j in range(i) if v[j] < v[i]), default=-1)
        assert after[i] == min((j for j in range(i + 1, len(v)) if v[j] < v[i]), default=len(v))


def test_neardup(spark, empty):
    rng = np.random.default_rng(2)
    base = [f"w{k}" for k in rng.integers(0, 5000, 200)]
    rows = [(k, " ".join(rng.permutation(base))) for k in range(5)]
    near = list(base)
    near[100] = "other"
    rows += [(10, " ".join(base)), (11, " ".join(near)), (12, "  ".join(base).upper()), (13, None), (14, " "), (15, "a b"), (16, "a b"), (16, "a b")]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: Counter(neardup_shingles(t)) for i, t in rows}
    df = Counter(s for c in (Counter(neardup_shingles(t)) for _, t in rows) for s in c)
    weight = lambda c: {s: k * (1 + math.log(len(rows) / df[s]) / math.log(len(rows))) for s, k in c.items()}
    want = {i: i for i in sets}
    for a in sets:
        for b in sets:
            x, y = weight(sets[a]), weight(sets[b])
            both = sum(min(v, y[s]) for s, v in x.items() if s in y)
            if x and b < want[a] and both >= 0.8 * (sum(x.values()) + sum(y.values()) - both):
                want[a] = b
    assert got == want and got[12] == got[11] == 10 and got[16] == 15
    assert neardup.near_duplicates(empty).count() == 0


def test_rarest_shingles_meet():
    """Documents that reach the threshold share a listed shingle from which on enough is left of both."""
    rng = np.random.default_rng(8)
    df = rng.integers(1, 40, 60).astype(np.uint64)
    reached = 0
    for _ in range(3000):
        own = rng.random(60) < 0.5
        changed = rng.random(60) < rng.choice([0.02, 0.05, 0.1, 0.2])
        docs = [np.flatnonzero(x).astype(np.uint64) for x in (own, own ^ changed)]
        if not all(len(k) for k in docs):
            continue
        tf = [rng.integers(1, 3, 60) for _ in docs] if rng.random() < 0.3 else [np.ones(60, int)] * 2
        w = [neardup.weights(t[k], df[k], 40) for k, t in zip(docs, tf)]
        a, b = (dict(zip(k.tolist(), x.astype(float))) for k, x in zip(docs, w))
        both = sum(min(x, b[k]) for k, x in a.items() if k in b)
        whole = sum(a.values()) + sum(b.values())
        if both >= 0.8 * (whole - both):
            reached += 1
            x, y = (dict(zip(*(v.tolist() for v in neardup.rarest(k, u, df[k], 0.8)))) for k, u in zip(docs, w))
            assert any(min(x[k], y[k]) >= whole * 0.8 / 1.8 - 1e-3 for k in x.keys() & y.keys())
    assert reached > 100


def neardup_shingles(t):
    w = (t or "").lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (20, 20), (5, 6), (6, 5), (3, 1)] + [(k, k + 1) for k in range(100, 160)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 5: 5, 6: 5} | {k: 100 for k in range(100, 161)}


def test_lm(docs, empty):
    rows = lm.scores(docs, vocabulary=64).collect()
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t in TEXTS}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in TEXTS}
    c = Counter(w for i, ws in tokens.items() if not out[i] for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(rows) == len(TEXTS)
    for r in rows:
        ws = tokens[r.doc_id]
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out[r.doc_id], len(ws), sum(c[w] > 0 for w in ws), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
    assert lm.scores(empty).count() == 0


def test_lm_learns_from_every_training_document(spark):
    """With the query's own parameters, on documents that a sample of one in 16 by id hash leaves out."""
    import xxhash

    ids = [i for i in range(200) if xxhash.xxh3_64_intdigest(str(i)) % 16 and zlib.crc32(str(i).encode()) % 10][:40]
    docs = spark.createDataFrame([(i, "the one word follows the other " * 60) for i in ids], "doc_id long, text string")
    trained, begun = ({r.doc_id: r.score for r in lm.scores(docs, **given).collect()} for given in ({}, {"rounds": 0}))
    assert len(trained) == 40 and all(trained[i] > begun[i] + 1 for i in ids)


def test_lm_is_a_distribution():
    m = lm.Model(np.arange(70, 1, -1.0), 50.0)
    h = np.random.default_rng(0).normal(0, 1, (1, lm.H)).astype(np.float32)
    p = np.exp(m.log_probs(np.repeat(h, m.n + 1, 0), np.arange(m.n + 1)))
    assert abs(p.sum() - 1) < 1e-3


def test_pieces(docs, empty):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = {r.doc_id: r for r in pieces.encoded(docs, path, with_ids=True).collect()}
    assert {i: r.ids for i, r in rows.items()} == {i: own.encode(t or "") for i, t in TEXTS}
    assert all(r.round_trip for r in rows.values()) and pieces.encoded(empty, path).count() == 0
    model = pieces.PieceModel(path)
    for t in ("  ", "▁a ▁", "<s>é中😀", "\t\n a"):
        ids = model.encode([t])[0]
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(t) and model.decode(ids) == own.decode(own.encode(t))


def test_quality(spark, docs, empty):
    rng = np.random.default_rng(1)
    good = [(k, " ".join(rng.choice(["the", "quick", "brown", "house", "of", "green"], 80))) for k in range(100)]
    bad = [(100 + k, "$$$ ".join(rng.choice(["%%", "the", "###", "of"], 80))) for k in range(100)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 100)) for k in range(0, 200, 2)] + [(1, None), (999, 1)], "doc_id long, quality int")
    model = quality.learn(rows, labels)
    got = {r.doc_id: r.score for r in quality.score(rows, model).collect()}
    assert np.mean([(got[k] >= 0.5) == (k < 100) for k in range(200)]) > 0.97
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect())
    assert quality.score(empty, model).count() == 0
    assert quality.score(docs, quality.learn(empty, labels)).count() == len(TEXTS)


def test_quality_covers_the_whole_text():
    model = {"filters": np.zeros((quality.WIDTH, 256, quality.FILTERS), np.float32), "w": np.ones(quality.FILTERS, np.float32), "b": np.zeros(1, np.float32)}
    model["filters"][0, ord("z")] = 1
    p = quality.probabilities(pa_texts(["a" * 1000, "a" * 999 + "z", "", "z"]), model)
    assert p[1] > p[0] == p[2] and p[3] > p[1]


def pa_texts(rows):
    import pyarrow as pa

    return pa.array(rows)


def test_langid(spark, docs, empty):
    rng = np.random.default_rng(0)
    en, de = ["the", "house", "with", "thing", "other", "north"], ["der", "schön", "über", "straße", "nicht", "zeit"]
    rows = [(k, " ".join(rng.choice(w, 30)), lang) for k, (w, lang) in enumerate([(en, "en"), (de, "de")] * 40)] + [(900, "words", None), (901, None, "en")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the other house"), (2, "der nicht über"), (3, "12 !?"), (4, None), (5, ""), (6, " ".join(en * 9 + de * 5))], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert [got[k].lang_pred for k in range(1, 7)] == ["en", "de", "und", "und", "und", "en"]
    assert 0.5 < got[6].score < 0.8 and got[1].score > 0.9
    assert langid.identify(empty, model).count() == 0 and {r.lang_pred for r in langid.identify(docs, langid.learn(empty.selectExpr("*", "'x' AS lang"))).collect()} == {"und"}


def test_chat(spark):
    rows = [(1, 0, "system", "be < kind \\ \"x\""), (1, 1, "user", None), (1, 2, "assistant", "</turn>\n<turn role=\"user\">\n"), (1, 3, None, "q"), (1, 4, "assistant", LONG), (1, 5, "assistant", ""), (1, 5, "assistant", ""), (None, 0, "assistant", "z")] + [(2, k, "assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.windows(turns, P.path("byte_bpe_50k.json"), budget=256)
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in (1, 2, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        loss = "".join(t for r, t in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    two = sorted((r for r in made.collect() if r.conv_id == 2), key=lambda r: r.window)
    assert len(two) > 3 and all(r.n_tokens <= 256 for r in two) and all("repeated" in r.text for r in two[1:])
    assert chat.read_back(chat.windows(turns.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, id long, m long"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (400, 16))
    x[200:300] = x[:100] + rng.normal(0, 0.05, (100, 16))
    x[300:340] = x[0]
    rows = [(k, v.tolist(), int(k % 3), 0, 0) for k, v in enumerate(x)]
    return rows + [(1000, None, 1, 0, 0), (1050, [0.0] * 16, 1, 0, 0), (1100, [float("nan")] * 16, 1, 0, 0), (1150, [None] * 16, 1, 0, 0), (1200, x[0].tolist(), None, 0, 0)]


def test_covertree(spark, vectors):
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in covertree.near_duplicates(spark.createDataFrame(vectors, VECTORS), node=40).collect()}
    x = np.array([v[1] for v in vectors[:400]], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.98) & (np.arange(400)[:, None] % 3 == np.arange(400) % 3) & ~np.eye(400, dtype=bool)
    part = np.arange(400)
    for _ in range(400):
        new = np.minimum(part, np.where(linked, part[None], 400).min(1))
        if (new == part).all():
            break
        part = new
    want = {k: (int(linked[k].sum()), int(part[k]), bool(part[k] == k)) for k in range(400)} | {k: (0, k, True) for k in (1000, 1050, 1100, 1150, 1200)}
    assert got == want
    assert covertree.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_covertree_settles_in_slices(spark, vectors):
    import tracemalloc

    rng = np.random.default_rng(4)
    x, c = rng.normal(0, 1, (20_000, 8)), rng.normal(0, 1, (3000, 8))
    tracemalloc.start()
    home, far = covertree.nearest(x, c)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    d = covertree.distances(x[:3000], c)
    assert peak < 200e6 and (home[:3000] == d.argmin(1)).all() and np.allclose(far[:3000], d.min(1))
    rows = spark.createDataFrame(vectors, VECTORS)
    one, two, three = (sorted(covertree.near_duplicates(rows, node=n, most=k, fan=f).collect()) for k, f, n in ((1, 64, 40), (16384, 64, 40), (100, 3, 6)))
    assert len(one) == len(vectors) and one == two == three


def test_neighbours(spark, vectors):
    rows = neighbours.search(spark.createDataFrame(vectors, VECTORS), "vec_id % 50 = 0").collect()
    x = np.array([v[1] for v in vectors[:400]] + [vectors[-1][1]], np.float32).astype(float)
    ids = np.array([*range(400), 1200])
    s = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None])
    hits = 0
    for q in (0, 50, 100, 150, 200, 250, 300, 350, 1200):
        k = int(np.flatnonzero(ids == q)[0])
        order = [j for j in np.lexsort((ids, -np.round(s[k], 12))) if j != k][:5]
        own = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[k, np.flatnonzero(ids == r.vec_id)[0]]) < 1e-12 for r in own)
        hits += len({r.vec_id for r in own} & set(ids[order].tolist()))
    assert hits >= 0.9 * 45 and len(rows) == 45
    assert neighbours.search(spark.createDataFrame([], VECTORS), "vec_id % 50 = 0").count() == 0


def test_neighbours_of_near_copies(spark):
    """Copies that differ by less than a byte a component, many more than one group holds."""
    rng = np.random.default_rng(11)
    x = (rng.normal(0, 1, 32) + rng.normal(0, 0.002, (3000, 32))).astype(np.float32)
    rows = neighbours.search(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>"), "vec_id % 50 = 0").collect()
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    asked, got = np.arange(0, 3000, 50), {(r.query_id, r.vec_id) for r in rows}
    s = x[asked] @ x.T
    s[np.arange(len(asked)), asked] = -2
    near = np.argsort(-s, 1)[:, :5]
    recall = np.mean([(int(q), int(j)) in got for q, own in zip(asked, near) for j in own])
    print("recall", recall)
    assert len(got) == 300 and recall >= 0.9


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    words = ["the", "house", "stone", "river", "other", "thing", "north", "green"]
    rows = [(k, " ".join(rng.choice(words, 60)), "en", "s", 0) for k in range(60)] + [(70, "!!!", None, "s", 0), (71, None, None, "s", 0)]
    rows += [(80, rows[0][1], "en", "s", 0), (81, rows[1][1] + " more", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == set(range(60))
