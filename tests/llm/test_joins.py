"""Licence scans, hard negatives and the prefix trie against plain versions, with nulls, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from plenum.llm import hardneg, licenses, trie  # noqa: E402

# --- licence scans

GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."
LICENSED = [
    (1, None),
    (2, ""),
    (3, "Licensed under CC BY-NC 4.0.\nAll rights reserved. CC BY, cc-by; all Rights\treserved"),
    (4, "x " * 4000 + GRANT.replace("hereby", "gladly") + " y" * 4000),
    (4, "the GNU General  Public\nLicense"),
    (None, "Released under the MIT License."),
    (6, "Released under the BSD License."),
    (7, GRANT.replace("hereby", "a").replace("charge", "b").replace("person", "c").replace("copy", "d").replace("software", "e").replace("Software", "e").replace("files", "g")),
    (8, "Ünlicensed under Kelvin the Apache\u0000License, version 2.0 ÀÉ"),
    (9, "licensed under the apache license version 2 1"),
    (9, "licensed under the apache license version 2 1"),
    (10, "all rights reservedé all rights reserved"),
]


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = {(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
    base = {label for _, label in at}
    labels, share = set(base), 0.0
    for label, t in licenses.TEMPLATES:
        s, step = set(t.split()), licenses.step_of(t)
        for k in range(0, max(len(words), 1), step):
            shared = len(s & set(words[k : k + 2 * step]))
            if shared >= licenses.needed(len(s), 0.8, 10):
                labels.add(label)
                share = max(share, shared / len(s))
    where = [i for i, _ in at]
    return len(words), len(at), min(where, default=None), max(where, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), 1.0 if at else share


def test_license_scan(spark):
    docs = spark.createDataFrame([(i, t, "w", 7, "b") for i, t in LICENSED], "doc_id long, text string, words string, row int, block string").repartition(3)
    rows = [tuple(r) for r in licenses.scan(docs).collect()]
    key = lambda r: (r[0] is None, r[0], r[1:3], r[5])
    want = [(i, *plain_scan(t)) for i, t in LICENSED]
    assert sorted(rows, key=key) == sorted(want, key=key)
    by = {r[0]: r[6] for r in rows}
    assert by[3] == "cc-by,cc-by-nc,reserved" and by[None] == "mit" and by[6] == "" and by[7] == "" and by[9] == ""
    assert {r[6] for r in rows if r[0] == 4} == {"mit", "gpl"}
    assert licenses.scan(docs.limit(0)).count() == 0


def test_license_templates_are_a_parameter(spark):
    """Longer prefixes, thresholds under 1 and words with other letters, against all blocks and templates."""
    rng = np.random.default_rng(5)
    known = [f"w{k}" for k in range(40)] + ["été", "àé"]
    texts = [" ".join(rng.choice(known, n)) for n in (3, 20, 40, 200, 600)] * 3
    templates = [(f"t{k}", " ".join(rng.choice(known, n, replace=False))) for k, n in enumerate((5, 8, 12, 16, 20, 30))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    for least in (0.5, 0.7):
        got = {r.doc_id: r.labels for r in licenses.scan(docs, templates, least, short=6).collect()}
        for i, text in enumerate(texts):
            words, own = text.split(), set()
            for label, t in templates:
                s, step = set(t.split()), licenses.step_of(t)
                if any(len(s & set(words[k : k + 2 * step])) >= licenses.needed(len(s), least, 6) for k in range(0, len(words), step)):
                    own.add(label)
            assert got[i] == ",".join(sorted(own))
        assert len(set(got.values())) > 2


# --- hard negatives


def plain_mine(rows, positives=5, negatives=10, low=30, high=90):
    fine = {}
    for i, label, v in sorted((r for r in rows if None not in r), key=lambda r: r[:2]):
        if all(x is not None and np.isfinite(x) for x in v):
            fine.setdefault(i, (label, [int(np.floor(256 * float(x))) for x in v]))
    out = set()
    for a in (i for i in fine if i % 100 == 0):
        scored = [(-sum(x * y for x, y in zip(fine[a][1], q)), i, label) for i, (label, q) in fine.items() if i != a and len(q) == len(fine[a][1])]
        for s, p, _ in sorted(x for x in scored if x[2] == fine[a][0])[:positives]:
            own = sorted(x for x in scored if x[2] != fine[a][0] and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out |= {(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(own)}
    return out


def mined(spark, rows, **more):
    ddl = "vec_id long, label int, embedding array<float>, q string, a int, part string"
    frame = spark.createDataFrame([(*r, "q", 3, "x") for r in rows], ddl).repartition(3)
    return [tuple(r) for r in hardneg.mine(frame, "vec_id % 100 = 0", **more).collect()]


def test_hard_negatives(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (6, 8))
    x = (centres[rng.integers(0, 6, 900)] + rng.normal(0, 0.3, (900, 8))).astype(np.float32)
    x[100:140] = x[0]  # copies: ties of score
    rows = [(i, int(rng.integers(0, 4)), v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, 1, None), (1001, None, x[1].tolist()), (None, 1, x[2].tolist()), (1100, 2, [float("nan")] * 8), (1200, 2, [None] * 8), (1300, 2, [0.0] * 8), (1301, 2, [0.0] * 8)]
    rows += [(1400, 3, [1.0, 2.0]), (1401, 3, [1.0, 1.5]), (1402, 0, [0.5, 0.5]), (1500, 0, []), (1501, 0, [])]
    rows += [(200, *rows[200][1:])]  # a row once more
    for more in ({}, {"directions": 1, "rows_a_group": 64, "anchors_a_group": 3}, {"positives": 40, "negatives": 3, "low": 0, "high": 100}):
        got = mined(spark, rows, **more)
        assert len(got) == len(set(got))
        want = plain_mine(rows, **{k: v for k, v in more.items() if k in ("positives", "negatives", "low", "high")})
        assert set(got) == want and len(want) > 100
    assert mined(spark, []) == []


def test_hard_negatives_of_large_numbers(spark):
    """Beyond 53 bits scores are added up as integers; vectors whose own score leaves 62 bits take no part."""
    rng = np.random.default_rng(3)
    rows = [(i, i % 2, (rng.random(4) * 2.0**21 + 2.0**20).astype(np.float32).tolist()) for i in range(120)]
    assert set(mined(spark, rows, low=0, high=200)) == plain_mine(rows, low=0, high=200) != set()
    assert set(mined(spark, rows + [(300, 0, [3e30] * 4)], low=0, high=200)) == plain_mine(rows, low=0, high=200)


def test_bounds_hold(spark):
    rng = np.random.default_rng(4)
    q = np.floor(256 * rng.normal(0, 1, (300, 6)) * rng.choice([0, 1, 30], (300, 1)))
    at = hardneg.directions_of(q[(q != 0).any(1)], 5)
    block = {"ids": np.arange(300).tobytes(), "labels": np.zeros(300, "<i8").tobytes(), "q": q.astype("<i4").tobytes(), "angles": hardneg.angles_to(q, at).tobytes(), "dim": 6}
    side = hardneg.Side([block], 6)
    side.windows()
    low, high = hardneg.bounds(side.angles, side.length, side)
    exact = side.q @ side.q.T
    for w, (a, b) in enumerate(zip(side.begin, side.end)):
        assert (low[:, w] <= exact[:, a:b].min(1)).all() and (exact[:, a:b].max(1) <= high[:, w]).all()


# --- prefix trie


def plain_trie(rows, base=lambda c: c - c % 20, head=lambda c: zlib.crc32(str(c).encode()) % 4):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    made = {c: tuple(own.get(base(c), [])[: head(c)] + t[head(c) :]) for c, t in own.items()}
    nodes = {}
    for c, t in made.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], set()).add(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        kids = {p[: len(path) + 1] for p in below if len(p) > len(path)}
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)]
        saved = sum((len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(made[c]) == len(path))))
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = [(c, t, ("user", "assistant")[t % 2], f"turn {t}  of\tkind {c % 3 if t > 2 else 0}  é") for c in range(45) for t in range(c % 9)]
TURNS += [(40, None, None, "a null turn"), (41, 0, "user", None), (41, 0, "user", None), (41, 0, "user", "b"), (41, 0, "system", "c"), (None, 1, "user", "nobody's"), (-7, 1, "user", "x"), (0, 1, "user", "first"), (60, 0, "user", ""), (700, 1, "user", "no base")]
TURNS += [(100 + k, t, "user", f"long {t if t < 650 else t + k}") for k in range(2) for t in range(700)]  # two levels of carrying


def trie_of(spark, rows, **more):
    frame = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth string, key1 int, n int").repartition(3)
    return [tuple(r) for r in trie.prefix_trie(frame, **more).collect()]


def test_prefix_trie(spark, monkeypatch):
    contract = {"base": "conv_id - conv_id % 20", "head": "crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % 4"}
    rows = [r for r in TURNS if r[0] is None or r[0] >= 0]
    small = [r for r in rows if r[0] is None or r[0] < 100 or r[0] == 700]
    got = trie_of(spark, small, **contract)
    assert len(got) == len(set(got)) and set(got) == plain_trie(small)
    got = trie_of(spark, TURNS, size=2)
    assert set(got) == plain_trie(TURNS, lambda c: c, lambda c: 0) and len(got) == len(set(got))
    assert trie_of(spark, []) == []
    alone = trie_of(spark, [(1, 0, "user", "a")], base="conv_id - 1", head="1")
    assert alone == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
