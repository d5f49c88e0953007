"""The pipeline over empty tables, repeated rows, null ids and texts, columns of its own names and a very long text."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, block long, lang_pred string"


def ran(spark, folder, rows, labels):
    more = lambda r: (*r, True, 0.5, 1, "xx")
    spark.createDataFrame([more(r) for r in rows], DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_pipeline_of_nothing(spark, tmp_path):
    assert ran(spark, tmp_path, [], []) == []


def test_pipeline_edges(spark, tmp_path):
    rng = np.random.default_rng(6)
    words = ["the", "house", "stone", "river", "other", "thing", "north", "green", "wall", "field"]
    said = lambda n: " ".join(rng.choice(words, n))
    rows = [(k, said(50), "en", "s", 0) for k in range(40)]
    rows += [rows[3], rows[3], (None, said(40), None, None, None), (None, None, "en", "s", 0), (50, None, "en", "s", 0), (51, "", None, "s", 0), (52, "12 !!", "en", "s", 0)]
    rows += [(60, said(300_000), "en", "s", 0), (61, rows[5][1], "en", "t", 0)]
    got = ran(spark, tmp_path, rows, [(k, 1) for k in range(40)])
    by = {}
    for r in got:
        by.setdefault((r.doc_id, r.sequence_id), []).append(r)
    kept = {r.doc_id for r in got}
    assert set(range(40)) | {60, None} <= kept | {None} and not {50, 51, 52, 61} & kept
    pieces = sorted((r for r in got if r.doc_id == 60), key=lambda r: r.piece)
    assert len(pieces) > 100 and [r.start for r in pieces] == [sum(x.length for x in pieces[:k]) for k in range(len(pieces))]
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 2048
