"""SentencePiece models by the tokenizers library: encoding, decoding, parity.

The model's protobuf gives pieces, scores, normaliser and byte fallback. Unigram models keep
their scores; models of merged pairs get their merges back from the order of the scores.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plenum.llm.common import blocks_of, texts
from plenum.llm.wordcache import ChunkEncoder

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class PieceModel:
    """threads: whether the library encodes a batch by many threads (in a Spark task: no)."""

    def __init__(self, path: str, threads: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = str(threads).lower()
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Regex, Tokenizer, models, normalizers

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        ids = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)
        spec = proto.normalizer_spec
        self.prefix, fallback = spec.add_dummy_prefix, proto.trainer_spec.byte_fallback
        if proto.trainer_spec.model_type == 1:
            lowest = min(s for _, s, _ in self.pieces)
            model = models.Unigram([(p, s if kind in (NORMAL, 4) else lowest - 10) for p, s, kind in self.pieces], self.unknown, fallback)
        else:
            normal = {p for p, _, kind in self.pieces if kind not in (UNKNOWN, CONTROL, BYTE)}
            merges = [(-s, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for p, s, _ in self.pieces if p in normal for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
            model = models.BPE(ids, [m[3:] for m in sorted(merges)], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=fallback)
        self.tokenizer = Tokenizer(model)
        self.scores = np.array([s for _, s, _ in self.pieces]) if proto.trainer_spec.model_type == 1 else None
        steps = []
        if spec.precompiled_charsmap:
            steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
        if spec.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normalise = normalizers.Sequence(steps).normalize_str if steps else (lambda t: t)
        # no piece holds the marker behind another character: chunks that begin with it are independent
        self.parted = proto.trainer_spec.model_type != 1 and not any(SPACE in p.lstrip(SPACE) for p, _, kind in self.pieces if kind == NORMAL)
        letters = {c for p, _, kind in self.pieces if kind == NORMAL for c in p if len(p) == 1}
        split = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        self.chunks = ChunkEncoder(self.batch, np.array([len(p) if kind == NORMAL else 0 for p, _, kind in self.pieces]), split, lambda c: c[0] == SPACE and c[-1] != SPACE and letters.issuperset(c))
        self.bytes = [bytes([int(p[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, kind in self.pieces]

    def batch(self, rows: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False)]

    def encode(self, rows: list[str]) -> list[bytes]:
        """ids of each text, unsigned little-endian 32 bit."""
        marked = [self.normalise(t) for t in rows]
        marked = [((SPACE if self.prefix else "") + t).replace(" ", SPACE) if t else "" for t in marked]
        if self.parted:
            return self.chunks.encode_all(marked)
        return [np.array(x, "<u4").tobytes() for x in self.batch(marked)]

    def agrees(self, got: list[int], want: list[int]) -> bool:
        """The same ids; or, by unigram scores, another split of just the same score, which libraries may take."""
        return got == want or (self.scores is not None and len(got) == len(want) and abs(self.scores[got].sum() - self.scores[want].sum()) < 1e-4)

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_ids", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])


def encoded(docs: DataFrame, model_path: str, verified: int = 20, verified_share: int = 512, with_ids: bool = False, threads: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip (decoding gives the text back), and `ids` if asked.

    The first `verified` texts of each task, and all over the table those whose checksum is a
    multiple of `verified_share`, are also encoded and decoded by the sentencepiece library; a
    difference stops the task. Null texts count as empty: no ids. Repeated rows give repeated
    results, a null doc_id stays null; an empty table gives an empty one. A batch is about 2 MB of
    text; a longer text is a batch of its own. threads: see PieceModel.
    """
    out_schema = SCHEMA.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else SCHEMA

    def encode(batches):
        import sentencepiece

        model, left = PieceModel(model_path, threads), verified
        own = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for table in blocks_of(batches, 2 << 20):
            rows = table["text"].to_pylist()
            ids = model.encode(rows)
            back = [model.decode(x) for x in ids]
            for k, (t, x, b) in enumerate(zip(rows, ids, back)):
                if k >= left and zlib.crc32(x) % verified_share:
                    continue
                want = own.encode(t)
                if not model.agrees(np.frombuffer(x, "<u4").tolist(), want) or own.decode(want) != b:
                    raise ValueError("the model is not encoded as the sentencepiece library does")
            left = max(0, left - len(rows))
            columns = [table["doc_id"].combine_chunks(), pa.array([len(x) // 4 for x in ids]), pa.array([zlib.crc32(x) for x in ids]), pa.array([a == b for a, b in zip(rows, back)], pa.bool_())]
            if with_ids:
                columns.append(pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=out_schema)

    return texts(docs).mapInArrow(encode, "doc_id long, n_ids long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids)
