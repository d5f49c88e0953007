"""A gated recurrent language model over words, in numpy, with a class-factored output.

Words are what ASCII white space parts, A-Z in lower case; each text ends with an end token. All
training tokens of the corpus are counted (packed, see `hashstats`). The most frequent words have
outputs of their own, in classes: P(word) = P(class | state) P(word | class, state). All others
share one output, within which their counts over the whole corpus decide. The network is trained
by truncated backpropagation on all training documents, in rounds: every part
trains from the same weights, the results are averaged. The state is carried from window to
window to the end of each document, so a score is the log-likelihood of the whole text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import blocks_of, power_of_two, save, text_bytes, texts, utf8, write_blocks
from plenum.llm.hashstats import BLOBS, answered, arrow, blobs, global_sums
from plenum.llm.words import ASCII_SPACES, words

H, E, CLASS, SPAN = 24, 16, 32, 32
END = np.uint64(0x5DEECE66D0B0E0FF)  # stands for the end of a text among the hashes of words
LN10 = np.log(10)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def held_out(doc_ids: list) -> np.ndarray:
    """Whether a document teaches nothing; one without an id does teach."""
    return np.array([i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i in doc_ids], bool)


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of a text column as places in their sorted distinct hashes, those hashes, and the rows' lengths."""
    data, offsets = utf8(pc.binary_join_element_wise(column, "", " "))
    begin, h = words(LOWER[data], ASCII_SPACES)
    sizes = np.diff(np.searchsorted(begin, offsets)) + 1
    row = np.repeat(np.arange(len(sizes)), sizes - 1)
    every = np.full(len(h) + len(sizes), END)
    every[np.arange(len(h)) + row] = h
    coded = pc.dictionary_encode(pa.array(every))
    keys = coded.dictionary.to_numpy()
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    return rank[coded.indices.to_numpy()], keys[order], sizes


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


class Model:
    """Ids 0 to n - 1: frequent words by rank; n: all others; n + 1: begin of a text.

    All parameters lie in one array, `flat`; `p` holds views of it by name. Gates are z (what is
    kept of the state), r (what of it the candidate sees) and the candidate n.
    """

    def __init__(self, counts: np.ndarray, others: float, flat: np.ndarray | None = None):
        self.n = len(counts)
        self.classes = -(-self.n // CLASS)
        shapes = {"emb": (self.n + 2, E), "wx": (3, E, H), "wh": (3, H, H), "b": (3, 1, H), "wc": (H, self.classes + 1), "bc": (self.classes + 1,), "ww": (self.classes, H, CLASS), "bw": (self.classes, CLASS)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in shapes.values()), np.float32) if flat is None else flat
        self.p, at = {}, 0
        for k, s in shapes.items():
            self.p[k] = self.flat[at : at + int(np.prod(s))].reshape(s)
            at += int(np.prod(s))
        if flat is None:  # the outputs begin at the corpus's own frequencies
            rng = np.random.default_rng(5)
            for k, s in shapes.items():
                if k[0] != "b":
                    self.p[k][:] = rng.normal(0, 0.1, s)
            padded = np.full(self.classes * CLASS, -30.0)
            padded[: self.n] = np.log(counts + 0.1)
            self.p["bw"][:] = padded.reshape(self.classes, CLASS)
            total = np.append(np.exp(padded).reshape(self.classes, CLASS).sum(1), others + 0.1)
            self.p["bc"][:] = np.log(total / total.sum())

    def inputs(self, ids: np.ndarray) -> np.ndarray:
        """What words as inputs give to the gates: gate, then the shape of ids, then H."""
        return (self.p["emb"] @ self.p["wx"] + self.p["b"])[:, ids]

    def step(self, h: np.ndarray, gx: np.ndarray, gates: np.ndarray, ghn: np.ndarray, out: np.ndarray) -> None:
        """The states after h, to `out`; gx: see inputs; gates (z, r, n; each of h's shape) and ghn are filled."""
        gh = h @ self.p["wh"]
        zr, n = gates[:2], gates[2]
        np.add(gx[:2], gh[:2], out=zr)
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1
        zr *= 0.5
        ghn[:] = gh[2]
        np.multiply(zr[1], ghn, out=n)
        n += gx[2]
        np.tanh(n, out=n)
        np.subtract(h, n, out=out)
        out *= zr[0]
        out += n

    def by_class(self, y: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """The class of each target, and for each class that occurs (but that of the others) its targets' places."""
        c = np.where(y < self.n, y // CLASS, self.classes)
        order = np.argsort(c, kind="stable")
        at = np.searchsorted(c[order], np.arange(self.classes + 1))
        return c, [(k, order[at[k] : at[k + 1]]) for k in range(self.classes) if at[k] < at[k + 1]]

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """ln P(y) of each state."""
        c, classes = self.by_class(y)
        x = h @ self.p["wc"]
        x += self.p["bc"]
        x -= x.max(1, keepdims=True)
        out = x[np.arange(len(y)), c]
        np.exp(x, out=x)
        out -= np.log(x.sum(1))
        for k, own in classes:
            w = h[own] @ self.p["ww"][k]
            w += self.p["bw"][k]
            w -= w.max(1, keepdims=True)
            hit = w[np.arange(len(own)), y[own] % CLASS]
            np.exp(w, out=w)
            out[own] += hit - np.log(w.sum(1))
        return out

    def score(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """ln P of each document (ids of all, one after the other). Documents run side by side, longest first."""
        out = np.zeros(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        begins, lengths = (np.cumsum(sizes) - sizes)[order], sizes[order]
        table = self.inputs(np.arange(self.n + 2))
        h, last, at = np.zeros((len(sizes), H), np.float32), np.full(len(sizes), self.n + 1), 0
        gates, ghn = np.empty((3, len(sizes), H), np.float32), np.empty((len(sizes), H), np.float32)
        while len(lengths) and at < lengths[0]:
            now = int(np.searchsorted(-lengths, -at, "left"))
            span = int(min(max(16, 32768 // now), 4096, lengths[0] - at))
            live = np.searchsorted(-lengths, -np.arange(at, at + span), "left")
            ends = np.cumsum(live)
            states, targets, docs = np.empty((ends[-1], H), np.float32), np.empty(ends[-1], np.int64), np.empty(ends[-1], np.int64)
            before = h
            for t, (m, end) in enumerate(zip(live.tolist(), ends.tolist())):
                own = states[end - m : end]
                self.step(before[:m], table[:, last[:m]], gates[:, :m], ghn[:m], own)
                targets[end - m : end] = last[:m] = ids[begins[:m] + (at + t)]
                docs[end - m : end] = np.arange(m)
                before = own
            h = before.copy()
            out += np.bincount(docs, self.log_probs(states, targets), len(out))
            at += span
        result = np.empty(len(sizes))
        result[order] = out
        return result

    def train(self, ids: np.ndarray, sizes: np.ndarray, streams: int = 128, least_steps: int = 32, rate: float = 0.008) -> None:
        """One pass of Adam over the documents' tokens, one after the other, laid out in streams; gradients reach SPAN steps back.

        Every token is a target once; what is missing to the last stream's end counts nothing. The
        state begins anew with each document. Fewer streams where the tokens are few, so that there
        are `least_steps` windows.
        """
        if not len(ids):
            return
        streams = min(streams, max(1, len(ids) // (SPAN * least_steps)))
        width = -(-len(ids) // streams)
        x, fresh, counts = np.zeros(width * streams, np.int64), np.zeros(width * streams, bool), np.zeros(width * streams, bool)
        x[: len(ids)], counts[: len(ids)] = ids, True
        fresh[np.cumsum(sizes)[:-1]] = True
        fresh[0] = True
        previous = np.append(self.n + 1, x[:-1])
        previous[fresh] = self.n + 1
        x, fresh, counts, previous = (v.reshape(streams, width) for v in (x, fresh, counts, previous))
        previous[:, 0], fresh[:, 0] = self.n + 1, True  # a stream that begins within a document knows nothing of it
        h, step = np.zeros((streams, H), np.float32), 0
        a, b, scratch = np.zeros_like(self.flat), np.zeros_like(self.flat), np.empty_like(self.flat)
        for at in range(0, width, SPAN):
            own = slice(at, at + SPAN)
            g, h = self.gradients(h, previous[:, own], x[:, own], fresh[:, own], counts[:, own])
            step += 1
            np.clip(g, -0.2, 0.2, out=g)
            a *= 0.9
            a += np.multiply(g, 0.1, out=scratch)
            g *= g
            g *= 0.01
            b *= 0.99
            b += g
            np.sqrt(b, out=scratch)
            scratch /= np.sqrt(1 - 0.99**step)
            scratch += 1e-6
            np.divide(a, scratch, out=scratch)
            scratch *= rate / (1 - 0.9**step)
            self.flat -= scratch

    def gradients(self, h: np.ndarray, before: np.ndarray, y: np.ndarray, fresh: np.ndarray | None = None, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of the mean of -ln P(y) over a window of streams, as one array like `flat`; and the states behind it.

        fresh: where a document begins, and with it the state; counts: which targets count.
        """
        p, (streams, width) = self.p, y.shape
        gx = self.inputs(before.T)
        ins, hs, gates, ghn = np.empty((width, streams, H), np.float32), np.empty((width, streams, H), np.float32), np.empty((3, width, streams, H), np.float32), np.empty((width, streams, H), np.float32)
        begins = np.zeros(width, bool) if fresh is None else fresh.any(0)
        for t in range(width):
            ins[t] = hs[t - 1] if t else h
            if begins[t]:
                ins[t, fresh[:, t]] = 0
            self.step(ins[t], gx[:, t], gates[:, t], ghn[t], hs[t])
        states, target = hs.reshape(-1, H), y.T.ravel()
        out = Model(np.zeros(self.n), 0, np.zeros_like(self.flat))
        g, scale = out.p, np.float32(1 / len(target))
        if counts is not None and not counts.all():
            scale = (counts.T.reshape(-1, 1) / max(counts.sum(), 1)).astype(np.float32)
        c, classes = self.by_class(target)
        q = softmax(states @ p["wc"] + p["bc"])
        q[np.arange(len(c)), c] -= 1
        q *= scale
        g["wc"][:], g["bc"][:] = states.T @ q, q.sum(0)
        back = q @ p["wc"].T
        for k, own in classes:
            w = softmax(states[own] @ p["ww"][k] + p["bw"][k])
            w[np.arange(len(own)), target[own] % CLASS] -= 1
            w *= scale if scale.ndim == 0 else scale[own]
            g["ww"][k], g["bw"][k] = states[own].T @ w, w.sum(0)
            back[own] += w @ p["ww"][k].T
        # what a state's gradient passes on to its gates, for all steps at once
        z, r, n = gates
        to_n = (1 - z) * (1 - n * n)
        to_z, to_r = (ins - n) * z * (1 - z), ghn * r * (1 - r)
        back, later = back.reshape(width, streams, H), np.zeros((streams, H), np.float32)
        dgh, dn, turned = gates.copy(), np.empty_like(ghn), np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
        for t in range(width - 1, -1, -1):
            d = back[t]
            d += later
            np.multiply(d, to_n[t], out=dn[t])
            np.multiply(d, to_z[t], out=dgh[0, t])
            np.multiply(dn[t], to_r[t], out=dgh[1, t])
            np.multiply(dn[t], r[t], out=dgh[2, t])
            later = (dgh[:, t] @ turned).sum(0)
            d *= z[t]
            later += d
            if begins[t]:
                later[fresh[:, t]] = 0
        dgh = dgh.reshape(3, -1, H)
        g["wh"][:] = ins.reshape(-1, H).T @ dgh
        dgh[2] = dn.reshape(-1, H)
        read = before.T.ravel()
        order = np.argsort(read, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(read[order]) > 0]))
        by_word, of = np.add.reduceat(dgh[:, order], first, 1), read[order[first]]
        g["emb"][of] = (by_word @ p["wx"].transpose(0, 2, 1)).sum(0)
        g["wx"][:], g["b"][:] = p["emb"][of].T @ by_word, by_word.sum(1, keepdims=True)
        return out.flat, hs[-1]

    def pack(self) -> bytes:
        return self.flat.astype("<f4").tobytes()

    def unpack(self, blob: bytes) -> Model:
        return Model(np.zeros(self.n), 0, np.frombuffer(blob, "<f4").copy())


def averaged(parts: DataFrame, width: int = 64) -> bytes | None:
    """The mean of weights(part, params, n), weighted by n, by groups of `width` again and again."""

    def mean(t: pa.Table) -> pa.Table:
        t = t.sort_by("part")  # sums of floats in one order, whatever came first
        n = np.array(t["n"].to_pylist(), np.float64)
        total = sum(np.frombuffer(x, "<f4") * k for x, k in zip(t["params"].to_pylist(), n)) / n.sum()
        return arrow({"part": [t["part"][0].as_py() // width], "params": [total.astype("<f4").tobytes()], "n": [int(n.sum())]}, "part long, params binary, n long")

    parts = save(parts, "weights")
    while parts.count() > 1:
        parts = save(parts.withColumn("part", F.floor(F.col("part") / width)).groupBy("part").applyInArrow(mean, "part long, params binary, n long"), "weights")
        width = max(width, 2)
    row = parts.first()
    return row["params"] if row else None


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
LESSONS = "key long, doc_id long, ids binary, n long"
WEIGHTS = "part long, params binary, n long"


def scores(docs: DataFrame, vocabulary: int = 1024, rounds: int = 4, part_tokens: int = 800_000, block_mb: float = 8) -> DataFrame:
    """SCORES of every whole text; documents whose crc32(id) mod 10 is 0 teach nothing.

    All training tokens are counted, and the network reads every token of every training document
    once. The documents are dealt out to parts by a hash of id and length and read in its order, so
    that the weights do not depend on how the rows lie or how the work is cut; in each of `rounds`
    rounds its share of the parts begins at the weights that the round before left, and what they
    learn is averaged. Null texts count as empty (the end token alone), repeated rows are documents
    each, a null doc_id teaches and has a null held_out, a long text is a block of its own, an empty
    table gives an empty result. Other columns are not looked at.
    """
    spark = docs.sparkSession
    docs = texts(docs)
    size = text_bytes(docs)
    bits = power_of_two(size / (2 << 20)).bit_length() - 1
    blocks = write_blocks(docs, size, block_mb)
    by_block = blocks.groupBy("block")

    def count(table: pa.Table) -> pa.Table:
        place, keys, sizes = tokens(table["text"])
        teach = np.repeat(~held_out(table["doc_id"].to_pylist()), sizes)
        n = np.bincount(place[teach], minlength=len(keys)).astype(np.uint64)
        return arrow(blobs(table["block"][0].as_py(), keys, n, bits), BLOBS)

    answers = save(global_sums(by_block.applyInArrow(count, BLOBS), vocabulary), "words")
    row = answers.agg(F.sum("total"), F.sum("n_distinct")).first()
    n_train, n_distinct = int(row[0] or 0), int(row[1] or 0)
    known = answers.select(F.explode(F.arrays_zip("top_keys", "top_sums")).alias("top")).select(F.col("top.top_keys").alias("key"), F.col("top.top_sums").alias("n"))
    known = known.orderBy(F.desc("n"), "key").limit(vocabulary).toArrow()
    answers = answers.select("block", "bucket", "answer")

    frequent, counts = known["key"].to_numpy().view(np.uint64), known["n"].to_numpy().astype(np.float64)
    others = n_train - counts.sum()
    model = Model(counts, others)
    order = np.argsort(frequent)
    in_order = frequent[order]

    def own_ids(place: np.ndarray, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(in_order, keys), max(len(frequent) - 1, 0))
        return (np.where(in_order[at] == keys, order[at], len(frequent)) if len(frequent) else np.zeros(len(keys), np.int64))[place]

    def taught(batches):
        for table in blocks_of(batches, 1 << 18):
            chosen = table.filter(pa.array(~held_out(table["doc_id"].to_pylist())))
            if chosen.num_rows:
                place, keys, sizes = tokens(chosen["text"])
                ids, ends = own_ids(place, keys).astype("<u2"), np.cumsum(sizes).tolist()
                each = [ids[a:b].tobytes() for a, b in zip([0, *ends], ends)]
                yield from arrow({"key": chosen["key"].to_pylist(), "doc_id": chosen["doc_id"].to_pylist(), "ids": each, "n": sizes.tolist()}, LESSONS).to_batches()

    if len(frequent):
        keyed = blocks.select(F.xxhash64("doc_id", F.octet_length("text")).alias("key"), "doc_id", "text")
        lessons = save(keyed.mapInArrow(taught, LESSONS), "lessons")
        parts = max(rounds, round(n_train / part_tokens))
        lessons = lessons.withColumn("part", F.pmod("key", F.lit(parts)))

        def teacher(begun, rate: float):
            def teach(table: pa.Table) -> pa.Table:
                own, rows = model.unpack(begun.value), table.to_pydict()
                order = sorted(range(table.num_rows), key=lambda k: (rows["key"][k], rows["doc_id"][k] is None, rows["doc_id"][k] or 0, rows["ids"][k]))
                ids = np.frombuffer(b"".join(rows["ids"][k] for k in order), "<u2").astype(np.int64)
                own.train(ids, np.array([rows["n"][k] for k in order]), rate=rate)
                return arrow({"part": [rows["part"][0]], "params": [own.pack()], "n": [len(ids)]}, WEIGHTS)

            return teach

        for k in range(rounds):
            teach = teacher(spark.sparkContext.broadcast(model.pack()), 0.008 / (1 + k / 2))
            found = averaged(lessons.where(F.pmod("part", F.lit(rounds)) == k).groupBy("part").applyInArrow(teach, WEIGHTS))
            model = model.unpack(found) if found else model
    sent = spark.sparkContext.broadcast(model.pack())
    n_others = n_distinct - len(frequent)

    def judge(table: pa.Table, given: pa.Table) -> pa.Table:
        names = [x.split()[0] for x in SCORES.split(", ")]
        out: dict[str, list] = {n: [] for n in names}
        if table.num_rows:
            place, keys, sizes = tokens(table["text"])
            c = answered(given, keys, bits).astype(np.float64)
            begins = np.cumsum(sizes) - sizes
            base = np.log10((c + 0.1) / (n_train + 0.1 * (n_distinct + 1)))[place]
            score = base = np.add.reduceat(base, begins)
            if len(frequent):
                ids = own_ids(place, keys)
                within = np.where(ids == len(frequent), np.log10((c + 0.1) / (others + 0.1 * (n_others + 1)))[place], 0)
                score = model.unpack(sent.value).score(ids, sizes) / LN10 + np.add.reduceat(within, begins)
            doc_ids = table["doc_id"].to_pylist()
            columns = (doc_ids, [None if i is None else h for i, h in zip(doc_ids, held_out(doc_ids).tolist())], sizes.tolist(), np.add.reduceat((c > 0)[place].astype(np.int64), begins).tolist(), [n_train] * len(sizes), base.tolist(), score.tolist())
            out = dict(zip(names, columns))
        return arrow(out, SCORES)

    return by_block.cogroup(answers.groupBy("block")).applyInArrow(judge, SCORES)
