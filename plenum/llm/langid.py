"""Languages of documents as mixtures: n-gram likelihoods, expectation-maximisation, penalised choice.

Every word has a likelihood under each language, from its byte trigrams. A document is a mixture
of languages; expectation-maximisation over its words gives the proportions. Sets of the one,
two, ... most likely languages are compared by log-likelihood less a penalty for each language
beyond the first, and the proportions within the set chosen are the answer.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.common import blocks_of, texts, utf8

BITS = 15
LETTER = re.compile(r"[^\W\d_]").search
FOLD = np.full(256, 32, np.uint32)  # what is no letter parts words
FOLD[65:91], FOLD[97:123], FOLD[128:] = np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)
OUT = "doc_id long, lang_pred string, score double, proportions array<double>"


def trigrams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of a lower-cased text column, which of them lie in a word, where words begin, and the rows' offsets."""
    data, offsets = utf8(pa.array(column))
    b = FOLD[np.concatenate([[32], data, [32]]).astype(np.uint8)]
    codes = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA77) + b[2:] * np.uint32(0xC2B2AE3D)) * np.uint32(0x27D4EB2F) >> np.uint32(32 - BITS)
    inside = b[1:-1] != 32
    first = inside & (b[:-2] == 32)
    return codes.astype(np.int64), inside, first, offsets


def joined(rows: list[str]) -> list[str]:
    """Lower-cased, each with a blank at its end, so that no word crosses rows."""
    return [t.lower() + " " for t in rows]


def counted(docs: DataFrame) -> DataFrame:
    """docs(text, lang) to (lang, gram, n): what each task counts, added up."""
    schema = pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())])

    def count(batches):
        seen: dict[str, np.ndarray] = {}
        for table in blocks_of(batches, 1 << 20):
            langs, rows = np.array(table["lang"].to_pylist(), object), np.array(joined(table["text"].to_pylist()), object)
            for lang in sorted(set(langs)):
                codes, inside, _, _ = trigrams(list(rows[langs == lang]))
                seen[lang] = seen.get(lang, 0) + np.bincount(codes[inside], minlength=1 << BITS)
        for lang, n in seen.items():
            grams = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams.astype(np.int32)), pa.array(n[grams].astype(np.int64))], schema=schema)

    return docs.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """docs(text, lang) to the languages and log-likelihoods (gram x language), from all rows.

    Rows without text or language teach nothing. What comes to the driver is 2**15 counts for
    each language, however large the corpus.
    """
    rows = counted(docs.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")).toArrow()
    langs = sorted(set(rows["lang"].to_pylist()))
    n = np.zeros((1 << BITS, len(langs)))
    if langs:
        n[rows["gram"].to_numpy(), np.searchsorted(langs, rows["lang"].to_pylist())] = rows["n"].to_numpy()
    n += 0.5
    return langs, np.log(n / n.sum(0)).astype(np.float32)


def word_likelihoods(rows: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of every word under each language, and each word's row."""
    codes, inside, first, offsets = trigrams(rows)
    begins = np.flatnonzero(first)
    if not len(begins):
        return np.zeros((0, model.shape[1]), np.float32), np.zeros(0, np.int64)
    terms = model[codes]
    terms[~inside] = 0
    return np.add.reduceat(terms, begins), np.searchsorted(offsets, begins, "right") - 1


def mixture(fit: np.ndarray, row: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM from `share` (rows x languages; zero stays zero): shares and log-likelihood. fit: likelihoods, largest 1."""
    begins = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    n = np.diff(np.append(begins, len(row)))[:, None]
    rows, share = row[begins], share.copy()
    for _ in range(rounds):
        part = fit * share[row]
        part /= part.sum(1, keepdims=True)
        share[rows] = np.add.reduceat(part, begins) / n
    loglik = np.full(len(share), -np.inf)
    loglik[rows] = np.add.reduceat(np.log((fit * share[row]).sum(1)), begins)
    return share, loglik


def shares(rows: list[str], model: np.ndarray, least: float = 0.02, penalty: float = 3.0, rounds: int = 12) -> np.ndarray:
    """Proportions (rows x languages) within the language set that the penalised likelihood selects.

    Sets of every size are tried, up to all languages to which the mixture of all gives at least
    the share `least` of the words.
    """
    n_langs = model.shape[1]
    out = np.zeros((len(rows), n_langs))
    words, row = word_likelihoods(rows, model)
    if not len(words):
        return out
    fit = np.exp(words - words.max(1, keepdims=True)).astype(np.float64) + 1e-12
    full, _ = mixture(fit, row, np.full((len(rows), n_langs), 1 / n_langs), rounds)
    ranks = np.argsort(np.argsort(-full, 1, kind="stable"), 1, kind="stable")
    best = np.full(len(rows), -np.inf)
    for k in range(1, n_langs + 1):
        live = np.ones(len(rows), bool) if k == 1 else (full >= least).sum(1) >= k
        use = live[row]
        if not use.any():
            break
        start = np.where(ranks < k, full + 1e-6, 0)
        share, loglik = mixture(fit[use], row[use], start / start.sum(1, keepdims=True), rounds if k > 1 else 1)
        worth = loglik - penalty * (k - 1) * np.log(np.maximum(np.bincount(row, minlength=len(rows)), 2))
        better = live & (worth > best)
        best[better], out[better] = worth[better], share[better]
    return out


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score, proportions (in the order of the model's languages) of every document.

    Null texts, texts without a letter, and all texts where nothing was learned: `und`, score 0.
    Every word of a text counts, however long the text; other columns are not looked at. Ties go to the language first in the alphabet. Repeated rows give repeated results; an empty
    table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("proportions", pa.list_(pa.float64()))])

    def predict(batches):
        langs, loglik = sent.value
        for table in blocks_of(batches, 1 << 20):
            rows = table["text"].to_pylist()
            lettered = np.array([bool(LETTER(t)) for t in rows], bool) & bool(langs)
            found = shares(joined(rows), loglik) if langs else np.zeros((len(rows), 1))
            lettered &= found.any(1)
            top = found.argmax(1)
            yield pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks(), pa.array([langs[k] if ok else "und" for k, ok in zip(top, lettered)], pa.string()), pa.array(np.where(lettered, np.minimum(found.max(1), 1), 0.0)), pa.array(found.tolist(), pa.list_(pa.float64()))], schema=schema)

    return texts(docs).mapInArrow(predict, OUT)


def fold(n: int):
    """The part of a document for held-out tests: crc32 of its id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n
