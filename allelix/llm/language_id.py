"""Language identification as a mixture.

Each word has a likelihood under every learned language from smoothed counts of its character
n-grams. A document's words come from a mixture of languages whose proportions are estimated by
expectation-maximisation; languages are then taken away as long as the likelihood, penalised for each
language in the set, gets better.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from allelix.llm.blocks import release
from allelix.llm.common import BoundedCache, chunks, table
from allelix.session import ship_package

FOLDS, HELD_OUT = 4, 2
#: Labelled rows fitted for each language, about: rows are taken by a hash of their id.
FIT_ROWS = 2_000
#: N-grams of 1 to 3 characters are counted in so many slots at most, each order apart.
SLOTS = 1 << 16
ORDERS = (1, 2, 3)
#: Bounds of the model and of a worker's table of words: more languages get fewer slots and words.
MODEL_BYTES, TABLE_BYTES = 32 << 20, 32 << 20
SMOOTHING = 0.5
ROUNDS = 12
WORD_KEYS = 200_000
UNKNOWN = "und"
_LETTERS = regex.compile(r"\p{L}+")
_MULTIPLIER = np.array([1, 0x9E3779B1, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def grams(words: list[str], n_slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """(word index, slot) of every n-gram of every word, a space at either end."""
    text = " ".join(["", *words, ""])
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.cumsum(codes == 32) - 1
    index, slots = [], []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        h = np.zeros(n, dtype=np.uint64)
        for i in range(order):
            h = (h + codes[i : i + n]) * _MULTIPLIER[2] ^ (h >> np.uint64(29)) * _MULTIPLIER[1]
        # n-grams with a space inside, or of a space alone, belong to no word
        blank = codes == 32
        ok = np.ones(n, dtype=bool)
        for i in range(order):
            if order == 1 or 0 < i < order - 1:
                ok &= ~blank[i : i + n]
        if order == 2:
            ok &= ~(blank[:n] & blank[1 : 1 + n])
        at = np.flatnonzero(ok)
        index.append(owner[at])
        slots.append((h[at] >> np.uint64(40)) % np.uint64(n_slots) + np.uint64(n_slots * (order - 1)))
    if not index:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(index).astype(np.int64), np.concatenate(slots).astype(np.int64)


@dataclass
class LanguageModel:
    """Log probabilities of the slots under each language, in the languages' order by name."""

    languages: list[str]
    weights: np.ndarray  # [len(ORDERS) * slots, languages]

    @property
    def slots(self) -> int:
        return len(self.weights) // len(ORDERS)

    def word_scores(self, words: list[str]) -> np.ndarray:
        owner, slots = grams(words, self.slots)
        out = np.zeros((len(words), len(self.languages)))
        for l in range(len(self.languages)):
            out[:, l] = np.bincount(owner, weights=self.weights[slots, l], minlength=len(words))[: len(words)]
        # the orders overlap: their mean counts each character about once
        return out / len(ORDERS)

    def mixtures(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Proportions [documents, languages]; ``scores`` has the documents' words in a row."""
        n_docs, n_langs = len(sizes), len(self.languages)
        if not n_docs or not n_langs:
            return np.zeros((n_docs, n_langs))
        top = scores.max(axis=1, keepdims=True)
        likelihood = np.exp(np.maximum(scores - top, -60.0))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        owner = np.repeat(np.arange(n_docs), sizes)

        def fit(pi: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """EM over the documents ``which`` from ``pi``; a zero proportion stays zero."""
            pick = np.zeros(n_docs, dtype=bool)
            pick[which] = True
            rows = pick[owner]
            like, n = likelihood[rows], sizes[which]
            begin = np.concatenate(([0], np.cumsum(n)[:-1]))
            for _ in range(ROUNDS):
                joint = like * np.repeat(pi, n, axis=0)
                joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
                pi = np.add.reduceat(joint, begin, axis=0) / n[:, None]
            total = np.log(np.maximum((like * np.repeat(pi, n, axis=0)).sum(axis=1), 1e-300))
            return pi, np.add.reduceat(total, begin)

        every = np.arange(n_docs)
        penalty = np.log(sizes + 1.0) + 1.0
        pi, value = fit(np.full((n_docs, n_langs), 1.0 / n_langs), every)
        open_ = every
        while len(open_):
            current = pi[open_]
            held = current > 0
            open_, current, held = (x[held.sum(axis=1) > 1] for x in (open_, current, held))
            if not len(open_):
                break
            # all languages that explain less than half a word go together, else the one of least share
            least = np.where(held, current, np.inf).min(axis=1, keepdims=True)
            drop = held & ((current * sizes[open_][:, None] < 0.5) | (current == least))
            drop &= current < current.max(axis=1, keepdims=True)
            ties = ~drop.any(axis=1)
            drop[ties] = held[ties] & (np.arange(n_langs) != current[ties].argmax(axis=1)[:, None])
            less = np.where(drop, 0.0, current)
            less = np.where(less > 0, np.maximum(less, 1e-3), 0.0)
            less /= less.sum(axis=1, keepdims=True)
            new, gained = fit(less, open_)
            better = gained + penalty[open_] * drop.sum(axis=1) >= value[open_]
            open_, new, gained = open_[better], new[better], gained[better]
            pi[open_], value[open_] = new, gained
        return pi


def in_fold(doc_id, folds: int, fold: int):
    """True where crc32 of the id as text leaves ``fold``; a null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def slot_count(languages: int) -> int:
    """Slots of each order, a power of two, so that the model stays within ``MODEL_BYTES``; 16 at least."""
    return min(SLOTS, max(16, 1 << max(0, (MODEL_BYTES // (4 * len(ORDERS) * max(1, languages))).bit_length() - 1)))


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> LanguageModel:
    """Counts of a bounded sample of the labelled rows outside the held-out fold.

    Only rows with a text and a language are read; of each language about ``fit_rows`` are taken, by a
    hash of id and text, so that rows equal in both are taken or left together. Whole texts are
    counted where they are; what reaches the driver is a number for each language and slot, at most
    ``MODEL_BYTES`` / 4 of them. Without labelled rows the model has no language.
    """
    ship_package(docs.sparkSession)
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~in_fold(docs["doc_id"], FOLDS, HELD_OUT)).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    n_slots = slot_count(len(languages))
    if not languages:
        return LanguageModel([], np.zeros((len(ORDERS) * n_slots, 0), dtype=np.float32))
    share = docs.sparkSession.createDataFrame([(x, i, min(1.0, fit_rows / sizes[x])) for i, x in enumerate(languages)], "name string, l int, share double")
    sample = labelled.join(F.broadcast(share), F.col("lang") == F.col("name")).where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * (1 << 30))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def sums() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), lang, dtype=np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["l", "slot", "n"])
            held.clear()

        for batch, texts in chunks(batches):
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if words := _LETTERS.findall(text.lower()):
                    if lang not in held:
                        if len(held) * len(ORDERS) * n_slots * 8 > TABLE_BYTES:
                            yield from sums()
                        held[lang] = np.zeros(len(ORDERS) * n_slots, dtype=np.int64)
                    held[lang] += np.bincount(grams(words, n_slots)[1], minlength=len(held[lang]))
        yield from sums()

    counted = sample.select("l", "text").mapInArrow(count, "l int, slot int, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()
    weights = np.full((len(ORDERS) * n_slots, len(languages)), SMOOTHING, dtype=np.float32)
    weights[counted["slot"].to_numpy(), counted["l"].to_numpy()] += counted["n"].to_numpy().astype(np.float32)
    weights = weights.reshape(len(ORDERS), n_slots, len(languages))
    np.log(weights / weights.sum(axis=1, keepdims=True, dtype=np.float64), out=weights, casting="same_kind")
    return LanguageModel(languages, weights.reshape(-1, len(languages)))


SCHEMA = "lang_pred string, score double, languages array<string>, proportions array<double>"


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (its columns in a struct ``doc``) with the prediction for each whole text.

    ``lang_pred`` is the language of the largest proportion (ties: the first by name), ``score`` that
    proportion. Texts that are null or have no letter, and all texts if no language was learned, are
    ``und`` with score 0. Narrow: no shuffle.
    """
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most MODEL_BYTES
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"))
    at_text = docs.columns.index("text")
    most_words = max(1_000, min(WORD_KEYS, TABLE_BYTES // (8 * max(1, len(model.languages)))))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = sent.value
        cache, table_ = BoundedCache(most_words), np.zeros((most_words, len(engine.languages)))
        whole = (pa.RecordBatch.from_arrays([b.column(0), b.column(0).field(at_text)], names=["doc", "text"]) for b in batches)
        for batch, texts in chunks(whole, limit=min(500_000, 4 * most_words)):
            words = [_LETTERS.findall(t.lower()) for t in texts] if engine.languages else [[] for _ in texts]
            sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
            wanted = set().union(*words)
            new = cache.missing(wanted)
            if len(wanted) > len(table_):
                table_ = np.zeros((len(wanted), len(engine.languages)))
                cache.clear()
                new = list(wanted)
            if new:
                # after an overflow the kept words are numbered anew
                if any(i >= len(cache) for i in cache.values()):
                    old = np.fromiter(cache.values(), dtype=np.int64, count=len(cache))
                    table_[: len(cache)] = table_[old]
                    for i, w in enumerate(list(cache)):
                        cache[w] = i
                base = len(cache)
                table_[base : base + len(new)] = engine.word_scores(new)
                cache.update((w, base + i) for i, w in enumerate(new))
            flat = np.fromiter((i for ws in words for i in map(cache.__getitem__, ws)), dtype=np.int64, count=int(sizes.sum()))
            some = np.flatnonzero(sizes)
            pi = engine.mixtures(table_[flat], sizes[some])
            labels, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            sets: list[list[str]] = [[] for _ in texts]
            shares: list[list[float]] = [[] for _ in texts]
            for row, at in zip(pi, some.tolist(), strict=True):
                order = [l for l in np.argsort(-row, kind="stable") if row[l] > 0]
                labels[at], scores[at] = engine.languages[order[0]], min(1.0, row[order[0]])
                sets[at], shares[at] = [engine.languages[l] for l in order], [float(row[l]) for l in order]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(labels, pa.string()), pa.array(scores), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], names=["doc", "lang_pred", "score", "languages", "proportions"])
        release()

    return out.mapInArrow(run, StructType([out.schema["doc"], *_parse_datatype_string(SCHEMA)]))


#: A text whose main language explains less of it than this is rejected.
MIN_SCORE = 0.2


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a main language.

    Null, empty and letterless texts go. Where no row is labelled no language can be learned, and
    every row stays. Repeated rows stay or go together; an empty table gives no rows.
    """
    model = fit(docs)
    if not model.languages:
        return docs
    return predict(docs, model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("doc.*")


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for all documents by a model of their labelled rows: see ``fit`` and ``predict``; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit(docs))
    return found.select(F.col("doc.doc_id").alias("doc_id"), in_fold(F.col("doc.doc_id"), FOLDS, HELD_OUT).alias("held_out"), "lang_pred", "score", "languages", "proportions")
