"""Language identification of mixed-language text.

Each word gets a score for every learned language from smoothed character n-grams and whole words. The script of a
word, by code-point ranges, narrows the languages that may claim it. A Viterbi pass over a document's word scores, with
a penalty for each change of language, labels its spans.

Fitting takes at most per_language documents of each language, those with the lowest hash of their id, so the sample is
bounded and does not depend on the partitioning. No language is left out: the model takes a quarter of a megabyte for each,
and more than MAX_LANGUAGES are an error.
Defined results: a null text, or one without a letter, is `und` with score 0 and no span; rows without a language or
text are not learned from; ties go to the language that comes first by name; repeated rows get equal results; with
nothing to learn from every text is `und`. Whole texts are read, however long.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidra.llm._shared import map_batches, steps, with_columns

WORDS = re.compile(r"[^\W\d_]+")

# First code point of each script range and the script's number (0: none of those below).
SCRIPTS = [
    (0x0000, 0), (0x0041, 1), (0x0370, 2), (0x0400, 3), (0x0530, 4), (0x0590, 5), (0x0600, 6), (0x0780, 0), (0x0900, 7),
    (0x0980, 8), (0x0A00, 9), (0x0A80, 10), (0x0B00, 0), (0x0B80, 11), (0x0C00, 12), (0x0C80, 13), (0x0D00, 14),
    (0x0D80, 0), (0x0E00, 15), (0x0E80, 0), (0x10A0, 16), (0x1100, 17), (0x1200, 18), (0x13A0, 0), (0x1E00, 1),
    (0x1F00, 2), (0x2000, 0), (0x2C60, 1), (0x2C80, 0), (0x3040, 19), (0x3100, 0), (0x3400, 20), (0xA000, 0),
    (0xAC00, 17), (0xD7B0, 0), (0xF900, 20), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 19),
    (0xFFA0, 0), (0x20000, 20),
]
N_SCRIPTS = 21
_FIRST, _SCRIPT = np.array([a for a, _ in SCRIPTS]), np.array([b for _, b in SCRIPTS])

#: Hashed features: n-grams of 1 to 3 characters with word borders, and whole words.
BUCKETS = 1 << 16
#: A language may claim words of a script that makes up this share of its learned words.
SCRIPT_SHARE = 0.01
#: Cost of a change of language, in nats.
SWITCH = 8.0
#: Weight of a word's summed n-gram evidence; the n-grams of a word overlap and aren't independent.
TEMPER = 0.5
#: Languages of a model; it is broadcast.
MAX_LANGUAGES = 200
#: Bytes that a task keeps of words and their scores.
MEMO_BYTES = 32 << 20
_OUT = 60.0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of distinct non-empty words: feature buckets, the word that each belongs to, and each word's script."""
    joined = "\0".join(words)
    codes = np.frombuffer(f"\0{joined}\0".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    border = codes == 0
    owner = np.cumsum(border) - 1
    first = np.flatnonzero(border)[:-1] + 1
    c = _mix(codes + np.uint64(1))
    buckets, owners = [c[~border]], [owner[~border]]
    two = _mix(c[:-1] * np.uint64(3) + c[1:])
    buckets.append(two)
    owners.append(np.where(border[1:], owner[:-1], owner[1:]))
    if len(c) > 2:
        inner = ~border[1:-1]
        three = _mix(c[:-2] * np.uint64(5) + c[1:-1] * np.uint64(7) + c[2:])
        buckets.append(three[inner])
        owners.append(owner[1:-1][inner])
    # the borders within a sum count as 0, so a word's bucket is the same whatever stands beside it
    place = np.arange(len(c), dtype=np.uint64) - first.astype(np.uint64)[owner.clip(0, len(words) - 1)] + np.uint64(11)
    whole = np.add.reduceat(np.where(border, np.uint64(0), c * place), first)
    buckets.append(_mix(whole))
    owners.append(np.arange(len(words)))
    scripts = _SCRIPT[np.searchsorted(_FIRST, codes[first].astype(np.int64), side="right") - 1]
    return (np.concatenate(buckets) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate(owners), scripts


@dataclass(frozen=True)
class LanguageModel:
    """languages sorted by name; scores (BUCKETS, languages) log probabilities; allowed (scripts, languages)."""

    languages: tuple[str, ...]
    scores: np.ndarray
    allowed: np.ndarray

    def word_scores(self, words: list[str]) -> np.ndarray:
        """(words, languages): evidence of each distinct word, its best language at 0."""
        buckets, owner, scripts = word_features(words)
        out = np.empty((len(words), len(self.languages)))
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(owner, self.scores[buckets, k], len(words))
        out *= TEMPER
        allowed = self.allowed[scripts]
        allowed[~allowed.any(1)] = True
        out = np.where(allowed, out, -np.inf)
        return np.maximum(out - out.max(1, keepdims=True), -_OUT).astype(np.float32)


def _count(batches):
    """(lang, bucket, n) of a task's texts; script counts in buckets from BUCKETS on."""
    by: dict[str, np.ndarray] = {}

    def counts():
        for lang, n in by.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(n[hit])], ["lang", "bucket", "n"])
        by.clear()

    for whole in batches:
        for batch in steps(whole):
            seen: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
            for lang, words in seen.items():
                if not words:
                    continue
                if lang not in by and len(by) >= 32:
                    yield from counts()
                times = np.fromiter(words.values(), np.float64, len(words))
                buckets, owner, scripts = word_features(list(words))
                n = by.setdefault(lang, np.zeros(BUCKETS + N_SCRIPTS))
                n += np.concatenate([np.bincount(buckets, times[owner], BUCKETS), np.bincount(scripts, times, N_SCRIPTS)])
    yield from counts()


def fit(docs: DataFrame, learn: Column, per_language: int = 1000) -> LanguageModel:
    """A model from the rows of docs (doc_id, text, lang) for which learn holds; an error beyond MAX_LANGUAGES."""
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("text", "lang", F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")).alias("key"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("size")).limit(MAX_LANGUAGES + 1).toArrow()
    if sizes.num_rows > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages make too large a model to broadcast; let learn select fewer")
    # the lowest hashes of a language, a few more than are taken: so the window never meets a whole language
    enough = per_language + 10 * per_language**0.5 + 50
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, enough / n)) for k, n in zip(*(c.to_pylist() for c in sizes.columns), strict=True)], "lang string, share double")
    order = Window.partitionBy("lang").orderBy("key")
    low = rows.select("key", "lang").join(F.broadcast(shares), "lang").filter(F.col("key") / 2.0**64 + 0.5 <= F.col("share"))
    ids = low.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= per_language)
    sample = rows.join(F.broadcast(ids.select("key").distinct()), "key", "left_semi")
    found = map_batches(sample.select("lang", "text"), _count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").cast("float").alias("n")).toArrow()
    names = found.column("lang").combine_chunks().dictionary_encode() if found.num_rows else pa.array([], pa.string()).dictionary_encode()
    languages = tuple(sorted(names.dictionary.to_pylist()))
    place = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)
    n = np.zeros((BUCKETS + N_SCRIPTS, len(languages)))
    n[found.column("bucket").to_numpy(), place[names.indices.to_numpy()]] = found.column("n").to_numpy()
    grams, scripts = n[:BUCKETS] + 0.1, n[BUCKETS:]
    share = scripts / np.maximum(scripts.sum(0), 1)
    return LanguageModel(languages, np.log(grams / grams.sum(0)).astype(np.float32), share >= SCRIPT_SHARE)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of each word for many documents at once. scores: (words, languages); a document's words are
    scores[start : start + length]. All documents advance together, longest first, so one step is a few array operations."""
    by = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by], lengths[by]
    labels = np.zeros(len(scores), np.int16)
    if not len(lengths) or not lengths[0]:
        return labels
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    value = scores[starts[: live[0]]].copy()
    came: list[tuple[np.ndarray, np.ndarray]] = []
    final = np.empty((live[0], scores.shape[1]), np.float32)
    final[:] = value
    for t in range(1, lengths[0]):
        a = live[t]
        value = value[:a]
        best = value.argmax(1)
        change = value[np.arange(a), best] - np.float32(switch)
        stay = value >= change[:, None]
        came.append((best.astype(np.int16), stay))
        value = np.maximum(value, change[:, None])
        value -= value.max(1, keepdims=True)
        value += scores[starts[:a] + t]
        final[:a] = value
    label = final.argmax(1).astype(np.int16)
    for t in range(lengths[0] - 1, 0, -1):
        a = live[t]
        labels[starts[:a] + t] = label[:a]
        best, stay = came[t - 1]
        label[:a] = np.where(stay[np.arange(a), label[:a]], label[:a], best)
    labels[starts[: live[0]]] = label
    return labels


SPANS = "array<struct<start:int,end:int,lang:string>>"


#: Words whose best path is sought at once.
PATH_WORDS = 1_000_000


class _Known:
    """The words that a task has met, and their scores."""

    def __init__(self, model: LanguageModel):
        self.model, self.most = model, MEMO_BYTES // (140 + 4 * len(model.languages))
        self.index: dict[str, int] = {}
        self.table = np.empty((0, len(model.languages)), np.float32)

    def trim(self) -> None:
        if len(self.index) > self.most:
            self.index, self.table = {}, self.table[:0]

    def places(self, texts: list[str | None]) -> list[np.ndarray]:
        """Of each text the rows of table that hold its words' scores."""
        words = [[] if t is None or not self.model.languages or not any(map(str.isalpha, t)) else WORDS.findall(t.lower()) for t in texts]
        index, known = self.index, len(self.index)
        new = dict.fromkeys(w for ws in words for w in ws if w not in index)
        if new:
            index.update(zip(new, range(known, known + len(new)), strict=True))
            self.table = np.concatenate([self.table, self.model.word_scores(list(new))])
        return [np.array([index[w] for w in ws], np.int32) for ws in words]


def _labelled(known: _Known, places: list[np.ndarray]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
    """lang_pred, score and spans of texts by their words' places."""
    languages = known.model.languages
    preds, scores, spans = ["und"] * len(places), np.zeros(len(places)), [[] for _ in places]
    if languages and places:
        lengths = np.array([len(p) for p in places], np.int64)
        starts = np.cumsum(lengths) - lengths
        labels = viterbi(known.table[np.concatenate(places)], starts, lengths)
        for i in np.flatnonzero(lengths):
            own = labels[starts[i] : starts[i] + lengths[i]]
            share = np.bincount(own, minlength=len(languages))
            preds[i] = languages[share.argmax()]
            scores[i] = share.max() / lengths[i]
            cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), int(lengths[i])]
            spans[i] = [{"start": a, "end": b, "lang": languages[own[a]]} for a, b in zip(cuts, cuts[1:], strict=False)]
    return preds, scores, spans


def _labeller(model: LanguageModel):
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def at(text: int, keep: int):
        def run(batches):
            known, held, places = _Known(model), [], []

            def results():
                preds, scores, spans = _labelled(known, places)
                begin = 0
                for part in held:
                    own = slice(begin, begin := begin + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns[:keep], pa.array(preds[own], pa.string()), pa.array(scores[own]), pa.array(spans[own], kind)],
                        [*part.schema.names[:keep], "lang_pred", "score", "spans"],
                    )
                held.clear()
                places.clear()
                known.trim()

            for whole in batches:
                for part in steps(whole, text):
                    held.append(part)
                    places.extend(known.places(part.column(text).to_pylist()))
                    # all texts advance together, so many at once cost no more than the longest
                    if sum(map(len, places)) >= PATH_WORDS or len(places) >= 8192:
                        yield from results()
            yield from results()

        return run

    return at


def label_spans(docs: DataFrame, model: LanguageModel, keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all unless told) with lang_pred, score (share of words under lang_pred) and spans of each
    text: word numbers from start to before end, and their language. Columns of docs with these names are replaced."""
    return with_columns(docs, {"lang_pred": "string", "score": "double", "spans": SPANS}, _labeller(model), keep)
