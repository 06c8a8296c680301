"""Packing by lexical retrieval.

Documents become token ids and a closing id. A shard is a run of consecutive rows of a partition, bounded in documents
and tokens; it is packed by itself, so nothing is shuffled and a lost task is simply run again. Of a document longer
than the window, whole windows are cut off first. The shard's remaining pieces get a BM25 inverted index over token ids.
Each seed asks the index for unused neighbours by its rarest terms, again and then by all its terms until the window is
full or no unused piece shares one; the neighbour that crosses the window's end is cut, its rest being the next seed. The last window of a shard is cut into sequences whose lengths are
powers of two, so nothing is padded.

Defined results: a null text counts as empty and is packed as its closing id alone; repeated rows are packed each;
ties go to the earlier row; an empty table gives no rows. Whole texts are packed, and each id lies in exactly one piece.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm._shared import map_batches, strings

WINDOW, CLOSE = 2048, 1
SHARD_DOCS, SHARD_TOKENS = 4096, 6_000_000
#: Query terms of a seed, and neighbours that it asks for at a time.
TERMS, NEIGHBOURS = 16, 12
#: BM25's saturation of term frequency and weight of document length.
K1, B = 1.2, 0.75
#: Fixed value: the vocabulary's one special token, which its text in a document stands for.
SPECIAL = {"<|endoftext|>": 50256}

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers file, with its merges as ranks: a token's rank is its id."""
    import json

    from public_tokenizers import PATTERN

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in SPECIAL}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokens(text: str, enc: tiktoken.Encoding) -> np.ndarray:
    """The ids of a text and the closing id."""
    special = set(SPECIAL) if any(s in text for s in SPECIAL) else set()
    return np.append(enc.encode_to_numpy(text, allowed_special=special, disallowed_special=()), np.uint32(CLOSE)).astype(np.uint32)


class Index:
    """An inverted index over the token ids of a shard's pieces."""

    def __init__(self, pieces: list[np.ndarray]):
        lengths = np.array([len(p) for p in pieces])
        n = len(pieces)
        flat = np.concatenate(pieces).astype(np.uint64) * np.uint64(n) + np.repeat(np.arange(n, dtype=np.uint64), lengths)
        flat = np.sort(flat)
        first = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
        tf = np.diff(np.append(first, len(flat)))
        term, self.doc = (flat[first] // np.uint64(n)).astype(np.int64), (flat[first] % np.uint64(n)).astype(np.int64)
        self.n = n
        df = np.bincount(term)
        self.df, self.begin = df, np.cumsum(df) - df
        self.idf = np.log1p((n - df + 0.5) / (df + 0.5))
        self.weight = self.idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.doc] / lengths.mean()))

    def neighbours(self, seed: np.ndarray, unused: np.ndarray) -> np.ndarray:
        """Unused pieces by falling BM25 score for the seed's rarest shared terms, or for all if no piece has these."""
        terms = np.unique(seed)
        terms = terms[self.df[terms] > 1]
        if len(terms) > TERMS:
            best = self._best(terms[np.argpartition(self.df[terms], TERMS)[:TERMS]], unused)
            if len(best):
                return best
        return self._best(terms, unused)

    def _best(self, terms: np.ndarray, unused: np.ndarray) -> np.ndarray:
        if not len(terms):
            return terms
        begin, size = self.begin[terms], self.df[terms]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        score = np.bincount(self.doc[at], self.weight[at], self.n) * unused
        few = min(NEIGHBOURS, self.n - 1)
        if not few:
            return terms[:0]
        # all above the border score, and at it the earliest rows
        border = max(-np.partition(-score, few - 1)[few - 1], 0.0)
        above = np.flatnonzero(score > border)
        level = np.flatnonzero(score == border)[: few - len(above)] if border else above[:0]
        best = np.concatenate([above, level])
        return best[np.lexsort((best, -score[best]))]


def pack_shard(docs: list[np.ndarray]) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of a shard's documents; sequences are numbered from 0."""
    out, sequence = [], 0
    rest: list[int] = []
    for d, ids in enumerate(docs):
        whole = len(ids) // WINDOW
        for k in range(whole):
            out.append((d, k * WINDOW, WINDOW, sequence, 0))
            sequence += 1
        if len(ids) % WINDOW:
            rest.append(d)
    if not rest:
        return out
    done = np.array([len(docs[d]) // WINDOW * WINDOW for d in rest])
    left = np.array([len(docs[d]) for d in rest]) - done
    pieces = [docs[d][a:] for d, a in zip(rest, done, strict=True)]
    index = Index(pieces)
    unused = np.ones(len(rest), bool)
    following, room, filled = 0, WINDOW, []

    def close():
        nonlocal sequence, room, filled
        for d, start, length, offset in filled:
            out.append((d, start, length, sequence, offset))
        sequence, room, filled = sequence + 1, WINDOW, []

    def put(i: int) -> bool:
        """Puts what is left of piece i into the window, as far as there is room; whether all of it went in."""
        nonlocal room
        take = min(room, int(left[i]))
        filled.append((rest[i], int(done[i]), take, WINDOW - room))
        done[i] += take
        left[i] -= take
        room -= take
        unused[i] = False
        return not left[i]

    seed = -1
    while True:
        if seed < 0:
            while following < len(rest) and not unused[following]:
                following += 1
            if following == len(rest):
                break
            seed = following
        over = -1 if put(seed) else seed
        # whole neighbours first; the best of those that don't fit is cut at the window's end
        large = -1
        while room and large < 0:
            queue = index.neighbours(pieces[seed], unused)
            if not len(queue):
                break
            for i in queue:
                if not room:
                    break
                if left[i] <= room:
                    put(i)
                elif large < 0:
                    large = i
        if room and large >= 0:
            over = -1 if put(large) else large
        if not room:
            close()
            seed = over
        else:
            # no neighbour is left to ask for: the next unused piece goes on with the window
            seed = -1
    if filled:
        total, cuts = WINDOW - room, []
        for bit in reversed(range(total.bit_length())):
            if total >> bit & 1:
                cuts.append((cuts[-1] if cuts else 0) + (1 << bit))
        begin = 0
        for cut in cuts:
            for d, start, length, offset in filled:
                a, b = max(offset, begin), min(offset + length, cut)
                if a < b:
                    out.append((d, start + a - offset, b - a, sequence, a - begin))
            sequence, begin = sequence + 1, cut
    return out


def _packer(path: str):
    """Yields (doc ids, documents' ids, pieces, first sequence id) of each shard."""

    def run(batches):
        enc, partition, number = tokenizer(path), TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        keys, docs, held = [], [], 0
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
                ids = tokens(text, enc)
                keys.append(key)
                docs.append(ids)
                held += len(ids)
                if len(docs) >= SHARD_DOCS or held >= SHARD_TOKENS:
                    pieces = pack_shard(docs)
                    yield keys, docs, pieces, (partition << 40) + number
                    number += 1 + max(p[3] for p in pieces)
                    keys, docs, held = [], [], 0
        if docs:
            yield keys, docs, pack_shard(docs), (partition << 40) + number

    return run


def _rows(path: str, digest: bool):
    def run(batches):
        for keys, docs, pieces, base in _packer(path)(batches):
            for begin in range(0, len(pieces), 4096):
                part = pieces[begin : begin + 4096]
                ids = [docs[d][start : start + length] for d, start, length, _, _ in part]
                last = pa.array([crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()) if digest else pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
                columns = [
                    pa.array([keys[p[0]] for p in part], pa.int64()), *(pa.array([p[k] for p in part], pa.int64()) for k in (1, 2)), pa.array([len(docs[p[0]]) for p in part], pa.int64()),
                    pa.array([base + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64()), last,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids_crc32" if digest else "ids"])

    return run


def pack(docs: DataFrame, path: str, digest: bool = False) -> DataFrame:
    """Pieces of docs (doc_id, text) with their ids, or with the crc32 of the ids (little-endian unsigned 32-bit).
    path: a tokenizers file of a byte-level BPE. sequence_id holds the partition and the number of the sequence in it."""
    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), _rows(path, digest), f"{PIECES}, {'ids_crc32 long' if digest else 'ids array<int>'}")
