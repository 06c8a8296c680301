"""Byte-level BPE encoding and decoding by DuckDB's recursive queries, one engine a Python worker.

Texts are cut by the vocabulary's pattern; each distinct word that a worker has not met is contracted by a recursive
query: token-position rows join the merge table, the leftmost pair of minimum rank of each word is merged, until no
word has a pair. A word that is a token itself is that token. Decoding joins ids with the vocabulary and concatenates by
an ordered aggregation.

A word of over LONG bytes is cut into chunks, which are contracted side by side. Where two meet, tokens on either side are
contracted again as one piece, more of them until the piece ends in tokens that its neighbours don't pull apart. This is
exact: token by token a sequence is the contraction of its text if each two neighbours, by themselves, are contracted to
just these two. (Before a first merge over a border, all tokens grow as they do alone; that merge would come first in the
text of the two tokens at this border as well.)

Defined results: a null text counts as empty, and empty texts have no ids; repeated rows get equal ids. Whole texts are
read. The engine spills to the task's own temporary folder and holds no state that a lost executor would take along.
"""

from __future__ import annotations

import base64
import hashlib
import re
import tempfile

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame

from evidra.llm._shared import grouped, map_batches, strings

#: Bytes of a word that is contracted as a whole, and of a chunk.
LONG = 64
SPACED = re.compile(r"\s | \s| \0")
#: Marks the first piece of a text, which has no space before it; only for look-ups. SPACED keeps others from having it.
FIRST = "\0"
#: Words whose ids a worker keeps, and the rows that a call of either query gets at most (beyond one text or word).
MEMO_WORDS, MEMO_BYTES, QUERY_ROWS = 500_000, 48 << 20, 400_000
MEMORY = "300MB"
#: Texts that are encoded at once, and bytes of text: each call of the queries has a cost of its own.
TEXTS, TEXT_BYTES = 2048, 8_000_000

#: A word's tokens are a list; its positions, as rows, join the merge table.
CONTRACT = """
WITH RECURSIVE step(w, l, n) AS (
    SELECT w, list(t ORDER BY p), 0 FROM state GROUP BY w
    UNION ALL
    SELECT s.w, s.l[: x.p - 1] || [x.c] || s.l[x.p + 2 :], s.n + 1
    FROM step s JOIN (
        SELECT y.w, min(m.c) AS c, min_by(y.p, m.c::BIGINT << 32 | y.p) AS p
        FROM (SELECT w, unnest(l[:-2]) AS a, unnest(l[2:]) AS b, generate_subscripts(l[2:], 1) AS p FROM step WHERE len(l) > 1) y
        JOIN merges m ON m.a = y.a AND m.b = y.b
        GROUP BY y.w
    ) x ON x.w = s.w
)
SELECT w, max_by(l, n) AS l FROM step GROUP BY w ORDER BY w
"""
DECODE = "SELECT d, string_agg(v.piece, '' ORDER BY i) AS s FROM ids JOIN vocab v USING (t) GROUP BY d"


class Engine:
    """DuckDB with the merge table and the vocabulary of a rank file."""

    def __init__(self, path: str):
        import duckdb
        from public_tokenizers import PATTERN

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.pattern = regex.compile(PATTERN)
        self.bytes = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        pairs = [(self.ranks[k[:i]], self.ranks[k[i:]], v) for k, v in self.ranks.items() for i in range(1, len(k)) if k[:i] in self.ranks and k[i:] in self.ranks]
        merges = np.array(pairs, np.int32).reshape(-1, 3)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": tempfile.gettempdir(), "preserve_insertion_order": False})
        self._table("merges", {"a": merges[:, 0], "b": merges[:, 1], "c": merges[:, 2]})
        self.db.register("pieces", pa.table({"t": pa.array(list(self.ranks.values()), pa.int32()), "piece": [k.decode("latin-1") for k in self.ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM pieces")
        self.db.unregister("pieces")
        self.raw = {v: k for k, v in self.ranks.items()}
        self.words: dict[str, bytes] = {}
        self.meet: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, bytes] = {}
        self.held = 0

    def _table(self, name: str, columns: dict[str, np.ndarray]) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _positions(self, words: list[bytes]) -> dict[str, np.ndarray]:
        lengths = np.array([len(w) for w in words])
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        p = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return {"w": w, "p": p.astype(np.int32), "t": self.bytes[np.frombuffer(b"".join(words), np.uint8)]}

    def contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word, by merges alone."""
        out, begin, size = [], 0, 0
        for i, word in enumerate(words, 1):
            size += len(word)
            if size > QUERY_ROWS or i == len(words):
                self.db.register("state", pa.table(self._positions(words[begin:i])))
                lists = self.db.execute(CONTRACT).to_arrow_table().column("l").combine_chunks()
                self.db.unregister("state")
                flat, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
                out += [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                begin, size = i, 0
        return out

    def _apart(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Of pairs of tokens whether their text is contracted to just these two."""
        if len(self.meet) > MEMO_WORDS:
            self.meet = {}
        new = list({p for p in pairs if p not in self.meet})
        for p, ids in zip(new, self.contract([self.raw[a] + self.raw[b] for a, b in new]), strict=True):
            self.meet[p] = tuple(ids.tolist()) == p
        return [self.meet[p] for p in pairs]

    def _seams(self, sides: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> list[tuple[int, np.ndarray] | None]:
        """Of neighbouring parts of a word how many tokens at their border were contracted again, and to what; None if
        more than most on either side would have to be."""
        found: list[tuple[int, np.ndarray] | None] = [None] * len(sides)
        todo, k = [i for i, m in enumerate(most) if m > 0], 1
        while todo:
            pieces = self.contract([b"".join(map(self.raw.__getitem__, [*sides[i][0][-k:].tolist(), *sides[i][1][:k].tolist()])) for i in todo])
            ends = []
            for i, piece in zip(todo, pieces, strict=True):
                left, right = sides[i]
                if len(left) > k:
                    ends.append((i, (int(left[-k - 1]), int(piece[0]))))
                if len(right) > k:
                    ends.append((i, (int(piece[-1]), int(right[k]))))
            bad = {i for (i, _), apart in zip(ends, self._apart([p for _, p in ends]), strict=True) if not apart}
            for i, piece in zip(todo, pieces, strict=True):
                if i not in bad:
                    found[i] = (k, piece)
            k *= 2
            todo = [i for i in todo if i in bad and k <= most[i]]
        return found

    def contract_long(self, words: list[bytes], chunk: int = LONG) -> list[np.ndarray]:
        """As contract(), by chunks. First all borders at once, each with less than half of the chunks beside it; the few
        that need more are then joined two by two."""
        cut = [[w[i : i + chunk] for i in range(0, len(w), chunk)] for w in words]
        parts, found = [], iter(self.contract([c for p in cut for c in p]))
        for p in cut:
            parts.append([next(found) for _ in p])
        half = lambda x: (len(x) - 1) // 2
        seams = iter(self._seams([(a, b) for p in parts for a, b in zip(p, p[1:], strict=False)], [min(half(a), half(b)) for p in parts for a, b in zip(p, p[1:], strict=False)]))
        for n, p in enumerate(parts):
            joined, now, taken = [], [], 0
            for i, ids in enumerate(p):
                seam = next(seams) if i + 1 < len(p) else None
                now.append(ids[taken : len(ids) - (seam[0] if seam else 0)])
                if seam:
                    now.append(seam[1])
                    taken = seam[0]
                else:
                    joined.append(np.concatenate(now))
                    now, taken = [], 0
            parts[n] = joined
        while any(len(p) > 1 for p in parts):
            sides = [(p[i], p[i + 1]) for p in parts for i in range(0, len(p) - 1, 2)]
            seams = iter(self._seams(sides, [2 * max(len(a), len(b)) for a, b in sides]))
            for n, p in enumerate(parts):
                joined = []
                for i in range(0, len(p) - 1, 2):
                    k, piece = next(seams)
                    joined.append(np.concatenate([p[i][: max(len(p[i]) - k, 0)], piece, p[i + 1][k:]]))
                parts[n] = joined + p[len(joined) * 2 :]
        return [p[0] for p in parts]

    def learn(self, words: list[str]) -> None:
        """Puts the ids of new words into the memo, as little-endian unsigned 32-bit integers."""
        raws = [w.encode("utf-8", "surrogatepass") for w in words]
        known = [self.ranks.get(r) for r in raws]
        self.words.update((w, k.to_bytes(4, "little")) for w, k in zip(words, known, strict=True) if k is not None)
        for contract, mine in ((self.contract, lambda n: n <= LONG), (self.contract_long, lambda n: n > LONG)):
            rest = [(w, r) for w, r, k in zip(words, raws, known, strict=True) if k is None and mine(len(r))]
            self.words.update((w, ids.astype("<u4").tobytes()) for (w, _), ids in zip(rest, contract([r for _, r in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers.

        Where no run of white space has a space and something else, a text's words never reach over a space but for
        their first character: then pieces between spaces are looked up as a whole, with the space before them (but
        for the first piece, which is kept with a mark of its own)."""
        if len(self.pieces) > MEMO_WORDS or len(self.words) > MEMO_WORDS or self.held > MEMO_BYTES:
            self.pieces, self.words, self.held = {}, {}, 0
        get = self.pieces.get
        pieces = [[FIRST + t] if SPACED.search(t) else (FIRST + t).split(" ") for t in texts]
        found = [list(map(get, p)) for p in pieces]
        gaps = [k for k, f in enumerate(found) if None in f]
        new = {x for k in gaps for x, ids in zip(pieces[k], found[k], strict=True) if ids is None}
        split = {x: self.pattern.findall(x[1:] if x[:1] == FIRST else " " + x) for x in new}
        words = list({w for ws in split.values() for w in ws if w not in self.words})
        self.held += sum(map(len, words)) + sum(map(len, split))
        self.learn(words)
        ids = self.words.__getitem__
        fresh = {x: b"".join(map(ids, ws)) for x, ws in split.items()}
        for k in gaps:
            found[k] = [fresh[x] if ids is None else ids for x, ids in zip(pieces[k], found[k], strict=True)]
        self.pieces.update((x, y) for x, y in fresh.items() if len(x) <= LONG and x[:1] != FIRST)
        return [b"".join(f) for f in found]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids."""
        arrays = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
        out = [b""] * len(ids)
        lengths = np.array([len(a) for a in arrays])
        begin = 0
        while begin < len(arrays):
            end = begin + max(1, int(np.searchsorted(np.cumsum(lengths[begin:]), QUERY_ROWS, side="right")))
            n = lengths[begin:end]
            d = np.repeat(np.arange(begin, end, dtype=np.int32), n)
            if len(d):
                self.db.register("ids", pa.table({"d": d, "i": np.arange(len(d), dtype=np.int32), "t": np.concatenate(arrays[begin:end])}))
                for k, s in self.db.execute(DECODE).fetchall():
                    out[k] = s.encode("latin-1")
                self.db.unregister("ids")
            begin = end
        return out


_ENGINES: dict[str, Engine] = {}


def engine(path: str) -> Engine:
    if path not in _ENGINES:
        _ENGINES[path] = Engine(path)
    return _ENGINES[path]


def _encoder(path: str, keep: int):
    def run(batches):
        bpe = engine(path)
        for batch in grouped(batches, TEXTS, TEXT_BYTES):
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe.encode(strings(part.column(keep)))]
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], pa.array(ids, pa.list_(pa.int32()))], [*part.schema.names[:keep], "ids"])

    return run


def encode(docs: DataFrame, path: str, *carry: Column) -> DataFrame:
    """The carried columns and ids (array<int>) of each text."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema)
    return map_batches(docs.select(*carry, "text"), _encoder(path, len(carry)), f"{fields}, ids array<int>")


def _list_bytes(column: pa.Array) -> list[bytes]:
    flat, cuts = column.values.to_numpy(zero_copy_only=False).astype("<u4"), column.offsets.to_numpy()
    return [flat[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]


def _decoder(path: str, keep: int):
    def run(batches):
        bpe = engine(path)
        for batch in batches:
            for begin in range(0, len(batch), TEXTS):
                part = batch.slice(begin, TEXTS)
                raw = bpe.decode(_list_bytes(part.column(keep)))
                yield pa.RecordBatch.from_arrays([*part.columns[:keep], part.column(keep), pa.array(raw, pa.binary())], [*part.schema.names[:keep], "ids", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, *carry: Column) -> DataFrame:
    """The carried columns, ids and decoded (binary) of rows with ids."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*carry).schema)
    return map_batches(encoded.select(*carry, "ids"), _decoder(path, len(carry)), f"{fields}, ids array<int>, decoded binary")


def _digests(path: str):
    """Encodes, decodes and digests a batch without a way back through the JVM."""
    steps = (_encoder(path, 1), _decoder(path, 1))

    def run(batches):
        for batch in steps[1](steps[0](batches)):
            ids = _list_bytes(batch.column(1))
            sha = lambda values: pa.array([hashlib.sha256(v).hexdigest() for v in values])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(batch.column(2).to_pylist())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    return run


def digests(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, the digest of the ids and the digest of what they decode to, of each text."""
    return map_batches(docs.selectExpr("cast(doc_id as long) doc_id", "text"), _digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
