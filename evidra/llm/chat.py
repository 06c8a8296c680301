"""Chat formatting by token-level assembly.

Each segment of a turn (role, content) is encoded by itself; ids beyond the vocabulary are spliced in as control
tokens; the loss mask is the prefix sum of +1 and -1 events at the borders of assistant contents. Control strings that
occur in a content are escaped, so the rendered text is read back without doubt.

Defined results: null text or role counts as empty; null turns come first, turns of equal number by role, then text;
repeated rows are turns of their own; an unknown role is written between OPEN and CLOSE and never under the mask; an
empty table gives no rows. Further columns of the input are ignored. Rows of a conversation are sorted in one task but
streamed: only one turn is held at a time, so a very long conversation needs no more memory.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidra.llm._shared import map_batches, strings

# Fixed values of the template: the text that each control token stands for, from id FIRST_CONTROL on.
CONTROL = ["### System: ", "### User: ", "### Assistant: ", "</turn>\n", "### <", ">: "]
ROLES = {"system": 0, "user": 1, "assistant": 2}
END, OPEN, CLOSE = 3, 4, 5
FIRST_CONTROL = 50_257
#: What is escaped in contents: a control string (without the line end), with the backslashes before it.
ESCAPED = re.compile(r"(\\*)(### (?:System|User|Assistant): |</turn>|### <|>: )")

SEGMENTS = "conv_id long, turn_no long, start long, input_ids array<int>, loss_mask array<tinyint>"


def escape(text: str) -> str:
    """Doubles the backslashes before a control string and adds one."""
    return ESCAPED.sub(lambda m: m[1] * 2 + "\\" + m[2], text)


def unescape(text: str) -> str:
    """The inverse of escape()."""
    return ESCAPED.sub(lambda m: m[1][: (len(m[1]) - 1) // 2] + m[2], text)


@lru_cache(maxsize=2)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def assemble(role: str, text: str, enc: tiktoken.Encoding) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the loss mask of one turn."""
    control = lambda k: np.array([FIRST_CONTROL + k], np.int32)
    encode = lambda s: enc.encode_to_numpy(escape(s), disallowed_special=()).astype(np.int32)
    head = [control(ROLES[role])] if role in ROLES else [control(OPEN), encode(role), control(CLOSE)]
    content = encode(text)
    ids = np.concatenate([*head, content, control(END)])
    events = np.zeros(len(ids) + 1, np.int8)
    if role == "assistant":
        first = len(ids) - 1 - len(content)
        events[first] += 1
        events[first + len(content)] -= 1
    return ids, np.cumsum(events[:-1], dtype=np.int8)


def _formatter(path: str):
    def run(batches):
        enc, conv, start, number = encoding(path), object(), 0, 0
        for batch in batches:
            rows = {k: [] for k in ("conv_id", "turn_no", "start", "input_ids", "loss_mask")}
            for key, role, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strings(batch.column(2)), strict=True):
                if key != conv:
                    conv, start, number = key, 0, 0
                ids, mask = assemble(role, text, enc)
                for k, v in zip(rows, (key, number, start, ids, mask), strict=True):
                    rows[k].append(v)
                start, number = start + len(ids), number + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows["conv_id"], pa.int64()), pa.array(rows["turn_no"], pa.int64()), pa.array(rows["start"], pa.int64()), pa.array(rows["input_ids"], pa.list_(pa.int32())), pa.array(rows["loss_mask"], pa.list_(pa.int8()))], list(rows)
            )

    return run


def format_chat(conversations: DataFrame, path: str) -> DataFrame:
    """conversations (conv_id, turn, role, text) as token segments, one row a turn, in order within each partition:
    start is the turn's place in its conversation's sequence. path: a rank file for tiktoken."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    ordered = (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "role", "text")
    )
    return map_batches(ordered, _formatter(path), SEGMENTS)


def render(ids: np.ndarray, enc: tiktoken.Encoding) -> str:
    """The text of a whole sequence or of whole turns; control tokens as their strings."""
    cuts = np.flatnonzero(ids >= FIRST_CONTROL)
    parts, begin = [], 0
    for c in cuts:
        parts += [enc.decode_bytes(ids[begin:c].tolist()).decode(), CONTROL[ids[c] - FIRST_CONTROL]]
        begin = c + 1
    return "".join([*parts, enc.decode_bytes(ids[begin:].tolist()).decode()])


def parse_turn(ids: np.ndarray, mask: np.ndarray, enc: tiktoken.Encoding) -> tuple[str, str, str]:
    """The role and the text of one turn's ids, and the text under its mask, all unescaped."""
    decode = lambda part: unescape(enc.decode_bytes(part.tolist()).decode())
    kind = int(ids[0]) - FIRST_CONTROL
    if kind == OPEN:
        close = int(np.flatnonzero(ids == FIRST_CONTROL + CLOSE)[0])
        role, content = decode(ids[1:close]), ids[close + 1 : -1]
    else:
        role, content = list(ROLES)[kind], ids[1:-1]
    return role, decode(content), decode(ids[mask.astype(bool)])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _reader(path: str):
    def run(batches):
        enc, conv, state = encoding(path), object(), None
        out: list[tuple] = []

        def close():
            if state:
                out.append((conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of():
            columns = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.clear()
            return done

        for batch in batches:
            names = batch.schema.names
            ids, masks = batch.column(names.index("input_ids")), batch.column(names.index("loss_mask"))
            for i, key in enumerate(batch.column(names.index("conv_id")).to_pylist()):
                if key != conv:
                    close()
                    conv, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                seq = ids[i].values.to_numpy(zero_copy_only=False)
                role, text, learned = parse_turn(seq, masks[i].values.to_numpy(zero_copy_only=False), enc)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(learned)
                state[3].update(learned.encode())
                state[4] += len(render(seq, enc))
            yield batch_of()
        close()
        yield batch_of()

    return run


def read_back(segments: DataFrame, path: str) -> DataFrame:
    """What the output of format_chat() says, one row a conversation, read from its ids and masks alone."""
    return map_batches(segments, _reader(path), DIGESTS)
