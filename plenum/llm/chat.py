"""Chat formatting in budgeted windows of whole turns, with loss masks that can be read back.

A turn is `<turn role="R">`, its text and `</turn>` on lines of their own; in roles and texts a
backslash stands before each backslash, `<` and `"`, so no text can hold a mark. Windows are
chosen by the running sums of turn tokens, marks included: each begins with the system turn and
the last few turns of the window before (marked `repeated`, never under the loss mask), then takes
new turns while the budget lasts. Where the next turn does not fit behind what is repeated, the
repeated turns go, oldest first, and at last the system turn.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plenum.llm.wordcache import ByteLevelEncoder

TURN = re.compile(r'<turn role="((?:[^"\\]|\\.)*)"( repeated)?>\n((?:[^<\\]|\\.)*)\n</turn>\n', re.S)
WINDOWS = "conv_id long, window long, text string, loss array<struct<start:int,end:int>>, n_tokens long, n_new long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def escape(s: str) -> str:
    return re.sub(r'[\\<"]', r"\\\g<0>", s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


END = "\n</turn>\n"


def whole(role: str, body: str, repeated: bool = False) -> str:
    """A turn with its marks; role and body are escaped already."""
    return f'<turn role="{role}"{" repeated" if repeated else ""}>\n{body}{END}'


def schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<struct<start:int,end:int>>": pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def windows(turns: DataFrame, tokenizer_path: str, budget: int = 1024, history: int = 2) -> DataFrame:
    """turns(conv_id, turn, role, text) to windows; loss: spans of `text` that are targets.

    Null roles and texts count as empty; rows of one conversation go by turn (null first), then
    role and text, repeated rows each a turn. Null conv_id is a conversation too. Other columns
    are not looked at; an empty table gives no window. n_tokens is what the tokenizer makes of the
    whole window, at most `budget`: only a single turn that is over the budget by itself exceeds
    it, in a window of its own, whole. Turns are formatted and counted where they are read; only
    the walk along a conversation is sequential, and it holds one window at a time.
    """
    formatted = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("body", pa.string()), ("n", pa.int64()), ("again", pa.int64())])

    def mark(batches):
        encoder, more = ByteLevelEncoder(tokenizer_path), {}
        for batch in batches:
            conv, turn, role, text = (batch.column(k).to_pylist() for k in range(4))
            roles, bodies = [escape(r) for r in role], [escape(t) for t in text]
            n = [len(x) // 4 for x in encoder.encode_all([whole(r, b) for r, b in zip(roles, bodies)])]
            for r in set(roles) - more.keys():  # what the word `repeated` costs depends on the role alone
                plain, repeated = (len(x) // 4 for x in encoder.encode_all([whole(r, ""), whole(r, "", True)]))
                more[r] = repeated - plain
            again = [k + more[r] for k, r in zip(n, roles)]
            more = more if len(more) < 10_000 else {}
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip((conv, turn, roles, bodies, n, again), formatted)], schema=formatted)

    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).mapInArrow(mark, "conv_id long, turn long, role string, body string, n long, again long")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "body")
    out_schema = schema(WINDOWS)

    def cut(batches):
        out: dict[str, list] = {n: [] for n in out_schema.names}
        conv, begun = None, False
        number, system, past, new, spent = 0, None, deque(), [], 0

        def close():
            nonlocal number, new, spent
            text, at, loss, total = [], 0, [], 0
            for (role, body, n, again), repeated in [*((t, True) for t in past), *((t, False) for t in new)]:
                text.append(whole(role, body, repeated))
                if role == "assistant" and not repeated:
                    end = at + len(text[-1]) - len(END)
                    loss.append({"start": end - len(body), "end": end})
                at += len(text[-1])
                total += again if repeated else n
            for name, value in zip(out, (conv, number, "".join(text), loss, total, len(new))):
                out[name].append(value)
            kept = [t for t in [*past, *new] if t is not system][-history:] if history else []
            while kept and sum(t[3] for t in kept) > budget // 2:
                kept.pop(0)
            past.clear()
            past.extend([system] if system else [])
            past.extend(kept)
            number, new, spent = number + 1, [], sum(t[3] for t in past)

        for batch in batches:
            for c, *turn in zip(batch.column(0).to_pylist(), *(batch.column(k).to_pylist() for k in range(2, 6))):
                if not begun or c != conv:
                    if new:
                        close()
                    conv, begun, number, system, new, spent = c, True, 0, None, [], 0
                    past.clear()
                if new and spent + turn[2] > budget:
                    close()
                while past and spent + turn[2] > budget:  # the system turn stands first and goes last
                    gone = past[1] if past[0] is system and len(past) > 1 else past[0]
                    past.remove(gone)
                    spent -= gone[3]
                if turn[0] == "system" and number == 0 and not new and system is None:
                    system = turn
                new.append(turn)
                spent += turn[2]
            if len(out["conv_id"]) >= 200:
                yield pa.RecordBatch.from_pydict(out, schema=out_schema)
                out = {n: [] for n in out_schema.names}
        if new:
            close()
        yield pa.RecordBatch.from_pydict(out, schema=out_schema)

    return rows.mapInArrow(cut, WINDOWS)


def read_back(formatted: DataFrame) -> DataFrame:
    """The windows of windows(), in any order, to a digest a conversation (null: one too)."""
    formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    out_schema = schema(DIGEST)

    def read(batches):
        out: dict[str, list] = {n: [] for n in out_schema.names}
        conv, begun = None, False
        state: list = []

        def close():
            n, turns, chars, loss, size, k = state
            for name, value in zip(out, (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, k)):
                out[name].append(value)

        for batch in batches:
            for c, text, spans in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                if not begun or c != conv:
                    if begun:
                        close()
                    conv, begun, state = c, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                at = 0
                while at < len(text):
                    m = TURN.match(text, at)
                    if m is None:
                        raise ValueError("a window is not made of whole turns")
                    if not m[2]:
                        state[0] += 1
                        state[1].update(f"{unescape(m[1])}\n{unescape(m[3])}\n".encode())
                    at = m.end()
                for s in spans:
                    target = unescape(text[s["start"] : s["end"]])
                    state[2] += len(target)
                    state[3].update(target.encode())
                state[4] += len(text)
                state[5] += 1
            if len(out["conv_id"]) >= 1000:
                yield pa.RecordBatch.from_pydict(out, schema=out_schema)
                out = {n: [] for n in out_schema.names}
        if begun:
            close()
        yield pa.RecordBatch.from_pydict(out, schema=out_schema)

    return formatted.mapInArrow(read, DIGEST)
