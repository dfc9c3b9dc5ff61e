"""Chat formatting: conversations become token-budgeted windows with a loss mask.

Template of a turn: `### role: text</turn>` and a line end. In roles and texts the control strings are written
`\\h` (for ###), `\\e` (for </turn>), `\\c` (a colon, roles only) and a backslash is doubled, so no text can look like a
mark and reading back is exact.

A window is a run of whole turns. Prefix sums of the turns' tokens give the longest run that fits what the budget leaves
after the system turn and the repeated history. A turn that is longer than that fills a window alone, marked
`over_budget`. Assistant texts that were a target in an earlier window are masked where they are repeated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gridpulse.llm.common import key_groups
from gridpulse.llm.tokens import DEFAULT_RANKS, encoder

OPEN, CLOSE = "### ", "</turn>\n"
_TO = {"\\": "\\\\", "###": "\\h", "</turn>": "\\e", ":": "\\c"}
_FROM = {"\\": "\\", "h": "###", "e": "</turn>", "c": ":"}
_TURN = re.compile(r"### ([^:]*): (.*?)</turn>\n", re.S)


def escape(text: str, role: bool = False) -> str:
    return re.sub(r"\\|###|</turn>|:" if role else r"\\|###|</turn>", lambda m: _TO[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _FROM[m[1]], text, flags=re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


@dataclass(frozen=True)
class Budget:
    tokens: int = 1024
    history_turns: int = 2
    history_share: float = 0.25
    block_turns: int = 512


def spans(tokens: np.ndarray, fixed: int, budget: Budget) -> list[tuple[int, int, int]]:
    """(history start, start, end) of each window over turns with these token counts; `fixed` tokens go to the system turn."""
    prefix = np.concatenate([[0], np.cumsum(tokens)])
    out, start = [], 0
    while start < len(tokens):
        back = start
        room = budget.tokens - fixed
        while back > 0 and start - back < budget.history_turns and prefix[start] - prefix[back - 1] <= budget.history_share * room:
            back -= 1
        room -= prefix[start] - prefix[back]
        end = max(start + 1, int(np.searchsorted(prefix, prefix[start] + room, side="right")) - 1)
        if end == start + 1 and tokens[start] > room:
            back = start  # a long turn does without history
            end = max(end, int(np.searchsorted(prefix, prefix[start] + budget.tokens - fixed, side="right")) - 1)
        out.append((back, start, min(end, len(tokens))))
        start = out[-1][2]
    return out


_SCHEMA = (
    "conv_id long, block long, window int, formatted string, n_turns int, first_new int, loss_start array<int>, "
    "loss_end array<int>, tokens int, over_budget boolean"
)
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()),
    ("n_turns", pa.int32()), ("first_new", pa.int32()), ("loss_start", pa.list_(pa.int32())),
    ("loss_end", pa.list_(pa.int32())), ("tokens", pa.int32()), ("over_budget", pa.bool_()),
])


def _windows(group: pa.Table, count, budget: Budget) -> list[dict]:
    """Windows of one block. Its first row may be a system turn repeated from an earlier block (rank 0)."""
    rows = group.to_pylist()
    carried = rows[0]["rank"] == 0
    turns = []
    for r in rows:
        head = f"{OPEN}{escape(r['role'], role=True)}: "
        turns.append((r["role"], head, escape(r["text"])))
    tokens = np.array([count(h + t + CLOSE) for _, h, t in turns])
    lead = int(carried or turns[0][0] == "system")
    fixed = int(tokens[:lead].sum())
    out = []
    for w, (back, start, end) in enumerate(spans(tokens[lead:], fixed, budget) or [(0, 0, 0)]):
        shown = [(i, not carried and w == 0) for i in range(lead)]
        shown += [(i + lead, i >= start) for i in range(back, end)]
        parts, starts, ends, at = [], [], [], 0
        for i, new in shown:
            role, head, body = turns[i]
            if new and role == "assistant":
                starts.append(at + len(head))
                ends.append(at + len(head) + len(body))
            parts.append(head + body + CLOSE)
            at += len(parts[-1])
        total = fixed + int(tokens[lead + back : lead + end].sum())
        new = [i for i, (_, n) in enumerate(shown) if n]
        repeated = [i for i, (_, n) in enumerate(shown) if not n]
        out.append({
            "conv_id": rows[0]["conv_id"], "block": rows[0]["block"], "window": w, "formatted": "".join(parts),
            "n_turns": len(shown), "first_new": len(repeated), "loss_start": starts, "loss_end": ends,
            "tokens": total, "over_budget": total > budget.tokens,
        })
        assert new == list(range(len(repeated), len(shown))), "repeated turns come first"
    return out


def format_chats(conversations: DataFrame, budget: Budget = Budget(), ranks: str = DEFAULT_RANKS) -> DataFrame:
    """One row per window: conv_id, block, window, formatted, n_turns, first_new, loss spans in code points, tokens, over_budget.

    Rows (conv_id, turn, role, text) are ordered by turn, then role and text. NULL roles and texts count as empty, a NULL
    turn sorts first, a NULL conv_id is a conversation of its own; repeated rows are turns like others. Extra columns are not
    carried. An empty table gives no rows. A conversation is cut into blocks of `block_turns` turn numbers, so that a
    very long one is spread over many tasks; history is not repeated across blocks, the system turn is.
    """
    rows = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / budget.block_turns), F.lit(-(2**40))).cast("long").alias("block"),
    )
    blocks = rows.groupBy("conv_id", "block").agg(
        F.min(F.when(F.col("role") == "system", F.struct("turn", "role", "text"))).alias("system"))
    order = Window.partitionBy("conv_id").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("conv_id", "block", F.min("system").over(before).alias("s")).where("s is not null").select(
        "conv_id", "s.turn", "s.role", "s.text", "block", F.lit(0).alias("rank"))
    both = rows.withColumn("rank", F.lit(1)).unionByName(carried)
    dealt = both.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "rank", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(ranks).count
        held: list[dict] = []
        for group in key_groups(batches, ["conv_id", "block"]):
            held += _windows(group, count, budget)
            if len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, schema=_ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=_ARROW)

    return dealt.mapInArrow(run, _SCHEMA)


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(windows: DataFrame) -> DataFrame:
    """Read the windows back: every turn once (repeated ones skipped) and all text under the loss mask, hashed as a stream."""
    dealt = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                            ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        done: list[tuple] = []
        last, state = object(), None

        def close():
            n, turns, chars, loss, size = state
            done.append((last, n, turns.hexdigest(), chars, loss.hexdigest(), size))

        for batch in batches:
            for r in batch.to_pylist():
                if r["conv_id"] != last:
                    if state:
                        close()
                    last, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                new = read_turns(r["formatted"])[r["first_new"]:]
                state[0] += len(new)
                for role, text in new:
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                for a, b in zip(r["loss_start"], r["loss_end"]):
                    text = unescape(r["formatted"][a:b])
                    state[2] += len(text)
                    state[3].update(text.encode("utf-8", "surrogatepass"))
                state[4] += len(r["formatted"])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if state:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

    return dealt.mapInArrow(run, _DIGEST)
