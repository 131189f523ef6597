"""Chat formatting with offset-aligned loss masks.

Template: each turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside a text every ``<``
that stands before any number of backslashes and a ``|`` gets one more backslash, so a
text never holds a control string and the original is got back exactly; in a role,
backslash and newline are written ``\\\\`` and ``\\n``.

A conversation is rendered whole, encoded once with offsets, and the sorted character
spans of its assistant texts are intersected with the token spans by binary search:
tokens that overlap a span are trained on, and ``loss_spans`` holds the exact
character intervals (tokens that reach over a border are clipped to it).

A conversation of more than ``SEGMENT`` characters is rendered in segments of whole
turns. Turns begin and end with added tokens, at which the encoder always splits, so
the segments' ids are the whole conversation's ids.

Defined results: null role or text is empty; turns are ordered by turn (nulls first),
then role and text, repeated rows are repeated turns; rows with a null conv_id form one
conversation; extra columns are ignored; an empty table gives an empty result.

Scale: one shuffle by conv_id and a sort; a task streams its conversations and holds
one segment at a time, so a conversation with very many turns needs no more memory.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, TRAINED = "<|im_start|>", "<|im_end|>", "assistant"
SEGMENT = 1 << 20
FORMATTED = (
    "conv_id long, segment int, last boolean, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, "
    "loss_mask array<boolean>, loss_spans array<int>"
)


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _role_out(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text of (role, text) turns and the spans of trained texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{_role_out(role)}\n", escape(text)
        if role == TRAINED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text, unescaped."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, body = turn.partition("\n")
        out.append((_role_in(role), unescape(body[: body.rindex(END)])))
    return out


def intersect(spans: Sequence[tuple[int, int]], starts: Sequence[int], ends: Sequence[int]) -> tuple[list[bool], list[int]]:
    """Mask of the tokens that overlap a span, and the covered intervals (start, end, ...).

    Token spans are sorted by start and by end, so each span's tokens are one range."""
    mask, covered = [False] * len(starts), []
    for a, z in spans:
        began = False
        for k in range(bisect_right(ends, a), bisect_left(starts, z)):
            s, e = max(starts[k], a), min(ends[k], z)
            if s >= e:
                continue
            mask[k] = True
            if began and s <= covered[-1]:  # the bytes of one character may be several tokens
                covered[-1] = max(covered[-1], e)
            else:
                covered += [s, e]
                began = True
    return mask, covered


def load(path: str):
    """The tokenizer with the two control strings as added tokens."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import AddedToken, Tokenizer

    t = Tokenizer.from_file(path)
    t.add_special_tokens([AddedToken(START, special=True, normalized=False), AddedToken(END, special=True, normalized=False)])
    return t


def format_conversations(conversations: DataFrame, path: str, segment: int = SEGMENT) -> DataFrame:
    """One row per segment: formatted text, ids, token offsets, loss mask and loss spans."""

    def run(batches):
        import pyarrow as pa

        tokenizer = load(path)
        names = [c.split()[0] for c in FORMATTED.split(", ")]
        ints = pa.list_(pa.int32())
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.string(), ints, ints, ints, pa.list_(pa.bool_()), ints]
        rows, waiting = [], 0

        def flush():
            nonlocal waiting
            texts = [r[3][0] for r in rows]
            made = []
            for (conv, nth, last, (text, spans)), e in zip(rows, tokenizer.encode_batch(texts, add_special_tokens=False)):
                starts, ends = [a for a, _ in e.offsets], [z for _, z in e.offsets]
                mask, covered = intersect(spans, starts, ends)
                made.append((conv, nth, last, text, e.ids, starts, ends, mask, covered))
            rows.clear()
            waiting = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=names)

        conv, turns, size, nth, open_ = None, [], 0, 0, False
        for b in batches:
            for key, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if open_ and (key != conv or size >= segment):
                    rows.append((conv, nth, key != conv, render(turns)))
                    waiting += size
                    nth = 0 if key != conv else nth + 1
                    turns, size = [], 0
                    if waiting >= segment or len(rows) >= 256:
                        yield flush()
                conv, open_ = key, True
                turns.append((role, text))
                size += len(role) + len(text) + len(START) + len(END) + 2
        if open_:
            rows.append((conv, nth, True, render(turns)))
            yield flush()

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    sorted_ = (
        conversations.select("conv_id", "turn", empty("role"), empty("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return sorted_.select("conv_id", "role", "text").mapInArrow(run, FORMATTED)


def digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted rows whose segments follow each other."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def run(batches):
        import pyarrow as pa

        state = None
        for b in batches:
            made = []
            for r in b.to_pylist():
                if r["segment"] == 0:
                    state = [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                text, spans = r["formatted"], r["loss_spans"]
                turns = parse(text)
                state[0] += len(turns)
                state[1].update("".join(f"{role}\n{said}\n" for role, said in turns).encode())
                # intervals that touch belong to one text: unescape over whole texts
                loss = "".join(unescape(text[a:z]) for a, z in zip(spans[::2], spans[1::2]))
                state[2] += len(loss)
                state[3].update(loss.encode())
                for i, n in ((4, len(text)), (5, r["n_ids"]), (6, r["n_loss"])):
                    state[i] += n
                if r["last"]:
                    made.append((r["conv_id"], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))
            if made:
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=[c.split()[0] for c in schema.split(", ")])

    needed = formatted.select("conv_id", "segment", "last", "formatted", "loss_spans", F.size("ids").alias("n_ids"), F.size(F.filter("loss_mask", lambda x: x)).alias("n_loss"))
    # only conversations of several segments have rows to bring together
    alone = (F.col("segment") == 0) & F.col("last")
    ordered = needed.where(~alone).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return needed.where(alone).mapInArrow(run, schema).unionByName(ordered.mapInArrow(run, schema))
