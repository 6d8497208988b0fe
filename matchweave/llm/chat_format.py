"""Chat formatting by token-level assembly: segments are encoded apart and reserved ids are spliced between them.

Template (reserved strings, each one reserved id past the vocabulary):

    <s>                                  once, before a conversation's first turn
    <<SYS>>text<</SYS>>                  system
    [INST]text[/INST]                    user
    text</s>                             assistant
    [ROLE]name[/ROLE]text</s>            any other role (null: the empty name)

A reserved string inside a text or a role name is escaped by a backslash after its first character; such strings that
already hold backslashes there get one more, so the escape can be undone: ``</s>`` becomes ``<\\/s>`` and ``<\\/s>``
becomes ``<\\\\/s>``. Text is encoded with special tokens off, so no text can yield a reserved id either.

The loss mask covers what an assistant writes and the ``</s>`` after it. It is the prefix sum of +1 at the first and -1
past the last token of such segments.

``format_turns`` gives one row per turn, in the order of (conv_id, turn, role, text); a conversation is the
concatenation of its rows. A conversation of any length passes through with one batch of turns in memory.

Defined cases: a null text or role is empty. Rows that share conv_id and turn are turns of their own, nulls first. A
null conv_id is a conversation of its own. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: Reserved strings; the id of the k-th is the vocabulary's size + k.
RESERVED = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
BOS, EOS, INST, INST_END, SYS, SYS_END, ROLE, ROLE_END = range(len(RESERVED))
_ESCAPE = re.compile("|".join(f"({re.escape(s[0])})(\\\\*{re.escape(s[1:])})" for s in RESERVED))
_UNESCAPE = re.compile("|".join(f"({re.escape(s[0])})\\\\(\\\\*{re.escape(s[1:])})" for s in RESERVED))
#: Rows of an Arrow batch are encoded in slices of about so many characters.
SLICE_CHARS = 1 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\".join(x for x in m.groups() if x is not None), text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: "".join(x for x in m.groups() if x is not None), text)


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def _pieces(role: str, text: str) -> list[tuple[int | str, bool]]:
    """Reserved numbers and escaped texts of a turn, each with its loss flag."""
    if role == "user":
        return [(INST, False), (escape(text), False), (INST_END, False)]
    if role == "assistant":
        return [(escape(text), True), (EOS, True)]
    if role == "system":
        return [(SYS, False), (escape(text), False), (SYS_END, False)]
    return [(ROLE, False), (escape(role), False), (ROLE_END, False), (escape(text), False), (EOS, False)]


def assemble(turns: list[list[tuple[int | str, bool]]], path: str = TOKENIZER) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Token ids of all turns in one array, the loss mask, where each turn begins (and the end), the formatted strings."""
    t = _tokenizer(path)
    base = t.get_vocab_size()
    flat = [p for turn in turns for p in turn]
    encoded = iter(t.encode_batch_fast([p for p, _ in flat if isinstance(p, str)], add_special_tokens=False))
    ids = [next(encoded).ids if isinstance(p, str) else [base + p] for p, _ in flat]
    lengths = np.fromiter(map(len, ids), np.int64, len(ids))
    ends = np.cumsum(lengths)
    edges = np.zeros(int(ends[-1]) + 1 if len(ends) else 1, np.int64)
    loss = np.fromiter((x for _, x in flat), bool, len(flat))
    np.add.at(edges, (ends - lengths)[loss], 1)
    np.add.at(edges, ends[loss], -1)
    mask = np.cumsum(edges)[:-1].astype(bool)
    per_turn = np.concatenate([[0], np.cumsum([len(x) for x in turns])]).astype(np.int64)
    bounds = np.concatenate([[0], ends])[per_turn]
    strings = ["".join(p if isinstance(p, str) else RESERVED[p] for p, _ in turn) for turn in turns]
    return np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]) if len(ends) else 0), mask, bounds, strings


def read_turn(ids: list[int], mask: np.ndarray, path: str = TOKENIZER) -> tuple[str, str, str | None]:
    """Role, text and text under the loss mask (None if none) of one turn, decoded from its ids and mask."""
    t = _tokenizer(path)
    base = t.get_vocab_size()
    arr = np.asarray(ids, np.int64)
    marks = np.flatnonzero(arr >= base)
    kinds = [int(arr[k]) - base for k in marks]
    if kinds and kinds[0] == BOS:
        arr, mask, marks, kinds = arr[1:], mask[1:], marks[1:] - 1, kinds[1:]
    text_of = lambda a, b: unescape(t.decode(arr[a:b].tolist(), skip_special_tokens=False))
    if kinds == [ROLE, ROLE_END, EOS]:
        role, body = text_of(1, marks[1]), (marks[1] + 1, marks[2])
    else:
        role, first = {(EOS,): ("assistant", 0), (INST, INST_END): ("user", 1), (SYS, SYS_END): ("system", 1)}[tuple(kinds)]
        body = (first, marks[-1])
    text = text_of(*body)
    if not mask.any():
        return role, text, None
    on = np.flatnonzero(mask & (arr < base))
    return role, text, text_of(on[0], on[-1] + 1) if len(on) else ""


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, n = i, 0
        while j < len(texts) and (j == i or n + len(texts[j]) <= SLICE_CHARS):
            n += len(texts[j])
            j += 1
        yield i, j
        i = j


FORMATTED = "conv_id long, turn long, ids array<int>, loss array<boolean>, formatted string"


def format_turns(conversations: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per turn: conv_id, turn, ids, loss (the mask), formatted. Partitions hold whole conversations in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = ()
        for batch in batches:
            conv, turn = batch.column(0).to_pylist(), batch.column(1)
            roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in _slices(texts):
                turns = []
                for c, role, text in zip(conv[i:j], roles[i:j], texts[i:j], strict=True):
                    turns.append(([(BOS, False)] if c != last else []) + _pieces(role, text))
                    last = c
                ids, mask, bounds, strings = assemble(turns, path)
                off = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), turn.slice(i, j - i), pa.ListArray.from_arrays(off, pa.array(ids)), pa.ListArray.from_arrays(off, pa.array(mask)), pa.array(strings, pa.string())],
                    names=["conv_id", "turn", "ids", "loss", "formatted"],
                )

    empty = F.lit("")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per conversation, read back from the output of ``format_turns`` (whose order it needs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in DIGESTS.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in DIGESTS.split(", ")]
        state: list | None = None

        def rows(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        def closed(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for batch in batches:
            done = []
            ids, loss = batch.column("ids"), batch.column("loss")
            for k, (c, formatted_text) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist(), strict=True)):
                if state is None or state[0] != c:
                    if state is not None:
                        done.append(closed(state))
                    state = [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, under = read_turn(ids[k].values.to_numpy(), loss[k].values.to_numpy(zero_copy_only=False), path)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                if under is not None:
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(formatted_text)
            if done:
                yield rows(done)
        if state is not None:
            yield rows([closed(state)])

    return formatted.mapInArrow(run, DIGESTS)
