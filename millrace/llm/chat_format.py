"""Chat formatting: render whole conversations, encode once, align the loss mask by offsets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template: what stands before and after a text, by role. Any other role is named between ROLE marks.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, END_ROLE, END_TURN = "[ROLE]", "[/ROLE]", "[/TURN]"
END_OF_TEXT = "<|endoftext|>"
CONTROL = ("<<SYS>>", "<</SYS>>", "<s>", "</s>", "[INST]", "[/INST]", ROLE, END_ROLE, END_TURN, END_OF_TEXT)

#: Conversations that are encoded together.
CHUNK = 64

_REST = r"(s>|/s>|<SYS>>|</SYS>>|\|endoftext\|>|INST\]|/INST\]|ROLE\]|/ROLE\]|/TURN\])"
#: A control string, or one that already has backslashes after its first character.
ESCAPE = r"([<\[])(\\*)" + _REST
_ESCAPE = re.compile(ESCAPE)
_UNESCAPE = re.compile(r"([<\[])\\(\\*)" + _REST)
_MARK = re.compile("|".join(map(re.escape, CONTROL)))


def escape(text: str) -> str:
    """Put one more backslash after the first character of every control string."""
    return _ESCAPE.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the span of each turn's text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        before, after = MARKS.get(role, (f"{ROLE}{escape(role)}{END_ROLE}", END_TURN))
        body = escape(text)
        spans.append((at + len(before), at + len(before) + len(body)))
        parts += (before, body, after)
        at = spans[-1][1] + len(after)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    names = {marks[0]: role for role, marks in MARKS.items()}
    turns, role, start = [], None, 0
    for mark in _MARK.finditer(formatted):
        word = mark[0]
        if word == ROLE:
            start = mark.end()
        elif word == END_ROLE:
            role, start = unescape(formatted[start : mark.start()]), mark.end()
        elif word in names:
            role, start = names[word], mark.end()
        else:
            turns.append((role, unescape(formatted[start : mark.start()])))
    return turns


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap one of the sorted spans; both ends of each run of tokens are found by binary search."""
    mask = np.zeros(len(starts), dtype=bool)
    for a, b in spans:
        if a < b:
            mask[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = True
    return mask


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> list[str]:
    """The text under each unbroken run of masked tokens. Tokens follow each other without gaps; those that share a
    character have the same offsets."""
    edges = np.diff(np.r_[0, mask.astype(np.int8), 0])
    first, last = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    return [formatted[a:b] for a, b in zip(starts[first].tolist(), ends[last].tolist(), strict=True)]


def load_tokenizer(tokenizer_file: str):
    """The tokenizer, with the control strings as tokens of their own, so no token reaches across a mark."""
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in CONTROL])
    return tokenizer


def format_conversations(turns: DataFrame, tokenizer_file: str, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, input_ids, loss_mask, token_start, token_end``.

    ``turns`` has ``conv_id, turn, role, text``; rows go by turn (null first), ties by role and text, repeated rows stay.
    Null role and text count as empty; a null conv_id is a conversation. Offsets are code points of ``formatted``;
    ``loss_mask`` holds for the tokens of texts of ``loss_roles``. The template is for ``parse``, which gives
    the turns back for any texts. A conversation is one row, as it must be encoded in one piece.
    Other columns are ignored; an empty table gives none.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    row = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(tokenizer_file)
        for batch in batches:
            for first in range(0, batch.num_rows, CHUNK):
                yield encode(tokenizer, batch.slice(first, CHUNK))

    def encode(tokenizer, batch: pa.RecordBatch) -> pa.RecordBatch:
        roles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        rendered = [render(list(zip(r, t, strict=True))) for r, t in zip(roles, texts, strict=True)]
        ids, masks, starts, ends = [], [], [], []
        encoded = tokenizer.encode_batch([t for t, _ in rendered], add_special_tokens=False)
        for encoding, said, (_, spans) in zip(encoded, roles, rendered, strict=True):
            offsets = np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
            wanted = [span for role, span in zip(said, spans, strict=True) if role in loss_roles]
            ids.append(np.array(encoding.ids, dtype=np.int32))
            masks.append(mask_tokens(offsets[:, 0], offsets[:, 1], wanted))
            starts.append(offsets[:, 0].copy())
            ends.append(offsets[:, 1].copy())
        lists = [pa.array(x, pa.list_(kind)) for x, kind in ((ids, pa.int32()), (masks, pa.bool_()), (starts, pa.int32()), (ends, pa.int32()))]
        names = ["conv_id", "formatted", "input_ids", "loss_mask", "token_start", "token_end"]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([t for t, _ in rendered], pa.string()), *lists], names=names)

    return whole.mapInArrow(
        run,
        f"conv_id {kind}, formatted string, input_ids array<int>, loss_mask array<boolean>, "
        "token_start array<int>, token_end array<int>",
    )


def conversation_digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from formatted conversations: turns from the template, loss text from the token mask."""
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at in range(batch.num_rows):
                text = batch.column(1)[at].as_py()
                mask, starts, ends = (batch.column(k)[at].values.to_numpy(zero_copy_only=False) for k in range(2, 5))
                turns = parse(text)
                said = "".join(f"{role}\n{words}\n" for role, words in turns)
                loss = "".join(map(unescape, masked_texts(text, starts, ends, mask)))
                digest = (hashlib.sha256(x.encode()).hexdigest() for x in (said, loss))
                rows.append((len(turns), next(digest), len(loss), next(digest), len(text)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return formatted.select("conv_id", "formatted", "loss_mask", "token_start", "token_end").mapInArrow(
        run,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )
