"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered whole and encoded once, with offsets. The spans of the
assistant's texts and the tokens' spans are both sorted, so a binary search finds the
tokens inside each span. Control strings are tokens of their own, so no token crosses
a span's edge; where they stand in a role or text they are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import AddedToken, Tokenizer, processors

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, TEXT, CLOSE = "<turn>", "<text>", "</turn>"
#: Escapes of a backslash and of every string the tokenizer reads as control.
CONTROLS = (OPEN, TEXT, CLOSE, "<|endoftext|>")
CODES = {control: f"\\{i};" for i, control in enumerate(CONTROLS)}
PLAIN = {code: control for control, code in CODES.items()} | {"\\\\": "\\"}
ESCAPED = re.compile("|".join(map(re.escape, PLAIN)))
TURN = re.compile(f"(?s){OPEN}(.*?){TEXT}(.*?){CLOSE}")
LEARNED = "assistant"
FORMATTED = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("formatted", pa.string()),
        ("ids", pa.list_(pa.int32())),
        ("begins", pa.list_(pa.int32())),
        ("ends", pa.list_(pa.int32())),
        ("mask", pa.list_(pa.bool_())),
    ]
)
FORMATTED_DDL = (
    "conv_id bigint, formatted string, ids array<int>, begins array<int>, ends array<int>, mask array<boolean>"
)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for control, code in CODES.items():
        text = text.replace(control, code)
    return text


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: PLAIN[m[0]], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation, and the spans of its learned texts in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        body = escape(text)
        head = f"{OPEN}{escape(role)}{TEXT}"
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def load_tokenizer(definition: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(definition)
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (OPEN, TEXT, CLOSE)])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)
    return tokenizer


def mask_of(begins: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for tokens wholly inside one of the sorted spans."""
    mask = np.zeros(len(begins), bool)
    if spans:
        edges = np.array(spans)
        first = np.searchsorted(begins, edges[:, 0], "left")
        past = np.searchsorted(ends, edges[:, 1], "right")
        for lo, hi in zip(first, past):
            mask[lo:hi] = True
    return mask


def learned_text(formatted: str, begins: list[int], ends: list[int], mask: list[bool]) -> str:
    """All text under the mask, unescaped, turn by turn."""
    out, at = [], 0
    while at < len(mask):
        if not mask[at]:
            at += 1
            continue
        until = at
        while until + 1 < len(mask) and mask[until + 1]:
            until += 1
        out.append(unescape(formatted[begins[at] : ends[until]]))
        at = until + 1
    return "".join(out)


def parsed(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in TURN.findall(formatted)]


def format_chats(conversations: DataFrame, tokenizer_path: str = TOKENIZER) -> DataFrame:
    """One row per conversation: conv_id, formatted, ids, begins, ends, mask (offsets in code points).

    Rows go by turn (null first), then role and text, so repeated rows all stay; null roles and
    texts are empty; rows without a conv_id are one conversation; an empty text or conversation
    gives no tokens under the mask; other columns are never read."""
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = conversations.groupBy(F.col("conv_id").cast("bigint").alias("conv_id")).agg(
        F.array_sort(F.collect_list(turn)).alias("turns")
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(definition)
        for batch in batches:
            # A few conversations at a time: offsets of a whole batch would be large.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                made = [render([(t["role"], t["text"]) for t in turns.as_py()]) for turns in part.column(1)]
                codes = tokenizer.encode_batch([text for text, _ in made], add_special_tokens=False)
                rows = []
                for (text, spans), code in zip(made, codes):
                    offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
                    begins, ends = offsets[:, 0], offsets[:, 1]
                    rows.append((text, code.ids, begins, ends, mask_of(begins, ends, spans)))
                columns = [part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), FORMATTED.types[1:]))]
                yield pa.RecordBatch.from_arrays(columns, schema=FORMATTED)

    return chats.select("conv_id", F.expr("transform(turns, t -> struct(t.role, t.text))").alias("turns")).mapInArrow(
        formatted, FORMATTED_DDL
    )


DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
DIGESTS_DDL = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns, and the text under the mask."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, text, begins, ends, mask in zip(*batch.columns):
                formatted = text.as_py()
                turns = parsed(formatted)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                offsets = (x.values.to_numpy(zero_copy_only=False).tolist() for x in (begins, ends, mask))
                learned = learned_text(formatted, *offsets)
                shas = [hashlib.sha256(t.encode()).hexdigest() for t in (whole, learned)]
                rows.append((conv_id.as_py(), len(turns), shas[0], len(learned), shas[1], len(formatted)))
            columns = list(zip(*rows)) or [()] * len(DIGESTS)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, DIGESTS.types)], schema=DIGESTS)

    return chats.select("conv_id", "formatted", "begins", "ends", "mask").mapInArrow(read_back, DIGESTS_DDL)
