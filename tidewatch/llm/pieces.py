"""SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over text boundaries from the left. A boundary keeps its surviving path
only: the best-scoring one for a unigram model; for a BPE model the one whose
neighbouring pieces all stay apart when merged alone, of which every prefix has exactly
one, so the ids are those of the merge procedure. A piece reaches back at most the
longest piece's length, so that many boundaries are alive. Whenever the paths of all of
them go back to one boundary, the ids before it are committed and forgotten.

No piece of a model has a space mark behind another character, so before such a mark
all paths meet; the stretches between these points are searched once and remembered.

Texts come back exactly, also a literal space mark (U+2581), which is written as bytes.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as spm

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
MEMO, NEAR, FITS = 200_000, 800_000, 50_000
#: Stretches of at most so many characters are remembered; the search's window, in lengths of the longest piece.
REMEMBERED, LOOK = 48, 4
ROWS = 512
TRIP = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("ids", pa.list_(pa.int32())),
        ("n_ids", pa.int32()),
        ("decoded_sha256", pa.string()),
        ("round_trip", pa.bool_()),
    ]
)
NORMAL, BYTE, BPE, UNIGRAM = 1, 6, 2, 1


class Memo(dict):
    """Ids by stretch; what is missing is looked for by `find`."""

    older: dict[str, tuple[int, ...]] = {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        return self.find(text)


class Pieces:
    """A lossless SentencePiece vocabulary with byte pieces."""

    def __init__(self, proto: bytes):
        model = spm.ModelProto()
        model.ParseFromString(proto)
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models that keep every character can be used")
        if model.trainer_spec.model_type not in (BPE, UNIGRAM):
            raise ValueError("only BPE and unigram models can be used")
        self.bpe = model.trainer_spec.model_type == BPE
        self.prefix = MARK if spec.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.scores = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces")
        self.octets = [
            bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() if p.type == NORMAL else b""
            for p in model.pieces
        ]
        self.width = max(map(len, self.ids))
        self.unknown = min(self.scores.values(), default=0.0) - 10
        self.named = ["", "", *self.ids]  # pieces by number; 0: begin, 1: a character without a piece
        self.tree: dict = {}  # a piece's characters one by one; its number stands under the key ""
        for number, piece in enumerate(self.ids, 2):
            node = self.tree
            for char in piece:
                node = node.setdefault(char, {})
            node[""] = number
        self._near: dict[int, bool] = {}
        self.stretches = re.compile(self._stretch_pattern()).findall
        self._fit: dict[tuple[str, str], bool] = {}
        self._halves: dict[str, tuple[str, str]] = {}
        self._memo = Memo()
        self._memo.find = self._stretch

    def _stretch_pattern(self) -> str:
        """Stretches no piece crosses the end of: they end before a space mark, around a character
        that no piece has, and before a sign that no piece has behind a letter."""
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            return r"(?s).+"
        pairs = {pair for p in self.ids for pair in zip(p, p[1:])}
        ascii_signs = {c for c in map(chr, range(128)) if not c.isalpha() and c != " "}
        absent = ascii_signs - set("".join(self.ids))
        signs = ascii_signs - absent
        while joined := {b for a, b in pairs if b in signs and a not in signs and a != MARK}:
            signs -= joined
        s, n = (re.escape("".join(sorted(x))) for x in (signs, absent))
        if not (s and n):
            return f"{MARK}*[^{MARK}]+|{MARK}+"
        return f"{MARK}*[{s}]*[^{MARK}{s}{n}]+|{MARK}*[{s}]+|{MARK}+|[{n}]"

    def merged(self, text: str) -> list[str]:
        """Pieces of a text by repeated merging of the best, leftmost pair."""
        parts: list[str | None] = list(text)
        before, behind = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        scores = self.scores
        pairs = [(-scores[a + b], i, a, b) for i, (a, b) in enumerate(zip(text, text[1:])) if a + b in scores]
        heapify(pairs)
        while pairs:
            _, i, a, b = heappop(pairs)
            j = behind[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue  # one of the two has been merged since
            parts[i], parts[j] = a + b, None
            behind[i] = behind[j]
            if behind[i] < len(parts):
                before[behind[i]] = i
            for k in (before[i], i):
                if k >= 0 and behind[k] < len(parts):
                    left, right = parts[k], parts[behind[k]]
                    score = scores.get(left + right)
                    if score is not None:
                        heappush(pairs, (-score, k, left, right))
        return [p for p in parts if p is not None]

    def halves(self, piece: str) -> tuple[str, str]:
        """The two parts of a piece's last merge."""
        found = self._halves.get(piece)
        if found is None:
            parts = list(piece)
            while len(parts) > 2:
                best, at = None, 0
                for k in range(len(parts) - 1):
                    score = self.scores.get(parts[k] + parts[k + 1])
                    if score is not None and (best is None or score > best):
                        best, at = score, k
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if best is None:
                    break
            found = self._halves[piece] = (parts[0], parts[-1])
        return found

    def apart(self, left: str, right: str) -> bool:
        """Whether two neighbours stay the pieces they are; with an empty left one, whether the piece can arise.

        The merges that made them are taken back, the latest first: what then stands at the border
        must not have been merged across it before. Runs of space marks, whose scores are equal,
        and single pieces are merged in full."""
        fit = self._fit.get((left, right))
        if fit is not None:
            return fit
        key = (left, right)
        if not left or MARK + MARK in left + right:
            fit = self.merged(left + right) == ([left, right] if left else [right])
        else:
            scores, limit, fit = self.scores, -math.inf, True
            made_left = scores[left] if len(left) > 1 else math.inf
            made_right = scores[right] if len(right) > 1 else math.inf
            first_of_two = False  # at equal scores the left merge comes first
            while True:
                joint = scores.get(left + right)
                if joint is not None and (joint > limit or (first_of_two and joint == limit)):
                    fit = False
                    break
                if made_left < made_right:
                    limit, first_of_two = made_left, False
                    left = self.halves(left)[1]
                    made_left = scores[left] if len(left) > 1 else math.inf
                elif len(right) > 1:
                    limit, first_of_two = made_right, True
                    right = self.halves(right)[0]
                    made_right = scores[right] if len(right) > 1 else math.inf
                else:
                    break
        if len(self._fit) < FITS:
            self._fit[key] = fit
        return fit

    def search(self, text: str) -> Iterator[list[str]]:
        """Committed pieces of a text in order.

        The window holds the boundaries that are not committed: of each the piece that ends there on
        its surviving path, and where that piece begins. When it is LOOK pieces long, and whenever it
        has grown by another, all paths that are alive are followed back; what lies before the
        boundary where they meet is committed and leaves the window."""
        base, at, look = 0, 0, LOOK * self.width  # the window's first boundary, the next one in it, its length
        last: list[int | None] = [0]
        start, total = [0], [0.0]
        while True:
            part = text[base : base + look + self.width]  # as far as pieces of the window reach
            room = len(part) + 1 - len(last)
            last += [None] * room
            start += [0] * room
            whole = base + len(part) == len(text)
            until = len(part) if whole else look
            if self.bpe:
                self._bpe_steps(part, at, until, last, start)
            else:
                total += [0.0] * room
                self._unigram_steps(part, at, until, last, start, total)
            if whole:
                break
            meet = self._meet(last, start, until)
            if meet:
                yield self._path(part, start, meet)
                del last[:meet], total[:meet]
                start = [x - meet for x in start[meet:]]
                base, at, look = base + meet, until - meet, LOOK * self.width
            else:  # no boundary is common to all paths yet
                at, look = until, look + self.width
            look = max(look, at + self.width)
        if last[-1] is None:  # equal scores of several pieces: the procedure itself decides
            yield self.merged(part)
        else:
            yield self._path(part, start, len(part))

    def _bpe_steps(self, part: str, begin: int, until: int, last: list[int | None], start: list[int]) -> None:
        """Goes on from the boundaries begin to until - 1: a boundary keeps the piece that stays apart from the one before."""
        tree, near, size = self.tree, self._near, len(part)
        for i in range(begin, until):
            left = last[i]
            if left is None:
                continue
            node, j = tree, i
            while j < size and (node := node.get(part[j])) is not None:
                j += 1
                if last[j] is None and (number := node.get("")) is not None:
                    pair = left << 20 | number
                    fits = near.get(pair)
                    if fits is None:
                        if len(near) > NEAR:
                            near.clear()
                        fits = near[pair] = self.apart(self.named[left], self.named[number])
                    if fits:
                        last[j], start[j] = number, i
            if last[i + 1] is None and part[i] not in self.scores:  # a character without a piece
                last[i + 1], start[i + 1] = 1, i

    def _unigram_steps(
        self, part: str, begin: int, until: int, last: list[int | None], start: list[int], total: list[float]
    ) -> None:
        """The same for a unigram model: a boundary keeps the best path."""
        tree, named, scores, size = self.tree, self.named, self.scores, len(part)
        for i in range(begin, until):
            if last[i] is None:
                continue
            node, j = tree, i
            while j < size and (node := node.get(part[j])) is not None:
                j += 1
                number = node.get("")
                if number is not None and (last[j] is None or total[i] + scores[named[number]] > total[j]):
                    last[j], start[j], total[j] = number, i, total[i] + scores[named[number]]
            if part[i] not in scores and (last[i + 1] is None or total[i] + self.unknown > total[i + 1]):
                last[i + 1], start[i + 1], total[i + 1] = 1, i, total[i] + self.unknown

    @staticmethod
    def _meet(last: list[int | None], start: list[int], at: int) -> int:
        """The last boundary of the window that all paths to boundaries from `at` on go through."""
        alive = {k for k in range(at, len(last)) if last[k] is not None}
        while len(alive) > 1:
            far = max(alive)
            alive.remove(far)
            alive.add(start[far])
        return alive.pop() if alive else 0

    @staticmethod
    def _path(part: str, start: list[int], until: int) -> list[str]:
        found = []
        while until > 0:
            found.append(part[start[until] : until])
            until = start[until]
        return found[::-1]

    def _stretch(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch that is not remembered; two generations are, so that what is met again stays."""
        memo = self._memo
        found = memo.older.get(text)
        if found is None:
            out: list[int] = []
            for pieces in self.search(text):
                for piece in pieces:
                    number = self.ids.get(piece)
                    out.extend([number] if number is not None else [self.bytes[b] for b in piece.encode()])
            found = tuple(out)
        if len(text) <= REMEMBERED:
            if len(memo) > MEMO:
                memo.older = dict(memo)
                memo.clear()
            memo[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        for k, part in enumerate(text.split(MARK)):
            if k:
                out.extend(self.bytes[b] for b in MARK.encode())
            marked = (self.prefix if not k else "") + part.replace(" ", MARK)
            out.extend(chain.from_iterable(map(self._memo.__getitem__, self.stretches(marked))))
        return out

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.octets.__getitem__, ids)).decode()
        return text[1:] if self.prefix and text[:1] == " " else text


@lru_cache(maxsize=1)
def load(proto: bytes) -> Pieces:
    """The vocabulary, kept with what it remembers for the next task of the same worker."""
    return Pieces(proto)


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _with(rows: DataFrame, name: str, kind: DataType) -> StructType:
    """The rows' columns and one more, nullable."""
    return StructType([*rows.schema.fields, StructField(name, kind, True)])


def encoded(
    docs: DataFrame, proto: bytes, text_col: str = "text", out_col: str = "ids", check_col: str | None = None
) -> DataFrame:
    """All rows and columns of `docs` with one more: the ids of the whole text (null for null).

    With `check_col` the ids are decoded again in the same pass, and one more column tells whether
    they gave the text back (true for null). An empty text has no ids, rows that repeat stay, an
    empty table gives no rows. Columns that are already called so are replaced."""
    added = [out_col] + ([check_col] if check_col else [])
    rest = docs.drop(*[c for c in added if c in docs.columns])
    at = rest.columns.index(text_col)
    schema = _with(rest, out_col, ArrayType(IntegerType()))
    if check_col:
        schema = StructType([*schema.fields, StructField(check_col, BooleanType(), True)])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto)
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS):
                part = batch.slice(first, ROWS)
                ids, same = [], []
                for value in part.column(at):
                    text = value.as_py()
                    found = None if text is None else pieces.encode(text)
                    ids.append(None if found is None else np.array(found, np.int32))
                    if check_col:
                        same.append(found is None or pieces.decode(found) == text)
                columns = [*part.columns, pa.array(ids, pa.list_(pa.int32()))] + ([pa.array(same, pa.bool_())] if check_col else [])
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, *added])

    return rest.mapInArrow(encode, schema)


def round_trips(docs: DataFrame, proto: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, n_ids, decoded_sha256, round_trip, encoded and decoded in one pass.

    Null texts have null ids and digest and come back as null."""

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows = []
                for value in part.column(1):
                    text = value.as_py()
                    if text is None:
                        rows.append((None, 0, None, True))
                        continue
                    ids = pieces.encode(text)
                    back = pieces.decode(ids)
                    digest = hashlib.sha256(back.encode()).hexdigest()
                    rows.append((np.array(ids, np.int32), len(ids), digest, back == text))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), TRIP.types[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], schema=TRIP)

    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(
        there_and_back, "doc_id bigint, ids array<int>, n_ids int, decoded_sha256 string, round_trip boolean"
    )


def decoded(rows: DataFrame, proto: bytes, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All rows and columns with the text of the ids (null for null); replaces a column of that name."""
    rest = rows.drop(out_col) if out_col in rows.columns else rows
    at = rest.columns.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(proto)
        for batch in batches:
            texts = [pieces.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in batch.column(at)]
            columns = [*batch.columns, pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, out_col])

    return rest.mapInArrow(decode, _with(rest, out_col, StringType()))
