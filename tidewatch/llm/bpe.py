"""BPE encoding and decoding by a deterministic automaton over tokens.

The automaton reads tokens. It begins with the single bytes, of which any may follow any.
Each merge (a, b), in order of rank, then adds a gadget: a new arc for the token ab, and a
bar between what ends with an a that is still whole and what begins with a b that is still
whole, for there the merge would have been made. After the last merge a sequence of tokens
runs through the automaton exactly if it is the encoding of its text.

A token's state is fixed by the chain of right parts it was merged from, and what its arc
asks for by the chain of left parts. Tokens are numbered in both trees of parts so that
the tokens a gadget touches are neighbours: a gadget is one rectangle of (last token, next
token), and a state keeps the sorted edges of the stretches of arcs it bars.

A word is encoded from the left: the table of the tokens' bytes gives the arcs that its next
bytes spell, the state tells which of them are barred, and the longest open one that leads
on to the word's end is taken. Their ids are the encoding. Decoding writes the arcs' labels.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: What a worker remembers: encoded words, each at most so many characters long.
WORDS, LONGEST_KEPT = 400_000, 40
#: Tokens a task hands on at once, but for a longer text's own.
HANDED = 1 << 20


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is
    printable Latin-1, else the next free character from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    letters, free = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in letters:
            letters[b], free = chr(free), free + 1
    return [letters[b] for b in range(256)]


def split_pattern(tokenizer: Tokenizer, until: int = 0x110000) -> str:
    """The pre-splitting of a byte-level tokenizer as a pattern, for texts of code points below `until`.

    Letters, numbers and white space are taken from how the library itself splits the whole
    code space, so that both agree about every character, whatever their Unicode versions."""
    cut = tokenizer.pre_tokenizer.pre_tokenize_str
    kinds: dict[str, list[str]] = {"a": [], "1": [], "!": [], "": []}
    for page in range(0, until, 0x8000):
        space = "".join(chr(c) for c in range(page, min(page + 0x8000, until)) if not 0xD800 <= c < 0xE000)
        for _, (begin, end) in cut(space):
            if space[begin] == " " and end - begin > 1:  # a blank goes with what follows it
                kinds[""].append(r"\ ")
                begin += 1
            joined = next(k for k in kinds if not k or len(cut(k + space[begin])) == 1)
            kinds[joined].append(f"\\U{ord(space[begin]):08x}-\\U{ord(space[end - 1]):08x}")
    letter, number, _, blank = ("".join(k) for k in kinds.values())
    return (
        f" ?[{letter}]++| ?[{number}]++|'(?:[stmd]|re|ve|ll)| ?[^{blank}{letter}{number}]++|[{blank}]+(?![^{blank}])|[{blank}]+"
    )


def _preorder(part: list[int], latest_first: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all tokens in the forest of parts, and the number behind each token's subtree.

    Children made by later merges come first, so the tokens below a part whose own merge is
    later than a given rank are a stretch that begins with the part itself."""
    first, behind = np.zeros(len(part), np.int32), np.zeros(len(part), np.int32)
    count = 0
    for root in (t for t in range(len(part)) if part[t] < 0):
        todo = [(root, False)]
        while todo:
            token, left = todo.pop()
            if left:
                behind[token] = count
                continue
            first[token] = count
            count += 1
            todo.append((token, True))
            todo.extend((child, False) for child in reversed(latest_first[token]))
    return first, behind


class Automaton:
    """Arcs labelled with tokens, states that bar stretches of arcs, and the bytes' table."""

    def __init__(self, definition: str, pattern: str | None = None):
        tokenizer = Tokenizer.from_str(definition)
        spec = json.loads(definition)
        model, splitter = spec["model"], spec["pre_tokenizer"] or {}
        if model["type"] != "BPE" or splitter.get("type") != "ByteLevel" or spec["normalizer"] or spec["truncation"] or spec["padding"]:
            raise ValueError("only plain byte-level BPE definitions can be used")
        if splitter["add_prefix_space"] or not splitter["use_regex"]:
            raise ValueError("only definitions that split by words and add no space can be used")
        if model.get("dropout") or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            raise ValueError("only definitions that apply every merge can be used")
        self.pattern = pattern or split_pattern(tokenizer)
        self._words = re.compile(self.pattern).findall
        self._latin_words = re.compile(split_pattern(tokenizer, 256)).findall  # the same, with small character sets
        self._compile(model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]])
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("only added tokens that stand for themselves can be used")
        self.added = {t["content"]: t["id"] for t in added}
        longest_first = sorted(self.added, key=len, reverse=True)
        self.controls = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")").split if added else None
        self.labels.update({t["id"]: t["content"].encode() for t in added})
        self._known: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def _compile(self, vocab: dict[str, int], merges: list[list[str]]) -> None:
        octet = {letter: bytes([b]) for b, letter in enumerate(byte_letters())}
        names = list(octet)  # tokens in order of making: the bytes, then the merges
        number = {name: k for k, name in enumerate(names)}
        left, right, rank = [-1] * 256, [-1] * 256, [-1] * 256
        made: list[tuple[int, int, int, int]] = []  # rank, a, b, token
        ranks: dict[tuple[int, int], int] = {}

        def meets(a: int, b: int) -> bool:
            """Whether a before b stay whole until all merges so far are done."""
            x, until = a, len(merges)  # x: what ends a, merged into something greater at `until`
            while x >= 0:
                y, after = b, len(merges)
                while y >= 0:
                    r = ranks.get((x, y))
                    if r is not None and r < until and r <= after:
                        return False
                    y, after = left[y], rank[y]
                x, until = right[x], rank[x]
            return True

        for r, (a, b) in enumerate(merges):
            x, y = number.get(a), number.get(b)
            if x is None or y is None or not meets(x, y):
                continue  # earlier merges always part them: no such token ever arises
            if a + b in number:
                raise ValueError("two merges make the same token")
            token = number[a + b] = len(names)
            ranks[x, y] = r
            names.append(a + b)
            left.append(x)
            right.append(y)
            rank.append(r)
            made.append((r, x, y, token))
        below_left: list[list[int]] = [[] for _ in names]
        below_right: list[list[int]] = [[] for _ in names]
        for _, a, b, token in reversed(made):
            below_left[a].append(token)
            below_right[b].append(token)
        row, row_end = _preorder(right, below_right)
        column, column_end = _preorder(left, below_left)

        # One gadget for each merge: rows are the tokens that end with a whole a, columns those
        # that begin with a whole b. Of two equal merges that overlap the left one comes first,
        # so at equal rank the right token is barred and the left one is not.
        opened: list[list[tuple[int, int]]] = [[] for _ in range(len(names) + 1)]
        closed: list[list[tuple[int, int]]] = [[] for _ in range(len(names) + 1)]
        for r, a, b, _ in made:
            rows = self._stretch(row, row_end, below_right[a], rank, a, r + 1)
            columns = self._stretch(column, column_end, below_left[b], rank, b, r)
            opened[rows[0]].append(columns)
            closed[rows[1]].append(columns)
        # From row to row: the stretches barred there, joined. Equal neighbours share a state.
        live: dict[tuple[int, int], int] = {}
        states, edges = np.zeros(len(names), np.int32), [[]]
        for at in range(len(names)):
            if opened[at] or closed[at]:
                for stretch in closed[at]:
                    live[stretch] -= 1
                    if not live[stretch]:
                        del live[stretch]
                for stretch in opened[at]:
                    live[stretch] = live.get(stretch, 0) + 1
                joined: list[int] = []
                for begin, until in sorted(live):
                    if joined and begin <= joined[-1]:
                        joined[-1] = max(joined[-1], until)
                    else:
                        joined += [begin, until]
                edges.append(joined)
            states[at] = len(edges) - 1
        self.bars = [edges[k] for k in states[row]]  # of each token's state; a word's begin bars nothing
        self.asks = column.tolist()

        self.ids = [vocab[name] for name in names]
        spelled = [b"".join(map(octet.__getitem__, name)) for name in names]
        self.labels = {i: b"".join(map(octet.__getitem__, name)) for name, i in vocab.items() if octet.keys() >= set(name)}
        # The bytes' table: by byte the token that ends there (or -1), what its arc asks for, and the next bytes.
        self.root: dict[int, tuple[int, int, dict]] = {}
        for token, label in sorted(enumerate(spelled), key=lambda t: len(t[1])):
            nodes = self.root
            for b in label[:-1]:
                nodes = nodes.setdefault(b, (-1, 0, {}))[2]
            nodes[label[-1]] = (token, self.asks[token], nodes[label[-1]][2] if label[-1] in nodes else {})

    @staticmethod
    def _stretch(first, behind, children: list[int], rank: list[int], part: int, least: int) -> tuple[int, int]:
        """Numbers of the part and of all below it that merges of rank `least` or later have made."""
        until = first[part] + 1
        for child in children:  # the latest first
            if rank[child] < least:
                break
            until = behind[child]
        return int(first[part]), int(until)

    def words(self, text: str) -> list[str]:
        latin = len(text.encode("latin-1", "ignore")) == len(text)
        return self._latin_words(text) if latin else self._words(text)

    def may_follow(self, last: int, token: int) -> bool:
        return not bisect_right(self.bars[last], self.asks[token]) & 1

    def path(self, word: bytes) -> list[int]:
        """Ids of one pre-split word: the arcs from its begin to its end.

        A boundary has at most one path that leads to it, so one that leads nowhere is left for good."""
        size, at, edges, dead = len(word), 0, [], set()
        root, bars = self.root, self.bars
        arcs: list[int] = []
        waiting: list[tuple[int, list]] = []  # boundaries on the path, with the shorter arcs not yet tried
        while at < size:
            open_arcs, nodes, until = [], root, at
            while until < size and (node := nodes.get(word[until])) is not None:
                token, ask, nodes = node
                until += 1
                if token >= 0:
                    open_arcs.append((until, token, ask))
            while True:
                while open_arcs:
                    until, token, ask = open_arcs.pop()
                    if until not in dead and not bisect_right(edges, ask) & 1:
                        break
                else:
                    dead.add(at)
                    at, open_arcs = waiting.pop()
                    arcs.pop()
                    edges = bars[arcs[-1]] if arcs else []
                    continue
                break
            waiting.append((at, open_arcs))
            arcs.append(token)
            at, edges = until, bars[token]
        return list(map(self.ids.__getitem__, arcs))

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word, remembered in two generations, so that what is met again stays."""
        ids = self._known.get(word)
        if ids is None:
            ids = self._older.get(word)
            if ids is None:
                ids = tuple(self.path(word.encode()))
                if len(word) > LONGEST_KEPT:
                    return ids
            if len(self._known) >= WORDS:
                self._older, self._known = self._known, {}
            self._known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for k, part in enumerate(self.controls(text) if self.controls else (text,)):
            if k & 1:
                ids.append(self.added[part])
            else:
                ids.extend(chain.from_iterable(map(self._word, self.words(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, one after another; bytes that are no text become U+FFFD."""
        return b"".join(map(self.labels.__getitem__, ids)).decode(errors="replace")


@lru_cache(maxsize=1)
def load(definition: str, pattern: str) -> Automaton:
    """The automaton, kept with what it remembers for the next task of the same worker."""
    return Automaton(definition, pattern)


def read_definition(path: str = TOKENIZER) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def _replaced(rows: DataFrame, name: str, kind: DataType) -> tuple[DataFrame, StructType]:
    """The rows without a column of that name, and their schema with it at the end."""
    rest = rows.drop(name) if name in rows.columns else rows
    return rest, StructType([*rest.schema.fields, StructField(name, kind, True)])


def encoded(docs: DataFrame, definition: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """All rows and columns of `docs` with the ids of the whole text; null and empty texts have none.

    Rows that repeat stay, an empty table gives no rows, and a column that is already called
    `out_col` is replaced."""
    rest, schema = _replaced(docs, out_col, ArrayType(IntegerType()))
    at, pattern = rest.columns.index(text_col), split_pattern(Tokenizer.from_str(definition))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(definition, pattern)
        for batch in batches:
            for part, ids in _handed(batch, at, automaton):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], schema.names)

    return rest.mapInArrow(encode, schema)


def _handed(batch: pa.RecordBatch, at: int, automaton: Automaton) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of a batch with their texts' ids, each of about HANDED tokens."""
    first, ids, size = 0, [], 0
    for k, text in enumerate(batch.column(at)):
        ids.append(np.array(automaton.encode(text.as_py() or ""), np.int32))
        size += len(ids[-1])
        if size >= HANDED:
            yield batch.slice(first, len(ids)), ids
            first, ids, size = k + 1, [], 0
    if ids:
        yield batch.slice(first, len(ids)), ids


def decoded(rows: DataFrame, definition: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """All rows and columns with the text of the ids (null for null); replaces a column of that name."""
    rest, schema = _replaced(rows, out_col, StringType())
    at, pattern = rest.columns.index(ids_col), split_pattern(Tokenizer.from_str(definition))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(definition, pattern)
        for batch in batches:
            for k in range(batch.num_rows):  # a row at a time: texts of a whole batch may be large
                part = batch.slice(k, 1)
                ids = part.column(at)[0]
                text = automaton.decode(ids.values.to_numpy().tolist()) if ids.is_valid else None
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([text], pa.string())], schema.names)

    return rest.mapInArrow(decode, schema)


def round_trips(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, decoded; encoded and decoded in one pass.

    Null texts are empty, and an empty text has no ids and comes back empty; ids may be null or
    repeat; an empty table gives no rows; other columns are never read."""
    pattern = split_pattern(Tokenizer.from_str(definition))

    def there_and_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(definition, pattern)
        for batch in batches:
            for part, ids in _handed(batch, 1, automaton):
                back = pa.array([automaton.decode(i.tolist()) for i in ids], pa.string())
                columns = [part.column(0), pa.array(ids, pa.list_(pa.int32())), back]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    rows = docs.select(docs[f"`{id_col}`"].cast("bigint").alias("doc_id"), docs[f"`{text_col}`"].alias("text"))
    return rows.mapInArrow(there_and_back, "doc_id bigint, ids array<int>, decoded string")


def digests(trips: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of round trips."""
    return trips.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
