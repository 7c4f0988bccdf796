"""Main-text extraction by the order of suffixes of a host's word streams, checked against page structure.

Pages are read into blocks with the place each stood in. The suffixes of all pages' words
are sorted host by host to the depth of a run of RUN words; neighbours that agree and come
from distinct pages mark words that the host repeats. A block goes if most of its words are
marked, unique runs stay. Structure then checks that decision: paragraphs of an article are
put back (articles are quoted and mirrored in full), and what a page's own structure names
as menus, adverts and the like goes, as does text outside of an article where there is one.

A suffix is sorted by the name of its host and first run, a fingerprint instead of the rank that
prefix doubling gives it in `repeated`: equal runs are neighbours in either order. Pages travel
in chunks of bounded size; a chunk sorts its own suffixes and sends each distinct name once to
the part that owns the name's range, the part sorts them and answers with one bit a name. On
hosts with a page that marks can change, runs of shared names are then sorted and compared as
texts in the same way. So neither the host's size nor the place of a page matters, and no task
gets a whole host. `repeated` marks the same words in memory; tests compare both.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from tidewatch.llm.common import broadcast_if_small, checkpointed

RUN = 5
COVERED = 0.8
PART_BYTES = 1 << 22
PART_HTML = 1 << 26  # html whose names one part of their order gets, about; there are at least 64 parts
NAME_BITS = 40

# Element and class names of HTML pages.
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
PARAGRAPHS = {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "pre", "td", "th", "dt", "dd", "figcaption", "caption"
}
BLOCKS = PARAGRAPHS | {
    "address", "article", "aside", "body", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer",
    "form", "head", "header", "hgroup", "hr", "html", "main", "menu", "nav", "ol", "optgroup", "option", "section",
    "select", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
TEMPLATE = {"nav", "menu", "aside", "footer", "form", "head", "dialog", "select", "button", "label", "fieldset"}
TEMPLATE_NAMES = {
    "ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "cookie", "cookies", "consent", "disqus", "footer", "header", "masthead", "menu", "modal", "nav", "navbar",
    "navigation", "newsletter", "notice", "notices", "popup", "promo", "related", "share", "sharing", "sidebar",
    "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
COMMENT_NAMES = {"comment", "comments", "disqus", "replies", "reply", "respond"}
TEMPLATE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "form"}

DROPPED, LOOSE, SOFT, FIRM = range(4)
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<close>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]+|<)",
    re.S,
)
NAMED = re.compile(r"""(?i)\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""")
CLOSE = {name: re.compile(rf"(?is)</{name}\s*>") for name in RAW}


def _names(attrs: str) -> tuple[set[str], set[str]]:
    """Words of the class and id, and of the role."""
    words: tuple[set[str], set[str]] = set(), set()
    for kind, value in NAMED.findall(attrs) if attrs else ():
        words[kind.lower() == "role"].update(re.split(r"[^a-z0-9]+", value.strip("\"'").lower()))
    return words


def _is_template(name: str, attrs: str, in_article: bool) -> bool:
    if name in TEMPLATE or (name == "header" and not in_article):
        return True
    words, roles = _names(attrs)
    if words & COMMENT_NAMES:
        return True
    if name in ("html", "body", "article", "main"):
        return False
    return bool((words - {"header"} if in_article else words) & TEMPLATE_NAMES or roles & TEMPLATE_ROLES)


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, place) of every block with text: DROPPED by structure, LOOSE outside an article,
    SOFT inside one, FIRM in a paragraph of one. Text of a template's inline elements (a button, an
    inline advert) is left out of the block it stands in. Character references are decoded and white
    space is one space. Unclosed and stray tags are taken as browsers take them, roughly: a tag that
    never ends takes the rest of the page."""
    out: list[tuple[str, int]] = []
    stack: list[tuple[str, int, bool]] = []  # element, place of its text, whether readers wrote it
    texts: list[str] = []

    def block_place() -> int:
        """The place of the block that is open: of the last element that is no inline one."""
        return next((place for name, place, _ in reversed(stack) if name in BLOCKS), LOOSE)

    def end_block() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            texts.clear()
            if text:
                out.append((text, block_place()))

    at = 0
    while match := PIECE.match(page, at):
        at = match.end()
        text = match["text"]
        if text is not None:
            if not stack or stack[-1][1] != DROPPED or block_place() == DROPPED:
                texts.append(text)
            continue
        name = (match["name"] or "").lower()
        if not name:
            continue
        if name in ("br", "wbr"):
            texts.append(" " if name == "br" else "")
            continue
        if name in RAW:
            if not match["close"]:
                end = CLOSE[name].search(page, at)
                at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            end_block()
        if match["close"]:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == name:
                    if name not in BLOCKS and any(s[0] in BLOCKS for s in stack[depth + 1 :]):
                        break  # a stray end tag of an inline element
                    del stack[depth:]
                    break
            continue
        if name in VOID or match["attrs"].endswith("/"):
            continue
        if name in BLOCKS:
            # A paragraph ends where the next block begins; inline elements left open end with it.
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == "p" or (name == "li" and stack[depth][0] == "li"):
                    del stack[depth:]
                    break
                if stack[depth][0] in BLOCKS:
                    break
        place = stack[-1][1] if stack else LOOSE
        readers = bool(stack and stack[-1][2]) or bool(_names(match["attrs"])[0] & COMMENT_NAMES)
        if name in ("article", "main"):
            # A new article begins here even if a menu or advert before it was never closed.
            nested = place == DROPPED and any(s[0] in ("article", "main") for s in stack)
            place = DROPPED if nested or readers else SOFT
        elif place != DROPPED:
            inside = place in (SOFT, FIRM)
            if _is_template(name, match["attrs"], inside):
                place = DROPPED
            elif inside and name in PARAGRAPHS:
                place = FIRM
        stack.append((name, place, readers))
    end_block()
    return out


def repeated(streams: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """By page, which of its words lie in a run of `run` words that a distinct page has too.

    The pages' streams are joined, with a word of its own behind each; suffixes are ranked by
    doubling up to `run` words, and equal ranks from distinct pages are repeated runs."""
    numbers: dict[str, int] = {}
    sizes = np.array([len(s) for s in streams], np.int64)
    total = int(sizes.sum()) + len(streams)
    rank, page = np.empty(total, np.int64), np.repeat(np.arange(len(streams)), sizes + 1)
    at = 0
    for i, words in enumerate(streams):
        rank[at : at + len(words)] = [numbers.setdefault(w, len(numbers)) for w in words]
        rank[at + len(words)] = -1 - i
        at += len(words) + 1
    rank = np.unique(rank, return_inverse=True)[1]
    single, depth = rank, 1
    while depth < run:
        step = depth if 2 * depth <= run else 1
        other = rank if step == depth else single
        behind = np.zeros(total, np.int64)
        behind[:-depth] = other[depth:] + 1
        rank = np.unique(rank * (total + 1) + behind, return_inverse=True)[1]
        depth += step
    order = np.argsort(rank, kind="stable")  # the suffixes, sorted by their first words
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))
    shared = np.minimum.reduceat(page[order], first) < np.maximum.reduceat(page[order], first)
    starts = np.flatnonzero(shared[rank])
    edge = np.zeros(total + run, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + run, -1)
    marked = np.cumsum(edge)[:total] > 0
    cuts = np.cumsum(sizes + 1)
    return [marked[c - s - 1 : c - 1] for c, s in zip(cuts, sizes)]


def main_text(texts: list[str], places: list[int], marked: np.ndarray) -> str:
    """The blocks that stay, one a line: what the host does not repeat, checked against structure."""
    if not texts:
        return ""
    sizes = np.array([text.count(" ") + 1 for text in texts])
    unique = np.add.reduceat(marked, np.cumsum(sizes) - sizes, dtype=np.int64) / sizes < COVERED
    loose = SOFT if any(p in (SOFT, FIRM) for p in places) else LOOSE
    return "\n".join(t for t, p, own in zip(texts, places, unique) if p == FIRM or (own and p == loose))


def is_open(places: list[int]) -> bool:
    """Whether runs change what structure says about any block of the page."""
    return (SOFT in places) or (LOOSE in places and FIRM not in places)


PAGE = pa.schema(
    [
        ("page_id", pa.string()), ("url", pa.string()), ("host", pa.string()),
        ("texts", pa.list_(pa.string())), ("places", pa.list_(pa.int8())),
    ]
)


def _surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hosts of pages that runs change, and the bytes of html beside a null host."""
    for batch in batches:
        hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
        found = {h for h, page in zip(hosts, pages) if is_open([p for _, p in blocks(page or "")])}
        n = [0] * len(found) + [sum(len(page or "") for page in pages)]
        yield pa.RecordBatch.from_arrays([pa.array([*found, None], pa.string()), pa.array(n, pa.int64())], ["host", "n"])


def _chunks(part_bytes: int):
    """(open, pages, chunk) of about `part_bytes` of text or one page: a compressed Arrow stream and its digest.

    Equal chunks share their digest and their answers, which are the same."""

    def chunk(is_open: bool, rows: list[tuple]) -> pa.RecordBatch:
        pages = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PAGE)], schema=PAGE)
        sink = pa.BufferOutputStream()
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))
        with pa.ipc.new_stream(sink, PAGE, options=options) as out:
            out.write_batch(pages)
        stream = sink.getvalue().to_pybytes()
        arrays = [pa.array([is_open], pa.bool_()), *(pa.array([b], pa.binary()) for b in (stream, hashlib.sha256(stream).digest()))]
        return pa.RecordBatch.from_arrays(arrays, ["open", "pages", "chunk"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple]] = {False: [], True: []}
        size = {False: 0, True: 0}
        for batch in batches:
            for page_id, url, host, at, page in zip(*(batch.column(c) for c in ("page_id", "url", "host", "open", "html"))):
                at, found = at.as_py(), blocks(page.as_py() or "")
                row = (page_id.as_py(), url.as_py(), host.as_py(), [t for t, _ in found], [p for _, p in found])
                held[at].append(row)
                size[at] += sum(len(t) for t in row[3]) + 64
                if size[at] >= part_bytes:
                    yield chunk(at, held[at])
                    held[at], size[at] = [], 0
        for at, rows in held.items():
            if rows:
                yield chunk(at, rows)

    return run


def _unpacked(chunk: pa.Buffer) -> dict[str, list]:
    return pa.ipc.open_stream(chunk).read_all().to_pydict()


def _of_two_pages(order: np.ndarray, first: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Which groups of equals, that begin at `first` in order, stand on more than one page."""
    if not len(first):
        return np.zeros(0, bool)
    return np.minimum.reduceat(page[order], first) < np.maximum.reduceat(page[order], first)


class Suffixes:
    """The suffixes of a chunk's pages in the order of their names.

    `names` are the distinct names in order, `cuts` where the parts begin and end among them, `shared`
    tells which of them two pages of the chunk have; `starts` are the suffixes, `page` their pages and
    `name_of` their names' places."""

    def __init__(self, hosts: list[str], texts: list[list[str]], part_bits: int, name_bits: int = NAME_BITS):
        words = [" ".join(t).split(" ") if t else [] for t in texts]
        self.hosts, self.words = hosts, np.array([w for p in words for w in p], object)
        self.sizes = np.array([len(w) for w in words], np.int64)
        page = np.repeat(np.arange(len(words)), self.sizes)
        self.starts = np.flatnonzero(np.arange(len(page)) + RUN <= np.cumsum(self.sizes)[page])
        self.page = page[self.starts]
        names = self._named() >> np.uint64(64 - name_bits)
        order = np.argsort(names)
        new = np.diff(names[order], prepend=np.uint64(0)) != 0
        new[:1] = True
        first = np.flatnonzero(new)
        self.name_of = np.empty(len(order), np.int64)
        self.name_of[order] = np.cumsum(new) - 1
        self.names = names[order[first]]
        self.parts = (self.names >> np.uint64(name_bits - part_bits)).astype(np.int64)
        self.cuts = np.searchsorted(self.parts, np.arange((1 << part_bits) + 1))
        self.shared = _of_two_pages(order, first, self.page)

    def _named(self) -> np.ndarray:
        """A fingerprint of each suffix's host and first run."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        hashed = pd.util.hash_array(self.words)
        name = pd.util.hash_array(np.array(self.hosts, object))[self.page]
        for at in range(RUN):
            name = (name ^ (name >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + hashed[self.starts + at]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            name = (name ^ (name >> np.uint64(shift))) * np.uint64(by)
        return name ^ (name >> np.uint64(31))

    def marked(self, repeat: np.ndarray) -> list[np.ndarray]:
        """By page, which of its words lie in the first run of a suffix that repeats."""
        begun = self.starts[repeat]
        edge = np.zeros(len(self.words) + RUN + 1, np.int64)
        np.add.at(edge, begun, 1)
        np.add.at(edge, begun + RUN, -1)
        words = np.cumsum(edge) > 0
        return [words[end - size : end] for size, end in zip(self.sizes, np.cumsum(self.sizes))]


class Runs:
    """The first runs of the suffixes whose names are shared, as texts behind their host.

    `texts` are the distinct ones in order by part, `cuts` where the parts begin and end among them, `shared`
    tells which of them two pages of the chunk have; `suffixes` are the suffixes and `run_of` their runs' places."""

    def __init__(self, found: Suffixes, shared: np.ndarray):
        self.suffixes = np.flatnonzero(shared[found.name_of])
        page, starts = found.page[self.suffixes], found.starts[self.suffixes]
        texts = [f"{found.hosts[p]}\n{' '.join(found.words[s : s + RUN])}" for p, s in zip(page.tolist(), starts.tolist())]
        code, texts = pd.factorize(np.array(texts, object), sort=True)
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        part = found.parts[found.name_of[self.suffixes[order[first]]]]
        by_part = np.argsort(part, kind="stable")
        place = np.empty(len(by_part), np.int64)
        place[by_part] = np.arange(len(by_part))
        self.run_of = place[code]
        self.texts, self.shared = texts[by_part], _of_two_pages(order, first, page)[by_part]
        self.cuts = np.searchsorted(part[by_part], np.arange(len(found.cuts)))


def _packed(names: np.ndarray) -> bytes:
    """Names of a part as gaps, whose two low bytes do not compress."""
    gaps = np.diff(names, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return gaps[:, :2].tobytes() + pa.compress(gaps[:, 2:].T.tobytes(), codec="zstd", asbytes=True)


def _unpacked_names(packed: bytes, n: int) -> np.ndarray:
    gaps = np.empty((n, 8), np.uint8)
    gaps[:, :2] = np.frombuffer(packed, np.uint8, 2 * n).reshape(n, 2)
    gaps[:, 2:] = np.frombuffer(pa.decompress(packed[2 * n :], 6 * n, codec="zstd"), np.uint8).reshape(6, n).T
    return np.cumsum(gaps.view("<u8").ravel(), dtype=np.uint64)


def _by_part(chunk: pa.Scalar, cuts: np.ndarray, pack, kind: pa.DataType) -> pa.RecordBatch:
    """(part, chunk, n, sent) of each part that a chunk sends something to."""
    parts = np.flatnonzero(np.diff(cuts))
    sent = [pack(slice(cuts[p], cuts[p + 1])) for p in parts]
    arrays = [
        pa.array(parts, pa.int32()), pa.array([chunk.as_py()] * len(parts), pa.binary()),
        pa.array(np.diff(cuts)[parts], pa.int32()), pa.array(sent, kind),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["part", "chunk", "n", "sent"])


def _names_of_chunks(part_bits: int, name_bits: int = NAME_BITS):
    """Each chunk's distinct names, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pages in zip(batch.column("chunk"), batch.column("pages")):
                pages = _unpacked(pages.as_buffer())
                found = Suffixes(pages["host"], pages["texts"], part_bits, name_bits)
                yield _by_part(chunk, found.cuts, lambda at, found=found: _packed(found.names[at]), pa.binary())

    return run


def _answers(sent: pa.Table, shared: np.ndarray) -> pa.Table:
    bits = [np.packbits(s).tobytes() for s in np.split(shared, np.cumsum(sent.column("n").to_numpy())[:-1])]
    return pa.table([sent.column("chunk"), sent.column("part"), pa.array(bits, pa.binary())], ["chunk", "part", "bits"])


def _neighbours(order: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Which have an equal neighbour in order; hence from another chunk, which sends each once."""
    shared = np.zeros(len(order), bool)
    shared[order[1:][equal]] = True
    shared[order[:-1][equal]] = True
    return shared


def _compared_names(sent: pa.Table) -> pa.Table:
    """A part's names in order: which of them have an equal neighbour, as bits by chunk."""
    names = np.concatenate([_unpacked_names(p.as_py(), n) for p, n in zip(sent.column("sent"), sent.column("n").to_numpy())])
    order = np.argsort(names)
    return _answers(sent, _neighbours(order, np.diff(names[order]) == 0))


def _compared_runs(sent: pa.Table) -> pa.Table:
    """A part's runs in order: which of them have an equal neighbour, as bits by chunk."""
    runs = pc.list_flatten(sent.column("sent").combine_chunks())
    order = pc.sort_indices(runs)
    runs = runs.take(order)
    equal = pc.equal(runs[1:], runs[:-1]).to_numpy(zero_copy_only=False)
    return _answers(sent, _neighbours(order.to_numpy(), equal))


def _with_bits(shared: np.ndarray, cuts: np.ndarray, answers: list[dict] | None) -> np.ndarray:
    """What a chunk shares, by itself or as the parts answered."""
    if len(answers or ()) < np.count_nonzero(np.diff(cuts)):
        raise RuntimeError("the pages changed while they were read")
    shared = shared.copy()
    for answer in answers or ():
        a, b = cuts[answer["part"]], cuts[answer["part"] + 1]
        shared[a:b] |= np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=b - a).astype(bool)
    return shared


def _runs_of_chunks(part_bits: int, name_bits: int):
    """The distinct runs of shared names of chunks of open hosts, by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for is_open, chunk, pages, answers in zip(*(batch.column(c) for c in ("open", "chunk", "pages", "answers"))):
                if is_open.as_py():
                    pages = _unpacked(pages.as_buffer())
                    found = Suffixes(pages["host"], pages["texts"], part_bits, name_bits)
                    runs = Runs(found, _with_bits(found.shared, found.cuts, answers.as_py()))
                    yield _by_part(chunk, runs.cuts, lambda at, runs=runs: runs.texts[at], pa.list_(pa.string()))

    return run


def _marked_pages(batch: pa.RecordBatch, part_bits: int, name_bits: int) -> Iterator[tuple[dict[str, list], list[np.ndarray]]]:
    """A chunk's pages, and by page which of its words the host repeats."""
    for is_open, pages, answers, checked in zip(*(batch.column(c) for c in ("open", "pages", "answers", "checked"))):
        pages = _unpacked(pages.as_buffer())
        found = Suffixes(pages["host"], pages["texts"], part_bits, name_bits)
        shared = _with_bits(found.shared, found.cuts, answers.as_py())
        repeat = shared[found.name_of]
        if is_open.as_py():
            runs = Runs(found, shared)
            repeat[runs.suffixes] = _with_bits(runs.shared, runs.cuts, checked.as_py())[runs.run_of]
        yield pages, found.marked(repeat)


def _marks(part_bits: int, name_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, marked in _marked_pages(batch, part_bits, name_bits):
                arrays = [pa.array(pages[f.name], f.type) for f in PAGE]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(marked, pa.list_(pa.bool_()))], [*PAGE.names, "marked"])

    return run


def _decided(part_bits: int, name_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, marked in _marked_pages(batch, part_bits, name_bits):
                text = [main_text(t, p, m) for t, p, m in zip(pages["texts"], pages["places"], marked)]
                arrays = [pa.array(column, pa.string()) for column in (pages["page_id"], pages["url"], text)]
                yield pa.RecordBatch.from_arrays(arrays, ["page_id", "url", "text"])

    return run


ANSWERS = "chunk binary, part int, bits binary"
MARKED = "page_id string, url string, host string, texts array<string>, places array<tinyint>, marked array<boolean>"


def _with_answers(pages: DataFrame, part_bytes: int, name_bits: int) -> tuple[DataFrame, int]:
    """Chunks of all pages with the answers of the parts that hold their names and runs, and those parts' bits."""
    host = F.regexp_extract(F.lower(F.coalesce("url", F.lit(""))), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", host.alias("host"))
    # Runs are compared as texts on hosts with pages that they change; elsewhere structure has the last word anyway.
    survey = checkpointed(rows.select("host", "html").mapInArrow(_surveyed, "host string, n bigint"))
    part_bits = max(6, ((survey.agg(F.sum("n")).first()[0] or 0) // PART_HTML).bit_length())
    hosts = survey.where("host is not null").select("host").distinct()
    none_open = hosts.isEmpty()
    if none_open:
        rows = rows.withColumn("open", F.lit(False))
    else:
        hosts = broadcast_if_small(hosts.withColumn("found", F.lit(True)), F.octet_length("host") + 64)
        rows = rows.join(hosts, "host", "left").withColumn("open", F.coalesce("found", F.lit(False)))
    rows = rows.select("page_id", "url", "html", "host", "open")
    # The shuffled chunks are written once: the names and the joins with the answers read them.
    chunks = rows.mapInArrow(_chunks(part_bytes), "open boolean, pages binary, chunk binary").repartition("chunk")

    def answered(sent: DataFrame, compared, name: str) -> DataFrame:
        answers = sent.groupBy("part").applyInArrow(compared, ANSWERS)
        # The small side is hashed, so that no chunk is sorted.
        return answers.groupBy("chunk").agg(F.collect_list(F.struct("part", "bits")).alias(name)).hint("shuffle_hash")

    sent = "part int, chunk binary, n int, sent "
    names = chunks.mapInArrow(_names_of_chunks(part_bits, name_bits), sent + "binary")
    chunks = chunks.join(answered(names, _compared_names, "answers"), "chunk", "left")
    if none_open:
        return chunks.withColumn("checked", F.lit(None).cast("array<struct<part:int,bits:binary>>")), part_bits
    runs = chunks.mapInArrow(_runs_of_chunks(part_bits, name_bits), sent + "array<string>")
    return chunks.join(answered(runs, _compared_runs, "checked"), "chunk", "left"), part_bits


def marks(pages: DataFrame, part_bytes: int = PART_BYTES, name_bits: int = NAME_BITS) -> DataFrame:
    """One row per page: page_id, url, host, its blocks (texts, places) and, by word, whether the host repeats it.

    Where structure decides every page of a host, names alone are compared: on a large table a few words
    too many are marked there, which changes no text."""
    chunks, part_bits = _with_answers(pages, part_bytes, name_bits)
    return chunks.mapInArrow(_marks(part_bits, name_bits), MARKED)


def extract(pages: DataFrame, part_bytes: int = PART_BYTES, name_bits: int = NAME_BITS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    Null html is empty and gives an empty text; pages without a url share an empty host; ids may
    be null or repeat; an empty table gives no rows; only page_id, url and html are read. Suffixes of
    every page are compared over the whole of a host; `part_bytes` bounds a chunk of pages, names have `name_bits`."""
    chunks, part_bits = _with_answers(pages, part_bytes, name_bits)
    found = chunks.mapInArrow(_decided(part_bits, name_bits), "page_id string, url string, text string")
    return found.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )
