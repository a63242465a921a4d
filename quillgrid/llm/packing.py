"""Operator 1: order-preserving packing by dynamic programming.

The ids of a partition's documents, in the input's order, form one stream. Windows of at
most 2048 ids are cut from it so that padding plus truncation penalties are least: a cut
between documents is free, one after a sentence costs little, one elsewhere more. With
f(p) the least cost up to cut p, f(p) = cut(p) + min over q of f(q) + pad(p - q), where
pad(n) is 0 at a power of two, else 2048 - n: the least f(q) + q of the last 2048 ids is
kept in a monotone queue, and the powers of two are twelve more transitions.

Each partition is packed alone, without a shuffle, a stretch of the stream at a time; the last
window of a stretch is carried into the next. A task that is run again gives the same windows.

Results: null and empty texts are documents of the end id alone; repeated rows are documents of
their own; null ids stay; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import ENTRY, byte_letters, in_workers, slices, table, tokenizer_path, two_columns, worker_state

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
LIMIT = 2048
END = 1
#: Costs in ids of padding: a cut after a sentence, a cut elsewhere, and each window.
AFTER_SENTENCE, ELSEWHERE, WINDOW = 2.0, 48.0, 1.0
#: Ids of a stretch that is solved at once; ids between cuts where no sentence ends.
STRETCH, STEP = 1 << 20, 128
#: Characters of a piece that is remembered.
LONGEST = 256
#: Bytes of pieces that a worker remembers, about.
MEMORY = 144 << 20


class Encoder:
    """Ids of texts as the library gives them, remembered by blank-separated piece.

    A blank before a character that isn't white space always begins a pre-token, so texts can be cut
    there; a text with a blank before white space or at its end goes to the library whole. Pieces of
    ordinary characters are merged by the same vocabulary's ranks, those that may hold a special string by the library."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        letters = byte_letters()
        strings = {bytes(letters[c] for c in k): v for k, v in self.tokenizer.get_vocab().items() if k not in special}
        self.merge = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=strings, special_tokens={}).encode_ordinary
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}
        self.held = 0
        self.sentence = np.zeros(max(self.tokenizer.get_vocab_size(), END + 1), bool)
        self.sentence[[v for k, v in strings.items() if re.search(rb"[.!?\n]$", k)]] = True

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _ids(self, piece: str) -> bytes:
        return self._library(piece) if "<|" in piece else array("I", self.merge(piece)).tobytes()

    def _piece(self, blank: str, w: str) -> bytes:
        """Ids of a piece with the blank before it, if any; its lines, and its letters and a mark after them, are pre-tokens apart."""
        known = self.rest if blank else self.first
        if (found := known.get(w)) is not None:
            return found
        head, line, tail = w.partition("\n")
        if line and head and tail and not head[-1].isspace() and not tail[0].isspace():
            found = self._piece(blank, head) + self._ids(line) + self._piece("", tail)
        elif w[-1:] in (".", ",") and w[:-1].isalpha():
            found = self._piece(blank, w[:-1]) + self._ids(w[-1])
        else:
            found = self._ids(blank + w)
        if len(w) <= LONGEST:
            if self.held > MEMORY:
                self.first.clear()
                self.rest.clear()
                self.held = 0
            known[w] = found
            self.held += ENTRY + len(w) + len(found)
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        first, rest, out = self.first, self.rest, []
        for text in texts:
            head, *tail = text.split(" ")
            try:
                out.append(first[head] + b"".join([rest[w] for w in tail]))
            except KeyError:
                out.append(self._new(text, head, tail))
        return out

    def _new(self, text: str, head: str, tail: list[str]) -> bytes:
        """The ids of a text with pieces that aren't remembered, or that can't stand alone."""
        if any(not w or w[0].isspace() for w in tail):
            return self._library(text)
        known = self.rest.get
        return self._piece("", head) + b"".join([known(w) or self._piece(" ", w) for w in tail])


class Stream:
    """The ids of a partition's documents, cut into windows a stretch at a time."""

    def __init__(self, sentence: np.ndarray, limit: int, number: int):
        self.sentence, self.limit, self.number = sentence, limit, number
        self.ids, self.size = [], 0
        self.docs: list[list] = []  # id, ids in all, ids before the stream's next, ids here

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append([doc_id, len(ids), 0, len(ids)])
        self.ids.append(ids)
        self.size += len(ids)

    def cut(self, last: bool) -> list[tuple]:
        """Pieces of all windows but, unless it is the last stretch, the last one."""
        if not self.size:
            return []
        ids = np.concatenate(self.ids)
        ends = np.cumsum([d[3] for d in self.docs])
        windows = best_windows(ids, ends, self.sentence, self.limit, last)
        upto = windows[-1] if last else windows[-2] if len(windows) > 1 else 0
        starts = ends - [d[3] for d in self.docs]
        marks = np.unique(np.concatenate([windows, starts]))
        marks = marks[marks < upto].tolist()
        doc = (np.searchsorted(ends, marks, "right")).tolist()
        window = (np.searchsorted(windows, marks, "right") - 1).tolist()
        begun, starts, raw, out = windows.tolist(), starts.tolist(), memoryview(ids).cast("B"), []
        for a, b, d, w in zip(marks, [*marks[1:], upto], doc, window, strict=True):
            own = self.docs[d]
            out.append((own[0], own[2] + a - starts[d], b - a, crc32(raw[4 * a : 4 * b]), own[1], self.number + w, a - begun[w]))
        self.number += len(windows) - 1 if last else max(0, len(windows) - 2)
        kept = []
        for d, s, e in zip(self.docs, starts, ends.tolist(), strict=True):
            if e > upto:
                cut = max(0, upto - s)
                kept.append([d[0], d[1], d[2] + cut, e - s - cut])
        self.docs, self.ids, self.size = kept, [ids[upto:]], len(ids) - upto
        return out


def best_windows(ids: np.ndarray, ends: np.ndarray, sentence: np.ndarray, limit: int, last: bool) -> np.ndarray:
    """The windows' bounds, 0 and the stretch's length included, of least cost."""
    n = len(ids)
    after, is_end, is_cut = np.zeros(n + 1, bool), np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    after[1:] = sentence[ids]
    is_end[ends] = True
    np.logical_or(after, is_end, out=is_cut)
    is_cut[0] = True
    cuts = np.flatnonzero(is_cut)
    step = min(STEP, limit)
    for k in np.flatnonzero(np.diff(cuts) > min(2 * STEP, limit)).tolist():
        is_cut[cuts[k] + step : cuts[k + 1] : step] = True
    powers = limit >> np.arange(limit.bit_length())
    if last:
        tail = n - np.unique(np.concatenate([powers, (powers[:, None] + powers).ravel()]))
        is_cut[tail[tail >= 0]] = True
    at = np.flatnonzero(is_cut)
    cost = np.where(is_end[at], 0.0, np.where(after[at], AFTER_SENTENCE, ELSEWHERE))
    exact: dict[int, list[int]] = {}  # cuts a power of two before
    for p in powers.tolist():
        low = int(np.searchsorted(at, p))
        hits = np.flatnonzero(is_cut[at[low:] - p]) + low
        for i, k in zip(hits.tolist(), np.searchsorted(at, at[hits] - p).tolist(), strict=True):
            exact.setdefault(i, []).append(k)
    place, price = at.tolist(), (cost + WINDOW).tolist()
    least, back = [0.0] * len(place), [0] * len(place)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # f(q) + q rising, q, its number
    pop, popleft, push, exact_at = queue.pop, queue.popleft, queue.append, exact.get
    for i in range(1, len(place)):
        p = place[i]
        while queue[0][1] < p - limit:
            popleft()
        head = queue[0]
        f, b = head[0] + limit - p, head[2]
        for k in exact_at(i, ()):
            if least[k] < f:
                f, b = least[k], k
        f += price[i]
        least[i], back[i] = f, b
        g = f + p
        while queue and queue[-1][0] >= g:
            pop()
        push((g, p, i))
    found, i = [len(place) - 1], len(place) - 1
    while i:
        i = back[i]
        found.append(i)
    return at[found[::-1]]


def _encoder(path: str) -> Encoder:
    return worker_state(("packing", path), lambda: Encoder(path))


def pack(df: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: which ids of which document stand where in which sequence."""
    if limit < 1:
        raise ValueError("a sequence holds one id at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        stream = Stream(encoder.sentence, limit, TaskContext.get().partitionId() << 40)
        end = np.uint32(END).tobytes()

        def rows(last: bool) -> pa.RecordBatch:
            columns = list(zip(*stream.cut(last), strict=True)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for part in slices(batch, 1, 256):
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    stream.add(doc_id, np.frombuffer(ids + end, np.uint32))
                if stream.size >= STRETCH:
                    yield rows(False)
        yield rows(True)

    return in_workers(two_columns(df, id_col, text_col), "packing", run, SCHEMA)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


QUERIES = {"op1_packing": op1_packing}
ORACLES: dict[str, str] = {}
