"""Operator 6: token counts with a whole-token shortcut.

Offline, once for a vocabulary, each string of it that ends a word is encoded alone; those
that give one token are proven "whole". A text's pre-tokens that are whole count
one each without any merging; only the rest are merged. What a blank-separated
piece costs is kept in a bounded memory of the worker.

Results: null and empty texts have 0 tokens; rows come back one for one, so
repeated rows and null ids stay; an empty table gives an empty table; other
columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ENTRY, byte_letters, in_workers, slices, table, tokenizer_path, two_columns, worker_state

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Bytes of pieces that a worker remembers, about; beyond, its memory starts anew.
MEMORY = 256 << 20


#: The vocabulary's own splitting rule for lower-cased Latin-1 text (fixed values: its letters, its numerals, white space).
LATIN = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+"


class Counter:
    """Counts tokens as the library's own encode does."""

    def __init__(self, path: str, whole: frozenset[str] | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.whole = proven(path) if whole is None else whole
        self.split = re.compile(LATIN).findall
        self.odd = re.compile(r"[^\x00-\xff]|<\|").search  # beyond Latin-1, or perhaps a special token: left to the library
        self.seen: dict[str, int] = {}
        self.merged: dict[str, int] = {}
        self.held = 0

    def _library(self, strings: list[str]) -> list[int]:
        return [len(e) for k in range(0, len(strings), 4096) for e in self.tokenizer.encode_batch_fast(strings[k : k + 4096], add_special_tokens=False)]

    def _learn(self, pieces: set[str]) -> None:
        """Prices pieces: whole pre-tokens count one, the others are merged."""
        whole, merged, parts, odd = self.whole, self.merged, {}, []
        for w in pieces:
            if self.odd(w):
                odd.append(w)
            else:
                parts[w] = self.split(w.lower())
        rest = list({p for own in parts.values() for p in own if p not in whole and p not in merged})
        merged.update(zip(rest, self._library(rest), strict=True))
        for w, own in parts.items():
            self.seen[w] = sum(1 if p in whole else merged[p] for p in own)
        self.seen.update(zip(odd, self._library(odd), strict=True))
        self.held += sum(map(len, pieces)) + sum(map(len, rest)) + ENTRY * (len(pieces) + len(rest))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        if self.held > MEMORY:
            self.seen.clear()
            self.merged.clear()
            self.held = 0
        seen = self.seen
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self._learn({w for words in split for w in words if w not in seen})
        return [sum(map(seen.__getitem__, words)) for words in split]


@lru_cache(maxsize=4)
def proven(path: str) -> frozenset[str]:
    """The proof, made once, before any text is read: strings of the vocabulary, without their word end, that encode alone as one token."""
    from tokenizers import Tokenizer

    tokenizer, end, decode, strings = Tokenizer.from_file(path), "</w>", byte_letters(), []
    for k in tokenizer.get_vocab(with_added_tokens=False):
        if k.endswith(end) and k != end:
            try:
                strings.append(bytes(decode[c] for c in k[: -len(end)]).decode())
            except UnicodeDecodeError:
                continue  # part of a character
    found = tokenizer.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(s for s, e in zip(strings, found, strict=True) if len(e) == 1)


def count_tokens(df: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: UTF-8 bytes, tokens, and whether the tokens exceed the limit. No shuffle.

    The proof is made here, once; its strings, some of the vocabulary's, go to the workers with the code."""
    whole = proven(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = worker_state(("token counts", path), lambda: Counter(path, whole))
        for batch in batches:
            for part in slices(batch, 1, 256):
                texts = [t or "" for t in part.column(1).to_pylist()]
                tokens = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens])],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return in_workers(two_columns(df, id_col, text_col), "token counts", run, SCHEMA)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


QUERIES = {"op6_token_counts": op6_token_counts}
ORACLES: dict[str, str] = {}
