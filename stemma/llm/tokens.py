"""Token ids of whole texts by a public byte-level BPE vocabulary, and token counts.

The vocabulary's ranks are read from a .tiktoken file whose path is a parameter. A text is cut by the
vocabulary's own pattern; each piece is encoded by backtracking: the longest token at a place is taken, and
given up for the next shorter one when it may not follow its predecessor or leads nowhere. Whether two
tokens may stand side by side is decided by undoing merges (memoised per pair), which yields exactly the
ids that merging pairs in order of rank would, in time linear in the piece. Matches come from one
Aho-Corasick automaton over the tokens as Latin-1 strings.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.plans.workspace import cores, spread

#: Fixed value: the pattern that cuts a text into pieces for this family of vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_FOLDER = os.environ.get("STEMMA_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE_50K = os.path.join(DEFAULT_FOLDER, "byte_bpe_50k.tiktoken")
#: Pieces remembered per worker; beyond that the memory is emptied. Pieces longer than this are not kept.
CACHE_PIECES, CACHE_LENGTH = 200_000, 64


class BytePairs:
    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            rows = [line.split() for line in f if line.strip()]
        self.ids = {base64.b64decode(token).decode("latin-1"): int(rank) for token, rank in rows}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.cut = regex.compile(PATTERN).findall
        self.match = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.match.add_word(token, (rank, len(token)))
        self.match.make_automaton()
        self.merged: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        for rank in sorted(self.text):
            token = self.text[rank]
            for k in range(len(token) - 1, 0, -1):
                a, b = self.ids.get(token[:k]), self.ids.get(token[k:])
                if a is not None and b is not None and a < rank and b < rank and self._neighbours(a, b):
                    self.merged[a, b] = rank
                    self.halves[rank] = (a, b)
                    break
        self.fits = {}
        self.known: dict[str, tuple[int, ...]] = {}

    def _neighbours(self, a: int, b: int) -> bool:
        """Whether merging would have left a border between a and b: no earlier merge reaches over it."""
        bound = 1 << 60
        while True:
            over = self.merged.get((a, b))
            if over is not None and over < bound:
                return False
            # undo the later of the two tokens, keeping the part at the border
            if a > b:
                last, parts = a, self.halves.get(a)
                if parts:
                    bound, a = last, parts[1]
                    continue
                parts = self.halves.get(b)
                if not parts:
                    return True
                bound, b = b + 1, parts[0]
            else:
                parts = self.halves.get(b)
                if parts:
                    bound, b = b + 1, parts[0]
                    continue
                parts = self.halves.get(a)
                if not parts:
                    return True
                bound, a = a, parts[1]

    def may_follow(self, a: int, b: int) -> bool:
        key = (a, b)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self._neighbours(a, b)
        return known

    def piece(self, raw: str) -> tuple[int, ...]:
        whole = self.ids.get(raw)
        if whole is not None:
            return (whole,)
        size = len(raw)
        # of every place: tokens that begin there, the longest last
        starts: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, (rank, length) in self.match.iter(raw):
            starts[end - length + 1].append((rank, length))
        dead = bytearray(size + 1)
        out: list[tuple[int, int, int]] = []  # rank, length, which of the tokens at its place
        place, choice = 0, len(starts[0]) - 1
        while place < size:
            here, before = starts[place], out[-1][0] if out else -1
            while choice >= 0:
                rank, length = here[choice]
                if not dead[place + length] and (before < 0 or self.may_follow(before, rank)):
                    out.append((rank, length, choice))
                    place += length
                    choice = len(starts[place]) - 1 if place < size else -1
                    break
                choice -= 1
            else:
                dead[place] = 1
                if not out:
                    raise ValueError("a byte is not in the vocabulary")
                _, length, choice = out.pop()
                place -= length
                choice -= 1
        return tuple(rank for rank, _, _ in out)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for p in self.cut(text):
            ids = known.get(p)
            if ids is None:
                ids = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= CACHE_LENGTH:
                    if len(known) >= CACHE_PIECES:
                        known.clear()
                    known[p] = ids
            extend(ids)
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> BytePairs:
    return BytePairs(path)


def sent(spark: SparkSession, path: str) -> str:
    """The name under which executors find the file, which only the driver need have."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def token_ids(documents: DataFrame, path: str = BYTE_BPE_50K, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids: array<int>): ids of each whole text, without special tokens.

    Null and empty texts give an empty list; each row gives one row, repeated texts and keys included. Other
    columns are ignored.
    """
    df = documents.select(F.col(key), F.col(text).alias("_text"))
    df = spread(df, cores(df.sparkSession))
    name = sent(df.sparkSession, path)

    def run(batches):
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            flat, ends = [], [0]
            for t in batch.column(1).to_pylist():
                if t:
                    flat.extend(vocab.encode(t))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(flat, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=[key, "ids"])

    return df.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def token_counts(documents: DataFrame, path: str = BYTE_BPE_50K, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The rows with their text replaced by its number of tokens: 0 for null and empty texts."""
    rest = [c for c in documents.columns if c != text]
    df = spread(documents.select(*rest, F.col(text).alias("_text")), cores(documents.sparkSession))
    name = sent(documents.sparkSession, path)

    def run(batches):
        vocab = vocabulary(SparkFiles.get(name))
        for batch in batches:
            n = [len(vocab.encode(t)) if t else 0 for t in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(n, pa.int32())], names=[*rest, out])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest)
    return df.mapInArrow(run, f"{kinds}{', ' if rest else ''}{out} int")
