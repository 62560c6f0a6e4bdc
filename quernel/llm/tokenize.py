"""Byte-level BPE encoding of a corpus with a public vocabulary, exact and in linear time.

Instead of replaying merges, the encoder walks forward.  An Aho-Corasick automaton over the reversed vocabulary
gives, for every position of a piece, the longest token that starts there.  A token may follow another one only if
the two are *compatible*: merging by rank never crosses their border.  That answer depends on the pair alone, so it
is kept in a table.  Where no compatible token continues, the walk takes the last token back, tries its next
shorter prefix and remembers the dead position, so every position fails at most once.  The sequence found this way
is the one that merging by rank would give.

Decoding slices one blob of all tokens' bytes by an offset table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how this vocabulary family splits text before merging (letters, numbers, other marks, blanks).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def _latin_pieces() -> str:
    """The same pattern for texts of code points below U+0100, in explicit classes that the standard engine scans
    about three times as fast."""
    kinds = {"L": "", "N": "", "Z": ""}
    for c in map(chr, range(256)):
        kind = "Z" if regex.match(r"\p{White_Space}", c) else unicodedata.category(c)[0]
        if kind in kinds:
            kinds[kind] += f"\\x{ord(c):02x}"
    letter, number, blank = kinds["L"], kinds["N"], kinds["Z"]
    return rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{blank}{letter}{number}]+|[{blank}]+(?![^{blank}])|[{blank}]+"


_split_any = regex.compile(PIECES).findall
_split_latin = re.compile(_latin_pieces()).findall


def split(text: str) -> list[str]:
    """The pieces of a text within which tokens are merged."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _split_any(text)
    return _split_latin(text)


#: Entries a task keeps of pieces and pairs it has met before starting over; only speed depends on them.
KEPT = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file: printable Latin-1 stands for itself, the others
    follow from U+0100 in byte order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in shown)
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Token bytes, merge pairs and the automaton of one vocabulary file (JSON with ``vocab`` and ``merges``)."""

    def __init__(self, raw: bytes):
        model, to_byte = json.loads(raw)["model"], byte_alphabet()
        ids = model["vocab"]
        special = {t for t in ids if any(c not in to_byte for c in t)} | {"<|endoftext|>"}
        as_bytes = {t: bytes(map(to_byte.__getitem__, t)) for t in ids if t not in special}
        self.id_of = {b: ids[t] for t, b in as_bytes.items()}
        self.size = max(self.id_of.values()) + 1
        self.token = [b""] * self.size
        for b, i in self.id_of.items():
            self.token[i] = b
        self.length = [len(b) for b in self.token]
        self.parts: list[tuple[int, int] | None] = [None] * self.size
        self.merged: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair = (ids[left], ids[right])
            whole = ids[left + right]
            self.merged.setdefault(pair, whole)
            if self.parts[whole] is None:
                self.parts[whole] = pair
        self.blob = b"".join(self.token)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])
        self.starts = ahocorasick.Automaton()
        for b, i in self.id_of.items():
            self.starts.add_word(b[::-1].decode("latin-1"), i)
        self.starts.make_automaton()
        self._fits: dict[tuple[int, int], bool] = {}
        self._shorter: dict[int, int] = {}
        self.pieces = _Pieces(self)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` then ``b`` by rank leaves the border between them untouched."""
        key = (a, b)
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) >= KEPT:
                self._fits.clear()
            known = self._fits[key] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        # Undo the two tokens' merges from the latest on.  Whenever the two sides that touch the border could merge
        # before the merge that was last undone on either side took place, the border would have been crossed.
        undone = self.size
        while True:
            crossing = self.merged.get((a, b))
            if crossing is not None and crossing < undone:
                return False
            on_left = a > b
            parts = self.parts[a if on_left else b]
            if parts is None:
                on_left = not on_left
                parts = self.parts[a if on_left else b]
                if parts is None:
                    return True
            if on_left:
                undone, a = a, parts[1]
            else:
                undone, b = b + 1, parts[0]

    def shorter(self, tok: int) -> int:
        """The longest token that is a proper prefix of ``tok``; -1 if there is none."""
        found = self._shorter.get(tok)
        if found is None:
            b = self.token[tok]
            found = next((self.id_of[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.id_of), -1)
            self._shorter[tok] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        """Token ids of the bytes of one piece."""
        n = len(piece)
        longest = [-1] * n
        for end, tok in self.starts.iter(piece[::-1].decode("latin-1")):
            at = n - 1 - end
            if longest[at] < 0 or self.length[tok] > self.length[longest[at]]:
                longest[at] = tok
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        at, tok = 0, longest[0] if n else -1
        while at < n:
            while tok >= 0 and not (alive[at + self.length[tok]] and (not out or self.compatible(out[-1], tok))):
                tok = self.shorter(tok)
            if tok >= 0:
                out.append(tok)
                at += self.length[tok]
                tok = longest[at] if at < n else -1
            else:
                alive[at] = 0
                tok = out.pop()
                at -= self.length[tok]
        return out

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a text, without special tokens; none of a null or empty text."""
        return list(chain.from_iterable(map(self.pieces.__getitem__, split(text)))) if text else []

    def decode(self, ids) -> str:
        """The text of token ids."""
        blob, at = self.blob, self.offset
        return b"".join(blob[at[i] : at[i + 1]] for i in ids).decode("utf-8", errors="replace")


class _Pieces(dict):
    """Ids by piece, filled on demand."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, piece: str) -> list[int]:
        b = piece.encode("utf-8", errors="replace")
        whole = self.vocabulary.id_of.get(b)
        ids = [whole] if whole is not None else self.vocabulary.encode_piece(b)
        if len(piece) <= 64:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


_loaded: dict[str, Vocabulary] = {}


def vocabulary(raw: bytes) -> Vocabulary:
    """The vocabulary of a file's content, built once in each Python worker."""
    key = hashlib.md5(raw).hexdigest()  # noqa: S324
    if key not in _loaded:
        _loaded[key] = Vocabulary(raw)
    return _loaded[key]


def _shared(spark: SparkSession, vocab_path: str):
    with open(vocab_path, "rb") as f:  # one vocabulary file, about 2 MB whatever the corpus
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids array<int>)``: the token ids of every row's text.

    A map over the scan: no shuffle, and only the two columns are read.  Null and empty texts give an empty list,
    blanks are encoded as they are; rows are neither dropped nor merged, so repeated ids stay repeated.  Further
    columns of ``df`` are ignored.  An empty table gives an empty result.
    """
    shared = _shared(df.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            lists = [v.encode(t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, lists)], dtype=np.int32)
            flat = np.fromiter(chain.from_iterable(lists), np.int32, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, flat)], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{id_col} {kind}, ids array<int>")


def token_counts(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_tokens long)``: how many tokens ``encode`` gives each row; 0 for null and empty texts."""
    shared = _shared(df.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        pieces = v.pieces.__getitem__
        for batch in batches:
            n = [sum(map(len, map(pieces, split(t)))) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"{id_col} {kind}, n_tokens long")


def decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, text)``: the texts of lists of token ids; a null list gives a null text, an empty list ''."""
    shared = _shared(df.sparkSession, vocab_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for batch in batches:
            texts = [None if ids is None else v.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"{id_col} {kind}, text string")
