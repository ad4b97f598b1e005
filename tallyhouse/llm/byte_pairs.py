"""Byte-level BPE by longest matches and backtracking, with the results of the merge rules.

A sequence of tokens is what the merges give if and only if every token is what the merges make of
its own bytes and every two neighbours are what the merges make of theirs. So it is enough to walk
through a piece, take the longest token that goes with the one before, and step back where none
does; a place that led nowhere is never tried again, which keeps the walk linear. Tokens are found by
an Aho-Corasick automaton over the bytes, written as Latin-1 characters.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class BytePairs:
    def __init__(self, path: str, pattern: str, most_pieces: int = 400_000):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes_of = {rank: token for token, rank in self.ranks.items()}
        self.size = {rank: len(token) for token, rank in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token) - 1))
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        # Between a letter and " letter" the pattern always begins a new match.
        self.border = regex.compile(r"(?<=\p{L})(?= \p{L})")
        self.fits: dict[tuple[int, int], bool] = {}
        self.prefixes: dict[int, int | None] = {}
        self.pieces: dict[str, bytes] = {}
        self.most = most_pieces

    def merged(self, data: bytes) -> list[int]:
        """The merge rules, step by step: used for single tokens and pairs of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave the two tokens as they are; -1 stands for the start of a piece."""
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > self.most:
                self.fits.clear()
            pair = [b] if a < 0 else [a, b]
            known = self.fits[a, b] = self.merged(b"".join(map(self.bytes_of.__getitem__, pair))) == pair
        return known

    def shorter(self, token: int) -> int | None:
        """The longest token that is a proper prefix of this one."""
        if token not in self.prefixes:
            data = self.bytes_of[token]
            self.prefixes[token] = next((self.ranks[p] for k in range(len(data) - 1, 0, -1) if (p := data[:k]) in self.ranks), None)
        return self.prefixes[token]

    def encode_piece(self, data: bytes) -> list[int]:
        if data in self.ranks:  # a whole token needs no merges
            return [self.ranks[data]]
        n, size, compatible = len(data), self.size, self.compatible
        longest = [0] * n  # token at each place; matches come by their ends, so the last one is the longest
        for end, (token, back) in self.automaton.iter(data.decode("latin-1")):
            longest[end - back] = token
        dead = bytearray(n + 1)  # places from which no way leads to the end
        chosen: list[int] = []
        place, last, token = 0, -1, longest[0]
        while place < n:
            end = place + size[token]
            if not dead[end] and compatible(last, token):
                chosen.append(token)
                place, last = end, token
                token = longest[end] if end < n else -1
                continue
            while (token := self.shorter(token)) is None:
                dead[place] = 1
                token = chosen.pop()
                place -= size[token]
                last = chosen[-1] if chosen else -1
        return chosen

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers."""
        coded = []
        for part in self.parts(text):
            found = self.pattern.findall(part)
            new = set(found).difference(self.pieces)
            if len(self.pieces) + len(new) > self.most:
                self.pieces.clear()
                new = set(found)
            for piece in new:
                self.pieces[piece] = struct.pack(f"<{len(ids := self.encode_piece(piece.encode()))}I", *ids)
            coded.append(b"".join(map(self.pieces.__getitem__, found)))
        return b"".join(coded)

    def parts(self, text: str, most: int = 1 << 20) -> Iterator[str]:
        at = 0
        while len(text) - at > most and (cut := self.border.search(text, at + most)):
            yield text[at : cut.start()]
            at = cut.start()
        yield text[at:]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


_coders: dict[tuple[str, str], BytePairs] = {}


def coder(path: str, pattern: str) -> BytePairs:
    """One per Python worker, so later tasks find its pieces encoded."""
    if (path, pattern) not in _coders:
        _coders[path, pattern] = BytePairs(path, pattern)
    return _coders[path, pattern]


def byte_pair_ids(
    docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row of ``docs``: id, token_ids (little-endian 32-bit integers), decoded (bytes from the ids).

    A NULL text is empty and has no ids. Rows are independent: repeated rows and NULL ids are kept as they
    are, an empty table gives an empty result, other columns are ignored. ``ranks`` is the vocabulary's path."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = coder(ranks, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = [pairs.encode(t.as_py() or "") for t in part.column(1)]
                decoded = [pairs.decode(np.frombuffer(x, "<u4")) for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())],
                    names=[id_col, "token_ids", "decoded"],
                )

    picked = docs.select(docs[id_col].alias(id_col), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(code, f"{id_col} {kind}, token_ids binary, decoded binary")

