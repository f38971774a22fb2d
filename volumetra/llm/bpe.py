"""BPE encoding and decoding.

White space always ends a pre-token of the word vocabulary, and a single space
or line feed does for the byte vocabulary, so a text is encoded unit by unit and
each unit of a worker is encoded once while it stays in a bounded cache.

A unit of more than LONG letters (one distinct unit in twenty of the test tables,
and any long unsplit text) is encoded as a tree: leaves in one parallel
batch, then neighbours are joined from the bottom up. At a join a window around
the cut is encoded; it counts once it repeats at least AGREE tokens of the left
part and of the right part at the same places, and grows until it does or has
become the whole. (A BPE sequence is the right one if each pair of neighbouring
tokens is, and every pair then comes from one of three right sequences.)

Null and empty texts have no tokens. Everything happens inside the row; memory
is bounded by the batch, the longest text and the cache.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from volumetra.llm.common import batches, ship

#: Units of more letters are encoded as a tree with leaves of so many, and windows that start at so many on either side.
LONG, LEAF, FIRST_WINDOW = 12, 6, 8
AGREE = 4
CACHE = 400_000


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Tree:
    """Tree concatenation over one tokenizer."""

    def __init__(self, tokenizer, leaf: int = LEAF):
        self.tok, self.leaf = tokenizer, leaf
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def tokens(self, text: str, at: int) -> list[tuple[int, int, int]]:
        e = self.tok.encode(text, add_special_tokens=False)
        return [(i, a + at, b + at) for i, (a, b) in zip(e.ids, e.offsets)]

    def whole(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        norm = self.tok.normalizer
        plain = norm.normalize_str(text) if norm else text
        if len(plain) <= self.leaf or any(s in text for s in self.special) or (norm and norm.normalize_str(plain) != plain):
            return self.whole(text)
        cuts = list(range(0, len(plain), self.leaf)) + [len(plain)]
        leaves = self.tok.encode_batch([plain[a:b] for a, b in zip(cuts[:-1], cuts[1:])], add_special_tokens=False)
        row = [(a, b, [(i, x + a, y + a) for i, (x, y) in zip(e.ids, e.offsets)]) for a, b, e in zip(cuts[:-1], cuts[1:], leaves)]
        while len(row) > 1:
            row = [self.join(plain, *row[i : i + 2]) if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return [i for i, _, _ in row[0][2]]

    def join(self, text: str, left, right):
        (a, m, lt), (_, b, rt) = left, right
        width = FIRST_WINDOW
        while True:
            lo, hi = max(a, m - width), min(b, m + width)
            win = self.tokens(text[lo:hi], lo)
            if lo == a and hi == b:
                return a, b, win
            x = (0, 0) if lo == a else self.agree(win, lt, first=True)
            y = (len(win), len(rt)) if hi == b else self.agree(win, rt, first=False)
            if x and y and x[0] <= y[0]:
                return a, b, lt[: x[1]] + win[x[0] : y[0]] + rt[y[1] :]
            width *= 2

    @staticmethod
    def agree(win, own, first: bool):
        """Places in win and own where both go on alike: after the first common run, or before the last."""
        place = {t: i for i, t in enumerate(own)}
        run = 0
        order = range(len(win)) if first else range(len(win) - 1, -1, -1)
        step = 1 if first else -1
        before = None
        for i in order:
            at = place.get(win[i])
            run = 0 if at is None else run + 1 if before is not None and at == before + step else 1
            before = at
            if run >= AGREE:
                return (i + 1, at + 1) if first else (i, at)
        return None


class WordUnits(dict):
    """unit without ASCII white space -> (ids as little-endian bytes, decoded text or None)."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = load(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tree = Tree(self.tok)

    def __missing__(self, unit: str):
        ids = self.tree.encode(unit) if len(unit) > LONG else self.tree.whole(unit) if unit else []
        made = (np.array(ids, "<u4").tobytes(), self.tok.decode(ids, skip_special_tokens=False) if ids else None)
        if len(unit) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[unit] = made
        return made

    def encode(self, text: str | None) -> tuple[bytes, str]:
        text = text or ""
        for c in "\t\n\x0b\f\r":
            if c in text:
                text = text.replace(c, " ")
        found = [self[u] for u in text.split(" ")]
        return b"".join([x for x, _ in found]), " ".join([d for _, d in found if d is not None])


class ByteUnits:
    """Byte-level vocabulary: ids of a text as little-endian bytes."""

    ODD = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]|[ \n]$|<\|")

    def __init__(self, path: str, ranks: str | None = None):
        self.tok = load(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.fast = None
        if ranks and os.path.exists(ranks):  # the same vocabulary, quicker for units of Latin letters
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.first, self.later = self.units(""), self.units(" ")
        self.line = self.encode_unit("\n")

    def units(self, lead: str):
        outer = self

        class Units(dict):
            def __missing__(self, unit: str) -> bytes:
                made = outer.encode_unit(lead + unit)
                if len(unit) <= 64:
                    if len(self) >= CACHE:
                        self.clear()
                    self[unit] = made
                return made

        return Units()

    def encode_unit(self, unit: str) -> bytes:
        if self.fast and (unit.isascii() or max(unit) < "ɐ"):
            return np.array(self.fast(unit), "<u4").tobytes()
        return np.array(self.tok.encode(unit, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.ODD.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out = []
        for line in text.split("\n"):
            words = line.split(" ")
            out.append(self.first[words[0]] + b"".join([self.later[w] for w in words[1:]]))
        return self.line.join(out)


_READY: dict = {}


def ready(kind, *args):
    """One encoder for each worker process: its cache lives from batch to batch and task to task."""
    if (kind, args) not in _READY:
        _READY[kind, args] = kind(*args)
    return _READY[kind, args]


def encode_decode(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """docs without text, with n_tokens, ids (little-endian unsigned 32-bit) and decoded."""
    ship(docs.sparkSession)
    rest = [f for f in docs.schema if f.name not in (text, "n_tokens", "ids", "decoded")]
    names = [f.name for f in rest]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["n_tokens long", "ids binary", "decoded string"])

    def run(frames):
        units = ready(WordUnits, tokenizer)
        for batch in batches(frames, 4.0, text):
            made = [units.encode(t) for t in batch.column(text).to_pylist()]
            columns = [pa.array([len(i) // 4 for i, _ in made], pa.int64()), pa.array([i for i, _ in made], pa.binary()), pa.array([d for _, d in made], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *columns], [*names, "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the same work, only digests leave the worker."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(frames):
        units = ready(WordUnits, tokenizer)
        for batch in batches(frames, 4.0):
            made = [units.encode(t) for t in batch.column("text").to_pylist()]
            columns = [
                batch.column("doc_id"),
                pa.array([len(i) // 4 for i, _ in made], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in made]),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in made]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
