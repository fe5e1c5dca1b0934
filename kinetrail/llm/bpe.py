"""Byte-level BPE encoding by backtracking, and decoding through an offset table.

Encoding of a piece: an Aho-Corasick automaton over the tokens finds the longest one at a place. The encoder keeps it only
if the pair with the token before it is compatible (the merges would leave a border just there), goes through the shorter
tokens that begin it, and steps back when none is left; places that proved dead ends are marked, so the work is linear.
Matches are looked up only where the encoder comes by. Pieces are what the pre-tokenizer's pattern yields.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from kinetrail.llm.common import bounded, frugal

#: The pre-tokenizer's pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's memory of pieces; it is emptied when full.
MEMORY = 300_000
#: Rows, and about as many characters, that are encoded together.
GROUP, GROUP_SIZE = 256, 1 << 20
#: Tokens that are decoded in one gather.
GATHER = 1 << 17
#: Bytes of a long piece that are matched at once.
WINDOW = 4096


def _near_pattern() -> str:
    """PATTERN for characters up to LAST, with its classes spelled out and what is most frequent first."""
    known = [chr(c) for c in range(ord(LAST) + 1)]
    letter, number, space = ("".join(re.escape(c) for c in known if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    return rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"


LAST = "\u024f"
BEYOND = re.compile(f"[^\0-{LAST}]").search
NEAR, ALL = re.compile(_near_pattern()).findall, regex.compile(PATTERN).findall


def pieces(text: str) -> list[str]:
    """What the pre-tokenizer makes of a text."""
    return ALL(text) if BEYOND(text) else NEAR(text)


class Memory(dict):
    """Ids of pieces, as bytes; a piece not met before is encoded."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, p: str) -> bytes:
        ids = self[p] = self.codec.encode_piece(p if p.isascii() else p.encode().decode("latin-1"))
        return ids


def alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file, to the byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Vocabulary, merge table and automaton of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = alphabet()
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.splitter = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        vocab = {k: v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, token
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge.setdefault((x, y), (r, z))
            self.parts.setdefault(z, (x, y))
            self.rank.setdefault(z, r)
        n = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * n
        for k, v in vocab.items():
            spelled[v] = bytes(byte[c] for c in k)
        for k, v in self.special.items():
            spelled[v] = k.encode()
        self.length = np.array([len(x) for x in spelled], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.length)])[:-1]
        self.blob = np.frombuffer(b"".join(spelled), np.uint8)
        # a token that no merge makes is never output
        made = {spelled[v].decode("latin-1"): v for v in vocab.values() if v in self.rank or len(spelled[v]) == 1}
        self.automaton = ahocorasick.Automaton()
        for text, v in made.items():
            self.automaton.add_word(text, v)
        self.automaton.make_automaton()
        self.shorter: dict[int, int] = {}  # the longest shorter token that begins a token
        for text, v in made.items():
            for k in range(len(text) - 1, 0, -1):
                if text[:k] in made:
                    self.shorter[v] = made[text[:k]]
                    break
        self.sizes = self.length.tolist()
        self.reach = max(self.sizes)
        self.fits: dict[int, bool] = {}  # pair-compatibility table, filled as pairs turn up
        self.width = np.uint16 if n <= 65536 else np.uint32
        self.seen = Memory(self)
        self.raw = [int(i).to_bytes(np.dtype(self.width).itemsize, "little") for i in range(n)]
        # decimal ids with a comma, padded to one width
        shown = [b"%d," % i for i in range(n)]
        self.digits = max(map(len, shown))
        self.shown = np.frombuffer(b"".join(x.ljust(self.digits, b"\0") for x in shown), np.uint8).reshape(n, self.digits)

    def forget(self) -> None:
        """Empties what was remembered of texts; the tables stay."""
        self.seen.clear()
        self.fits.clear()

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens a, b standing side by side: undo their merges from the last on and look for a
        merge across the border that would have come first."""
        merge, parts, rank = self.merge, self.parts, self.rank
        limit = len(self.rank) + 1
        while True:
            across = merge.get((a, b))
            if across is not None and across[0] < limit:
                return False
            ra, rb = rank.get(a, -1), rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # the left token was made last; up to then a border merge had to rank below it
                limit, a = min(limit, ra), parts[a][1]
            else:  # ties and later: the left one merges first, so a border merge of equal rank comes before
                limit, b = min(limit, rb + 1), parts[b][0]

    def encode_piece(self, p: str) -> bytes:
        """Token ids of a piece, given with one character for each byte."""
        longest, sizes, shorter, fits = self.automaton.iter_long, self.sizes, self.shorter, self.fits
        n, pos, ids, dead, before = len(p), 0, [], set(), -1
        whole = n <= WINDOW
        walk, safe = (longest(p), n) if whole else (longest(p[:WINDOW]), WINDOW - self.reach)
        token, going = next(walk)[1], True  # going: walk has just given the longest token at pos
        while True:
            end = pos + sizes[token]
            if before >= 0:
                pair = before << 32 | token
                ok = fits.get(pair)
                if ok is None:
                    ok = fits[pair] = self.compatible(before, token)
                if dead and end in dead:
                    ok = False
            else:
                ok = not dead or end not in dead
            if ok:
                ids.append(token)
                if end == n:
                    break
                pos, before = end, token
                if not going or pos > safe:
                    walk, safe = (longest(p, pos), n) if whole else (longest(p[pos : pos + WINDOW]), pos + WINDOW - self.reach)
                    going = True
                token = next(walk)[1]
            else:
                going = False
                if token in shorter:
                    token = shorter[token]
                else:  # nothing fits here: the token before is tried again, shorter
                    dead.add(pos)
                    token = ids.pop()
                    pos -= sizes[token]
                    before = ids[-1] if ids else -1
        if len(fits) > MEMORY:
            fits.clear()
        if len(ids) == 1:
            return self.raw[token]
        return b"".join([self.raw[i] for i in ids])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as bytes of the codec's width."""
        if not self.special or not any(x in t for t in texts for x in self.special):
            return self._encode(texts)
        parts = [[x for x in self.splitter.split(t) if x] for t in texts]  # special tokens stand alone
        flat = iter(self._encode([x for p in parts for x in p if x not in self.special]))
        out = []
        for p in parts:
            out.append(b"".join([self.raw[self.special[x]] if x in self.special else next(flat) for x in p]))
        return out

    def texts(self, ids: np.ndarray, ends: list[int]) -> list[bytes]:
        """Decimal ids, comma-joined, of each row; rows end at `ends` of ids."""
        parts, size = [], np.zeros(len(ids) + 1, np.int64)
        for a in range(0, len(ids), GATHER):
            wide = self.shown[ids[a : a + GATHER]]
            there = wide != 0
            parts.append(wide[there].tobytes())
            size[a + 1 : a + 1 + GATHER] = there.sum(axis=1)
        data, at = b"".join(parts), np.cumsum(size)
        stops = at[ends].tolist()
        return [data[x : y - 1] if y > x else b"" for x, y in zip([0, *stops], stops)]

    def _encode(self, texts: list[str]) -> list[bytes]:
        if len(self.seen) > MEMORY:
            self.seen.clear()
        ids = self.seen.__getitem__
        return [b"".join(map(ids, pieces(t))) for t in texts]

    def decode(self, ids: np.ndarray, ends: list[int]) -> list[str]:
        """Text of each row of ids; rows end at `ends`. Each token's bytes are gathered from one block by its offset;
        broken UTF-8 shows U+FFFD."""
        size = self.length[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        parts = []
        for a in range(0, len(ids), GATHER):
            b = min(a + GATHER, len(ids))
            shift = self.offset[ids[a:b]] - at[a:b] + at[a]
            parts.append(self.blob[np.repeat(shift, size[a:b]) + np.arange(at[b] - at[a])].tobytes())
        data, stops = b"".join(parts), at[ends].tolist()
        return [data[x:y].decode("utf-8", "replace") for x, y in zip([0, *stops], stops)]


def row_groups(texts: list[str]) -> Iterator[tuple[int, int]]:
    """From, to of consecutive rows that are handled together; one row may be longer."""
    a, held = 0, 0
    for b, t in enumerate(texts):
        if b > a and (b - a == GROUP or held + len(t) > GROUP_SIZE):
            yield a, b
            a, held = b, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One a worker process."""
    return Codec(path)


def coded(c: Codec, column: pa.Array) -> Iterator[tuple[np.ndarray, list[int], list[str]]]:
    """(ids, where each row ends in them, decoded texts) of groups of rows of a text column; null is empty."""
    texts = [t or "" for t in column.to_pylist()]
    for a, b in row_groups(texts):
        rows = c.encode(texts[a:b])
        ids = np.frombuffer(b"".join(rows), c.width)
        ends = (np.cumsum([len(r) for r in rows]) // ids.itemsize).tolist()
        yield ids, ends, c.decode(ids, ends)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, n_tokens, decoded) of each row of docs: ids array<int>, decoded string. A null text is empty (no
    ids, decoded ''); a null doc_id stays null; repeated rows give repeated results; other columns are left out.

    Narrow: no shuffle, one pass, a worker holds one Arrow batch.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, texts = [], [], []
            for raw, ends, shown in coded(codec(path), batch.column("text")):
                ids.append(raw.astype(np.int32))
                sizes.append(np.diff([0, *ends]))
                texts += shown
            sizes = np.concatenate([np.zeros(0, np.int64), *sizes])
            flat = np.concatenate([np.zeros(0, np.int32), *ids])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, pa.array(sizes), pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])
        codec(path).forget()

    slim = bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what encode_decode() returns, made in the same pass
    so that ids need not pass through Spark's rows. Cases as there."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            n, shown, decoded = [], [], []
            c = codec(path)
            for ids, ends, texts in coded(c, batch.column("text")):
                n.append(np.diff([0, *ends]))
                shown += map(sha, c.texts(ids, ends))
                decoded += [sha(t.encode()) for t in texts]
            sizes = np.concatenate([np.zeros(0, np.int64), *n])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(shown, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        codec(path).forget()

    slim = bounded(docs).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return slim.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
