"""Byte-level BPE over Arrow batches: pieces in numpy, merges by the tokenizers library, exact decoding.

A text is cut into pieces by the GPT-2 pattern, as runs of character classes found in numpy. Each
piece that a Python worker meets for the first time goes, as byte-to-character mapped text, through a
`tokenizers` BPE model; its ids are kept in a bounded store under the piece's hash, in sorted arrays. Ids of
a text are gathered from there, and decoded to see that their bytes are the text's: where they are not, two pieces
share a hash, and the pieces of that batch are told apart by their bytes. Every split of a token into two tokens is a merge at that token's
rank, which is how rank files are read. Token lengths in bytes give the offsets of each id in bytes and, by
the bytes that begin a character, in characters; decoding gathers each id's bytes from a table, so
a character that several ids share comes out whole.
"""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Hasher, kept, send, slices, text_bytes

#: Pieces kept by a worker; beyond, its store starts afresh.
MOST_PIECES = 1_500_000
#: Mapped pieces that go to the library as one text.
AT_ONCE = 400
#: Bytes of text that are encoded at once.
SLICE = 1 << 20
SPACE, OTHER, LETTER, NUMBER = 0, 1, 2, 3


def vocabulary_path(name: str) -> str:
    """A file of the public tokenizers package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others, in order, for
    the characters from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in keep else chr(extra))
        extra += b not in keep
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def character_classes() -> bytes:
    """Class of every code point, compressed."""
    import regex

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, points))
    out = np.full(0x110000, OTHER, dtype=np.uint8)
    at = np.array(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, text):
            out[at[run.start() : run.end()]] = kind
    return zlib.compress(out.tobytes(), 9)


def model_text(ranks: dict[bytes, int]) -> str:
    """A tokenizers model, as JSON, that merges by these ranks."""
    from tokenizers import Tokenizer, models, pre_tokenizers

    shown = byte_characters()
    name = {token: "".join(shown[b] for b in token) for token in ranks}
    merges = [(name[t[:i]], name[t[i:]]) for t in sorted(ranks, key=ranks.get) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    built = Tokenizer(models.BPE({name[t]: r for t, r in ranks.items()}, merges))
    built.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return built.to_str()


class Vocabulary:
    """What a task needs, built once on the driver and sent along: model text, token bytes, classes."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.model = zlib.compress(model_text(ranks).encode())
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.bytes = b"".join(tokens)
        self.classes = character_classes()


def piece_starts(points: np.ndarray, row: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """True at the characters that begin a piece. row: true at the first character of each row."""
    kind = classes[points]
    n = len(points)
    start = row.copy()
    start[1:] |= kind[1:] != kind[:-1]
    start[:1] = True
    inner = np.zeros(n + 3, dtype=bool)  # this character continues its row
    inner[:n] = ~row
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & inner[1:n])
    start[last] = True
    start[last + 1] = points[last] != 0x20
    p = np.zeros(n + 3, dtype=np.int64)
    p[:n] = points
    quote = np.flatnonzero(start & (points == 0x27) & inner[1 : n + 1])
    one = quote[np.isin(p[quote + 1], [ord(c) for c in "stmd"])]
    two = quote[inner[quote + 2]]
    two = two[np.isin(p[two + 1] * 0x110000 + p[two + 2], [ord(a) * 0x110000 + ord(b) for a, b in ("re", "ve", "ll")])]
    for at, size in ((one, 1), (two, 2)):
        start[at + 1] = False
        rest = at + 1 + size
        start[rest[rest < n]] = True
    return start


class Encoder:
    """Ids of the rows of a column. Made once in each Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(zlib.decompress(vocabulary.model).decode())
        self.length, self.token_bytes = vocabulary.length, np.frombuffer(vocabulary.bytes, dtype=np.uint8)
        self.token_start = np.cumsum(self.length) - self.length
        self.classes = np.frombuffer(zlib.decompress(vocabulary.classes), dtype=np.uint8)
        self.shown = np.array([ord(c) for c in byte_characters()], dtype=np.uint16)
        self.hasher = Hasher()
        self.forget()

    def forget(self) -> None:
        self.known = np.empty(0, dtype=np.uint64)
        self.at = np.empty(0, dtype=np.int64)  # of a known piece in the pool
        self.size = np.empty(0, dtype=np.int64)
        self.pool = np.empty(0, dtype=np.uint32)

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the given pieces, one after the other, and how many each has."""
        ids = []
        for k in range(0, len(start), AT_ONCE):
            s, size = start[k : k + AT_ONCE], (end - start)[k : k + AT_ONCE]
            to = np.cumsum(size + 1) - size - 1
            text = np.full(int(size.sum()) + len(size), 0x20, dtype=np.uint16)
            within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            text[np.repeat(to, size) + within] = self.shown[data[np.repeat(s, size) + within]]
            ids.append(np.array(self.tokenizer.encode(text.tobytes().decode("utf-16-le"), add_special_tokens=False).ids, dtype=np.uint32))
        flat = np.concatenate(ids)
        reach = np.cumsum(self.length[flat])
        count = np.searchsorted(reach, np.cumsum(end - start), side="right")
        return flat, np.diff(count, prepend=0)

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the pieces of all rows."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        row = np.zeros(len(data) + 1, dtype=bool)
        row[off] = True
        start = lead[piece_starts(points, row[lead], self.classes)]
        return start, np.append(start[1:], len(data))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all rows, id offsets of each row, and the rows' bytes and byte offsets; the bytes that the ids decode to are in `back`."""
        data, off = text_bytes(column)
        start, end = self.pieces(data, off)
        if not len(start):
            self.back = np.empty(0, np.uint8)
            return np.empty(0, np.uint32), np.zeros(len(off), np.int64), data, off
        # distinct hashes in order of their first piece, found by a hash table instead of a sort
        coded = pa.array(self.hasher(data, start, end).view(np.int64)).dictionary_encode()
        key, which = coded.dictionary.to_numpy().view(np.uint64), coded.indices.to_numpy()
        first = np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))
        if len(self.known) > MOST_PIECES:
            self.forget()
        new = np.ones(len(key), dtype=bool)
        if len(self.known):
            near = np.minimum(np.searchsorted(self.known, key), len(self.known) - 1)
            new = self.known[near] != key
        if new.any():
            flat, count = self.merge(data, start[first[new]], end[first[new]])
            self.at = np.concatenate([self.at, len(self.pool) + np.cumsum(count) - count])
            self.size, self.pool = np.concatenate([self.size, count]), np.concatenate([self.pool, flat])
            order = np.argsort(np.concatenate([self.known, key[new]]), kind="stable")
            self.known, self.at, self.size = np.concatenate([self.known, key[new]])[order], self.at[order], self.size[order]
        here = np.searchsorted(self.known, key)[which]
        ids, total = self.gathered(self.at[here], self.size[here], self.pool)
        self.back = self.decode(ids)
        if len(self.back) != len(data) or not np.array_equal(self.back, data):
            ids, total = self.by_bytes(data, start, end)
            self.back = self.decode(ids)
        before = np.concatenate([[0], total])[np.searchsorted(start, off)]
        return ids, before, data, off

    @staticmethod
    def gathered(at: np.ndarray, size: np.ndarray, pool: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many there are up to each piece's end."""
        total = np.cumsum(size)
        return pool[np.repeat(at - total + size, size) + np.arange(int(total[-1]))], total

    def by_bytes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What gathered() gives, for pieces known by their bytes instead of their hash."""
        raw, seen, which, first = data.tobytes(), {}, np.empty(len(start), dtype=np.int64), []
        for k, (a, b) in enumerate(zip(start.tolist(), end.tolist(), strict=True)):
            which[k] = seen.setdefault(raw[a:b], len(seen))
            if which[k] == len(first):
                first.append(k)
        flat, count = self.merge(data, start[first], end[first])
        return self.gathered((np.cumsum(count) - count)[which], count[which], flat)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that ids stand for."""
        size = self.length[ids]
        total = np.cumsum(size)
        if not len(ids):
            return np.empty(0, dtype=np.uint8)
        return self.token_bytes[np.repeat(self.token_start[ids] - total + size, size) + np.arange(int(total[-1]))]

    def offsets(self, ids: np.ndarray, data: np.ndarray) -> np.ndarray:
        """(ids, 2): first and past-the-last character of the text that each id touches."""
        end = np.cumsum(self.length[ids])
        begun = np.cumsum((data & 0xC0) != 0x80)
        return np.stack([begun[end - self.length[ids]] - 1, begun[end - 1]], axis=1) if len(ids) else np.empty((0, 2), np.int64)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], with_ids: bool = True, with_offsets: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and, as asked for, ids array<int> and char_start,
    char_end array<int>.

    Whole texts, without special tokens; null counts as empty and has no ids. ids_sha256 is of the ids as
    little-endian unsigned 32-bit integers, decoded_sha256 of the bytes that the ids decode to. Each
    row is on its own: repeated rows give repeated results, an empty table none, further columns are ignored."""
    sent = send(docs.sparkSession, Vocabulary(ranks))  # its size is the vocabulary's
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", char_start array<int>, char_end array<int>" * with_offsets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(sent, Encoder)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, at, data, off = encoder.encode(part.column("text"))
                raw, back = ids.astype("<u4").tobytes(), encoder.back.tobytes()
                ends = np.concatenate([[0], np.cumsum(encoder.length[ids])])[at]
                out = [
                    part.column("doc_id"),
                    pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)], pa.string()),
                    pa.array([hashlib.sha256(back[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                ]
                nested = lambda x: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(np.asarray(x).astype(np.int32)))  # noqa: B023, E731
                if with_ids:
                    out.append(nested(ids))
                if with_offsets:
                    both = [encoder.offsets(ids[a:b], data[c:d]) for a, b, c, d in zip(at[:-1], at[1:], off[:-1], off[1:], strict=True)]
                    both = np.concatenate(both) if both else np.empty((0, 2))
                    out += [nested(both[:, 0]), nested(both[:, 1])]
                yield pa.RecordBatch.from_arrays(out, [f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
