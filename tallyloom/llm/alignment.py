"""Cross-tokenizer alignment: where tokens of two tokenizers end at the same byte, and which ids such groups link.

Tokenising is the only Python: a byte-level BPE (A) of the tokenizers library over space + text, a sentencepiece model (B)
over the text, each giving ids and the byte at which each token ends. The rest is Spark's array functions: array_intersect
of the end arrays gives the cuts, sorted unions of ends and cuts their places among the tokens, and transform, sequence and
slice the groups and links. Ids linked in a document are counted once for it; counts meet the documents again in a join.

A worker sends the libraries each distinct stretch of text once: A's pattern gives such pieces, and sentencepiece's merges never cross from a
word into the spaces before the next one, nor a control character that no longer piece holds, which PieceSide checks. Decoded ids are compared with the bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import Encoder, Vocabulary
from .common import Hasher, kept, send, slices, stored
from .tokenstore import ranks_in

#: Bytes of text that are tokenised at once.
SLICE = 512 << 10
#: Id pairs whose counts are broadcast (16 bytes each); more go through a shuffled join.
BROADCAST_PAIRS = 1 << 20
#: An id pair as one number: A id times this, plus B id.
PAIR = 1 << 32
MARK = "▁"

TOKENS = "row long, doc_id long, a array<int>, a_ends array<int>, b array<int>, b_ends array<int>"


class ByteSide(Encoder):
    """A: the ids of a tokenizers file for plain text, and the bytes of each."""

    def __init__(self, source: str) -> None:
        super().__init__(Vocabulary(ranks_in(source)))


class PieceSide(Encoder):
    """B: the ids of a sentencepiece model for text behind one space, found by stretches, and the bytes of each."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.model.id_to_piece(k) for k in range(self.model.vocab_size())]
        tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.length, self.token_bytes = np.array([len(t) for t in tokens], dtype=np.int64), np.frombuffer(b"".join(tokens), dtype=np.uint8)
        self.token_start = np.cumsum(self.length) - self.length
        held = "".join(p for k, p in enumerate(pieces) if len(p) > 1 and not self.model.is_byte(k))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces) or "\n" in held:
            raise ValueError("pieces of this model cross from a word into spaces, or hold a line feed")
        self.lone = np.array([chr(c) not in held and c < 0x20 for c in range(256)])
        self.hasher = Hasher()
        self.forget()

    def pieces(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stretches: a lone control character, or spaces with what follows up to the next space or lone character."""
        if not len(data):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        space, lone = data == 0x20, self.lone[data]
        begin = lone.copy()
        begin[1:] |= lone[:-1] | (space[1:] & ~space[:-1])
        begin[off[off < len(data)]] = True
        start = np.flatnonzero(begin)
        return start, np.append(start[1:], len(data))

    def merge(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # behind a line feed, which is a token by itself, the space that the library puts in front does no harm
        raw = data.tobytes()
        ids = [x[2:] for x in self.model.encode(["\n" + raw[s:e].decode() for s, e in zip(start.tolist(), end.tolist(), strict=True)], num_threads=1)]
        count = np.array([len(x) for x in ids], dtype=np.int64)
        return np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(count.sum())), count


class Both:
    """Both tokenizers in a worker: ids and ends of each text, none where the tokens' bytes are not the text's."""

    def __init__(self, sources: tuple[str, bytes]) -> None:
        self.sides = [ByteSide(sources[0]), PieceSide(sources[1])]

    def tokens(self, texts: pa.Array) -> list[pa.ListArray]:
        texts = pc.if_else(pc.greater(pc.binary_length(texts), 0), pc.binary_join_element_wise("", texts, " "), "")
        good, found = np.ones(len(texts), dtype=bool), []
        for side in self.sides:
            ids, at, data, off = side.encode(texts)
            reach = np.concatenate([[0], np.cumsum(side.length[ids])])
            if len(side.back) != len(data) or not np.array_equal(side.back, data):
                parts = zip(reach[at[:-1]], reach[at[1:]], off[:-1], off[1:], strict=True)
                good &= np.array([np.array_equal(side.back[a:b], data[c:d]) for a, b, c, d in parts], dtype=bool)
            found.append((ids, at, reach))
        out = []
        for ids, at, reach in found:
            count = np.diff(at)
            ends = reach[1:] - np.repeat(reach[at[:-1]], count)
            stay = np.repeat(good, count)
            at = np.concatenate([[0], np.cumsum(np.where(good, count, 0))])
            out += [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x[stay].astype(np.int32))) for x in (ids, ends)]
        return out


def tokenised(docs: DataFrame, a_source: str, b_source: bytes) -> DataFrame:
    """docs (doc_id, text) -> ids and byte ends of both tokenizers; no tokens where a text is null, empty or not spelled by both.

    `row` tells rows of one doc_id apart. Each row is on its own; an empty table gives none; further columns are ignored."""
    sent = send(docs.sparkSession, (a_source, b_source))  # its size is the vocabularies'

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = kept(sent, Both)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                tokens = both.tokens(pc.fill_null(part.column("text"), ""))
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), *tokens], ["row", "doc_id", "a", "a_ends", "b", "b_ends"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, TOKENS)


def let(value: Column, body) -> Column:
    """body(value), with value computed once for a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _places(ends: Column, cuts: Column) -> Column:
    """Places in `ends` of the cuts, which are among them: in the sorted union of both, each cut stands twice in a row."""
    union = F.sort_array(F.concat(ends, cuts))
    twice = lambda u: F.filter(F.sequence(F.lit(0), F.size(u) - 2), lambda k: F.get(u, k) == F.get(u, k + 1))
    return let(union, lambda u: F.transform(twice(u), lambda k, g: k - g))


NO_SPANS = "array<struct<p:int,x:int,q:int,y:int>>"


def groups(tokens: DataFrame) -> DataFrame:
    """tokens -> their columns and `groups`, array of (p, x, q, y): group g has A's tokens p + 1 to x and B's q + 1 to y, places from 0."""
    cut = tokens.withColumn("cuts", F.array_intersect("a_ends", "b_ends"))
    some = F.size("cuts") > 0
    placed = cut.withColumns({"ia": F.when(some, _places(F.col("a_ends"), F.col("cuts"))), "ib": F.when(some, _places(F.col("b_ends"), F.col("cuts")))})
    before = lambda of, g: F.coalesce(F.get(of, g - 1), F.lit(-1))
    spans = F.transform("ia", lambda x, g: F.struct(before("ia", g).alias("p"), x.alias("x"), before("ib", g).alias("q"), F.get("ib", g).alias("y")))
    return placed.withColumn("groups", F.when(some, spans).otherwise(F.array().cast(NO_SPANS))).drop("cuts", "ia", "ib")


def _single(s: Column) -> Column:
    """A group of one token each, as most are."""
    return (s["x"] - s["p"] == 1) & (s["y"] - s["q"] == 1)


def _shown(spans: Column, a: Column, b: Column) -> Column:
    """The groups as text, from ids as text."""
    some = lambda of, low, high: F.array_join(F.slice(of, low + 2, high - low), ",")
    one = lambda s: F.concat(F.get(a, s["x"]), F.lit("|"), F.get(b, s["y"]))
    more = lambda s: F.concat(some(a, s["p"], s["x"]), F.lit("|"), some(b, s["q"], s["y"]))
    return F.array_join(F.transform(spans, lambda s: F.when(_single(s), one(s)).otherwise(more(s))), ";")


def _pairs(spans: Column, a: Column, b: Column) -> Column:
    """Codes of all linked occurrences."""
    code = lambda x, y: x.cast("long") * PAIR + y
    more = lambda s: F.flatten(F.transform(F.slice(a, s["p"] + 2, s["x"] - s["p"]), lambda x: F.transform(F.slice(b, s["q"] + 2, s["y"] - s["q"]), lambda y: code(x, y))))
    return F.flatten(F.transform(spans, lambda s: F.when(_single(s), F.array(code(F.get(a, s["x"]), F.get(b, s["y"])))).otherwise(more(s))))


def aligned(docs: DataFrame, a_source: str, b_source: bytes) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, links array<long>): `links` are the codes of all linked occurrences."""
    made = groups(tokenised(docs, a_source, b_source)).withColumns({"a_text": F.col("a").cast("array<string>"), "b_text": F.col("b").cast("array<string>")})
    size = lambda c: F.size(c).cast("long")
    return made.select(
        "row", "doc_id", size("a").alias("n_a"), size("b").alias("n_b"), size("groups").alias("n_groups"),
        F.when(F.size("groups") > 0, F.sha2(_shown(F.col("groups"), F.col("a_text"), F.col("b_text")), 256)).otherwise("").alias("groups_sha256"),
        _pairs(F.col("groups"), F.col("a"), F.col("b")).alias("links"),
    ).withColumn("n_links", size("links"))


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n_docs, best): how many rows of aligned() link a pair of ids, and whether no pair of its A id has more."""
    counts = rows.select(F.explode(F.array_distinct("links")).alias("pair")).groupBy("pair").agg(F.count("*").alias("n_docs")).withColumn("a_id", F.shiftright("pair", 32))
    highest = counts.groupBy("a_id").agg(F.max("n_docs").alias("most"))
    return counts.join(highest, "a_id").select("pair", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, a_source: str, b_source: bytes, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of whole texts.

    A pair's count is the number of rows that link it; n_best counts links whose pair has the highest count of its A id, ties included; count_sum adds
    up counts over links. Texts that are null, empty or not spelled by both tokenizers have zeros and an empty digest. Rows of one doc_id, or none, are each on
    their own; an empty table gives an empty result; further columns are ignored."""
    rows = stored(aligned(docs, a_source, b_source), "alignment")
    counts = stored(pair_counts(rows), "pair-counts")
    links = rows.select("row", F.explode("links").alias("pair"))
    if counts.count() <= broadcast_pairs:
        links = links.withColumn("n", F.lit(1)).join(F.broadcast(counts), "pair")
    else:
        links = links.groupBy("row", "pair").agg(F.count("*").alias("n")).join(counts, "pair")
    sums = links.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return rows.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")


def sources(json_path: str, model_path: str) -> tuple[str, bytes]:
    with open(json_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        return f.read(), g.read()
