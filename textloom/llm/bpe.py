"""Byte-level BPE encoding and decoding with a segment tree per pre-token.

The tree's leaves hold the rank of each adjacent pair; its root yields the
lowest rank, and walking left first from the root yields the leftmost pair of
that rank. A merge changes three leaves, each a logarithmic point update, until
the root holds no mergeable pair. So a pre-token of n bytes costs O(n log n)
even where n is a whole document.

Cases: null and empty texts have no ids and decode to an empty text; special
tokens that occur in a text are single ids; ids out of range decode to nothing;
rows keep their order within a partition and repeated rows are encoded alike.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm.common import give_back, slices, table

NONE, NO_RANK = 1 << 60, np.iinfo(np.int32).max
#: Unicode white space, as the tokenizers' regular expressions have it.
WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of non-spaces with the blank before it, or white space. No pre-token crosses these borders.
PIECE = re.compile(f" ?[^{WS}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
PRE_TOKEN = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
#: Pieces up to SHORT characters are remembered, in CACHED bytes at most; pre-tokens of up to WIDE pairs are merged together.
SHORT, CACHED, WIDE = 64, 32 << 20, 64
#: Bytes that a remembered piece takes besides its text and ids, about.
ENTRY = 200
#: A slice of texts of this many bytes is encoded at a time.
STEP = 2 << 20


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary(NamedTuple):
    """What a vocabulary file says, small enough to be sent to every worker: numbers, and the bytes of each id."""

    bytes_of: list[bytes]
    byte_id: list[int]
    special: dict[str, int]
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray

    @classmethod
    def parse(cls, content: bytes | str) -> Vocabulary:
        spec = json.loads(content)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        bytes_of = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for token, i in vocab.items():
            bytes_of[i] = bytes(symbols[c] for c in token) if all(c in symbols for c in token) else token.encode()
        for token, i in special.items():
            bytes_of[i] = token.encode()
        byte_id = [0] * 256
        for c, b in symbols.items():
            byte_id[b] = vocab[c]
        pairs = [pair.split(" ") if isinstance(pair, str) else pair for pair in spec["model"]["merges"]]
        columns = ([vocab[a] for a, _ in pairs], [vocab[b] for _, b in pairs], [vocab[a + b] for a, b in pairs])
        return cls(bytes_of, byte_id, special, *(np.array(x, np.int32) for x in columns))


class Decoder:
    def __init__(self, words: Vocabulary):
        self.bytes_of = words.bytes_of

    def decode(self, ids: Sequence[int]) -> str:
        n, of = len(self.bytes_of), self.bytes_of
        try:
            if min(ids, default=0) >= 0:
                return b"".join([of[i] for i in ids]).decode("utf-8", "replace")
        except (IndexError, TypeError):
            pass
        return b"".join(of[i] for i in ids if i is not None and 0 <= i < n).decode("utf-8", "replace")


class ByteBPE:
    def __init__(self, words: Vocabulary | bytes | str):
        words = words if isinstance(words, Vocabulary) else Vocabulary.parse(words)
        special = words.special
        self.byte_id = words.byte_id
        #: (rank, id of the merged pair) of each pair of ids; the first of equal pairs counts.
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b, new) in enumerate(zip(words.left.tolist(), words.right.tolist(), words.merged.tolist())):
            self.merges.setdefault((a, b), (rank, new))
        self.special = {t: np.int32(i).tobytes() for t, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        keys = words.left.astype(np.int64) << 32 | words.right
        first = np.unique(keys, return_index=True)
        self.keys, self.ranks = first[0], first[1].astype(np.int32)
        if not len(keys):
            self.keys, self.ranks = np.array([-1], np.int64), np.array([NO_RANK], np.int32)
        self.merged = words.merged
        self.byte_ids = np.array(self.byte_id, np.int32)
        self.forget()

    def forget(self) -> None:
        """Drop the remembered pieces."""
        self.known: dict[str, bytes] = dict(self.special)
        self.held = 0

    def merge(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        ids = [self.byte_id[b] for b in data]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * size)
        none = (NONE, -1)
        for i in range(n - 1):
            tree[size + i] = merges.get((ids[i], ids[i + 1]), none)[0]
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def put(leaf: int, rank: int) -> None:
            leaf += size
            tree[leaf] = rank
            while leaf > 1:
                leaf >>= 1
                least = min(tree[2 * leaf], tree[2 * leaf + 1])
                if tree[leaf] == least:
                    break
                tree[leaf] = least

        while (lowest := tree[1]) < NONE:
            at = 1
            while at < size:
                at = 2 * at if tree[2 * at] == lowest else 2 * at + 1
            at -= size
            gone = after[at]
            ids[at] = merges[ids[at], ids[gone]][1]
            ids[gone] = -1
            after[at] = then = after[gone]
            if gone < size:
                put(gone, NONE)
            if then < n:
                before[then] = at
                put(at, merges.get((ids[at], ids[then]), none)[0])
            else:
                put(at, NONE)
            if (prior := before[at]) >= 0:
                put(prior, merges.get((ids[prior], ids[at]), none)[0])
        return [i for i in ids if i >= 0]

    def merge_many(self, tokens: list[bytes]) -> list[bytes]:
        """The ids of many pre-tokens, each with a segment tree of its own; trees of one size work in step."""
        out: list[bytes] = [b""] * len(tokens)
        classes: dict[int, list[int]] = {}
        for k, token in enumerate(tokens):
            n = len(token)
            if n - 1 > WIDE:
                out[k] = np.array(self.merge(token), dtype="<i4").tobytes()
            else:
                classes.setdefault(1 << max(n - 2, 0).bit_length(), []).append(k)
        for size, members in classes.items():
            for start in range(0, len(members), 20_000):
                some = members[start : start + 20_000]
                for k, ids in zip(some, self._merge_class([tokens[k] for k in some], size)):
                    out[k] = ids
        return out

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK where a pair doesn't merge or an end is -1."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], NO_RANK)

    def _merge_class(self, tokens: list[bytes], size: int) -> list[bytes]:
        """Pre-tokens of at most ``size`` pairs; ``size`` is a power of two. Every tree is a row."""
        width, count = size + 2, len(tokens)
        lengths = np.fromiter(map(len, tokens), np.int64, count)
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(count, width)
        column = np.arange(width)
        ids = np.where(column[None, :] < lengths[:, None], self.byte_ids[raw], -1).ravel()
        after = np.tile(column + 1, count)
        before = np.tile(column - 1, count)
        tree = np.full((count, 2 * size), NO_RANK, np.int32)
        grid = ids.reshape(count, width)
        tree[:, size:] = self._rank(grid[:, :size], grid[:, 1 : size + 1])
        for i in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        tree = tree.ravel()
        rows = np.arange(count)
        while len(rows := rows[tree[rows * 2 * size + 1] < NO_RANK]):
            root, own, n = rows * 2 * size, rows * width, lengths[rows]
            lowest = tree[root + 1]
            at = np.ones(len(rows), np.int64)
            while at[0] < size:
                at = 2 * at + (tree[root + 2 * at] != lowest)
            at -= size
            gone = after[own + at]
            then = after[own + gone]
            prior = before[own + at]
            ids[own + at] = self.merged[lowest]
            ids[own + gone] = -1
            after[own + at] = then
            before[own + np.minimum(then, width - 1)] = at
            last, first = then >= n, prior < 0
            here = ids[own + at]
            leaves = []
            for leaf, rank in (
                (gone, np.full(len(rows), NO_RANK, np.int32)),
                (at, self._rank(here, np.where(last, -1, ids[own + np.minimum(then, width - 1)]))),
                (np.where(first, gone, prior), np.where(first, NO_RANK, self._rank(ids[own + np.maximum(prior, 0)], here))),
            ):
                inside = leaf < size
                leaf = np.where(inside, leaf, size - 1) + size
                tree[root + leaf] = np.where(inside, rank, tree[root + leaf])
                leaves.append(leaf)
            while leaves[0][0] > 1:
                leaves = [leaf >> 1 for leaf in leaves]
                for leaf in leaves:
                    tree[root + leaf] = np.minimum(tree[root + 2 * leaf], tree[root + 2 * leaf + 1])
        kept = grid >= 0
        flat = grid[kept].astype("<i4").tobytes()
        ends = (4 * np.cumsum(kept.sum(1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't known yet."""
        whole, split = [], {}
        for p in pieces:
            if p.isalpha() or p[0] == " " and p[1:].isalpha():  # isalpha: categories L* only
                whole.append(p)
            else:
                split[p] = PRE_TOKEN.findall(p)
        tokens = list(set(whole).union(*split.values()))
        ids = dict(zip(tokens, self.merge_many([t.encode("utf-8", "surrogatepass") for t in tokens])))
        return {p: ids[p] for p in whole} | {p: b"".join([ids[t] for t in part]) for p, part in split.items()}

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids, as little-endian 32-bit integers."""
        if self.held > CACHED:
            self.forget()
        known, missing = self.known, set()
        cut: list[tuple[list[str], list[bytes | None]]] = []
        for text in texts:
            pieces: list[str] = []
            for part in self.split.split(text or "") if self.split else [text or ""]:
                pieces += [part] if part in self.special else PIECE.findall(part)
            ids = list(map(known.get, pieces))
            if None in ids:
                missing.update([p for p, x in zip(pieces, ids) if x is None])
            cut.append((pieces, ids))
        found = self._learn(list(missing))
        short = {p: x for p, x in found.items() if len(p) <= SHORT}
        known.update(short)
        self.held += sum(map(len, short)) + sum(map(len, short.values())) + ENTRY * len(short)
        return [b"".join([x or found[p] for p, x in zip(pieces, ids)] if None in ids else ids) for pieces, ids in cut]

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


@contextmanager
def _released(make: Callable[[Vocabulary], object], words: Vocabulary) -> Iterator:
    """What ``make`` builds of the vocabulary, for one task: a worker that waits for its next task holds none of it."""
    was = gc.isenabled()
    gc.disable()  # no cycles here, and millions of small objects to look through
    try:
        yield make(words)
    finally:
        if was:
            gc.enable()
        give_back()


def _shipped(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver (a megabyte or two) and sent to the executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Vocabulary.parse(f.read()))


def encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``df`` with the ids of ``text_col`` in ``ids_col`` (array<int>); a column of that name is replaced.

    With ``decoded_col``, also the text that the ids decode to, by the same worker. Null and empty texts have no ids;
    repeated rows are encoded alike; an empty table gives an empty result.
    """
    df = df.drop(*{ids_col, decoded_col} - {text_col, None})
    words, at = _shipped(df.sparkSession, path), df.columns.index(text_col)
    more = [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    out = T.StructType([*df.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Decoder(words.value)
        with _released(ByteBPE, words.value) as codec:
            for batch in slices(batches, at, STEP):
                found = codec.encode_many(batch.column(at).to_pylist())
                ends = np.cumsum([0, *(len(x) // 4 for x in found)], dtype=np.int32)
                columns = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(found), dtype="<i4")))]
                if decoded_col:
                    columns.append(pa.array([back.decode(np.frombuffer(x, "<i4").tolist()) for x in found], pa.string()))
                del found
                yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=out.names)

    return df.mapInArrow(run, out)


def decode(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col`` in ``text_col``, special tokens included; a column of that name is replaced.

    Null lists give an empty text, null and unknown ids nothing, broken UTF-8 the replacement character; an empty
    table gives an empty result.
    """
    df = df.drop(text_col)
    words, at = _shipped(df.sparkSession, path), df.columns.index(ids_col)
    out = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _released(Decoder, words.value) as codec:
            for batch in slices(batches, at, STEP):
                texts = pa.array([codec.decode(x) if x else "" for x in batch.column(at).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=out.names)

    return df.mapInArrow(run, out)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = default_path()
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, decoded_col="decoded")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
