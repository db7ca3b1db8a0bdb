"""Overlap of texts by character bigrams.

All three shapes look at one row (a text, or a pair of texts) at a time, so they
run where the row is, without a shuffle. Pairs that reach a threshold t are
found through an index of bigrams: two sets of that Jaccard similarity share one
of any ``|a| - ceil(t |a|) + 1`` members of a, so only sets that hold one of a's
rarest members are compared, and none is lost.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from textloom.operators.segment import LEAST, STRIDE, WINDOW

_SENTENCE = re.compile("[^。！？；\r\n]+[。！？；]?")
_WS = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
_SPACES = re.compile(f"[{_WS}]+")


#: Bytes of input that a worker turns into Python values at a time, about.
SLICE = 4 << 20


def sentences_of(text: str) -> list[str]:
    return _SENTENCE.findall(text)


def checked_sentences(text: str) -> list[str]:
    return [s for s in (x.strip(_WS) for x in sentences_of(text)) if len(s) >= LEAST]


def bigram_set(text: str) -> frozenset[str]:
    return frozenset(map("".join, zip(text, text[1:])))


def similarity(a: frozenset, b: frozenset) -> float:
    if not a and not b:
        return 1.0
    both = len(a & b)
    return both / (len(a) + len(b) - both)


def windows_of(text: str, size: int = WINDOW, step: int = STRIDE) -> list[str]:
    found = [text[i : i + size] for i in range(0, len(text) - size + 1, step)]
    tail = text[-size:]
    return found + [tail] if tail and (not found or found[-1] != tail) else found


class BigramIndex:
    """Sets by their members, for finding all that reach a similarity."""

    def __init__(self, sets: list[frozenset]):
        self.sets, self.holders = sets, defaultdict(list)
        for k, s in enumerate(sets):
            for g in s:
                self.holders[g].append(k)
        self.empty = [k for k, s in enumerate(sets) if not s]

    def candidates(self, s: frozenset, least: float) -> set[int]:
        if not s:
            return set(self.empty)
        need = len(s) - math.ceil(least * len(s) - 1e-9) + 1
        rare = sorted(s, key=lambda g: (len(self.holders.get(g, ())), g))[:need]
        low, high = least * len(s) - 1e-9, len(s) / least + 1e-9
        return {k for g in rare for k in self.holders.get(g, ()) if low <= len(self.sets[k]) <= high}


def _window_bigrams(text: str) -> np.ndarray:
    """A row for each window of a text of at least ``WINDOW`` characters: its bigrams, as numbers."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    pairs = chars[:-1] << 21 | chars[1:]
    n = len(chars)
    starts = np.arange(0, n - WINDOW + 1, STRIDE)
    if text[starts[-1] : starts[-1] + WINDOW] != text[n - WINDOW :]:
        starts = np.append(starts, n - WINDOW)
    return pairs[starts[:, None] + np.arange(WINDOW - 1)]


def _sets(ranks: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct numbers in order, then ``fill``; and how many there are."""
    ranks = np.sort(ranks, 1)
    again = np.zeros(ranks.shape, bool)
    again[:, 1:] = ranks[:, 1:] == ranks[:, :-1]
    last = np.iinfo(ranks.dtype).max
    ranks = np.sort(np.where(again, last, ranks), 1)
    return np.where(ranks == last, fill, ranks), ranks.shape[1] - again.sum(1)


def _repeated_windows(a: str, b: str, least: float) -> np.ndarray:
    """For each window of ``b`` whether a window of ``a`` is that similar; both texts have at least ``WINDOW`` characters.

    Windows meet under the rarest bigrams of either, of which similar ones share one, and are then compared whole.
    """
    one, two = _window_bigrams(a), _window_bigrams(b)
    _, number, count = np.unique(np.concatenate([one.ravel(), two.ravel()]), return_inverse=True, return_counts=True)
    rank = np.empty(len(count), np.int32)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count), dtype=np.int32)
    number = rank[number]
    (one, size_a), (two, size_b) = _sets(number[: one.size].reshape(one.shape), -1), _sets(number[one.size :].reshape(two.shape), -2)
    place = np.arange(one.shape[1])[None, :]
    enter = lambda sizes: np.nonzero(place < (sizes - np.ceil(least * sizes - 1e-9).astype(int) + 1)[:, None])
    (row_a, col_a), (row_b, col_b) = enter(size_a), enter(size_b)
    keys = one[row_a, col_a]
    order = np.argsort(keys, kind="stable")
    keys, row_a = keys[order], row_a[order]
    asked = two[row_b, col_b]
    first, end = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    found = np.zeros(len(two), bool)
    upto = np.cumsum(end - first)
    start = 0
    while start < len(asked):  # some 100,000 comparisons at a time
        stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + 100_000)))
        many = end[start:stop] - first[start:stop]
        y = np.repeat(row_b[start:stop], many)
        x = row_a[np.repeat(first[start:stop], many) + np.arange(len(y)) - np.repeat(np.cumsum(many) - many, many)]
        new = ~found[y] & (np.minimum(size_a[x], size_b[y]) >= least * np.maximum(size_a[x], size_b[y]) - 1e-9)
        x, y = x[new], y[new]
        both = sum((one[x] == two[y, k][:, None]).any(1).astype(np.int32) for k in range(two.shape[1])) if len(x) else np.empty(0)
        found[y[both / (size_a[x] + size_b[y] - both) >= least]] = True
        start = stop
    return found


def overlap(original: str | None, rewritten: str | None, least: float = 0.8) -> tuple[float, int, int] | None:
    """(rate, repeated windows, windows) of the rewritten text; None where either has no visible character."""
    a, b = (_SPACES.sub("", x or "") for x in (original, rewritten))
    if not a or not b:
        return None
    if min(len(a), len(b)) >= WINDOW:
        found = _repeated_windows(a, b, least)
        repeated, total = int(found.sum()), len(found)
    else:
        index, count = BigramIndex([*{bigram_set(w) for w in windows_of(a)}]), Counter(map(bigram_set, windows_of(b)))
        repeated = sum(n for s, n in count.items() if any(similarity(s, index.sets[k]) >= least for k in index.candidates(s, least)))
        total = sum(count.values())
    return repeated / total, repeated, total


def best_scores(original: str, rewritten: str, enough: float = 0.95) -> list[float]:
    """For each window of the rewritten text its best similarity; the search of a window ends at ``enough``."""
    own = [bigram_set(w) for w in windows_of(_SPACES.sub("", original))]
    scores = []
    for s in map(bigram_set, windows_of(_SPACES.sub("", rewritten))):
        best = 0.0
        for o in own:
            best = max(best, similarity(s, o))
            if best >= enough:
                break
        scores.append(best)
    return scores


def repeated_sentences(text: str | None, least: float = 0.85, most: int | None = 30) -> list[tuple[int, int, float, str, str]]:
    """(i, j, similarity, sentence i, sentence j), i < j, best first; in texts of over 1,500 sentences j - i is at most 400."""
    found = checked_sentences(text or "")
    band = 400 if len(found) > 1500 else len(found)
    index, out = BigramIndex([bigram_set(s) for s in found]), []
    for i, s in enumerate(index.sets):
        for j in index.candidates(s, least):
            if i < j <= i + band and (v := similarity(s, index.sets[j])) >= least:
                out.append((i, j, v, found[i], found[j]))
    return sorted(out, key=lambda x: (-x[2], x[0], x[1]))[:most]


def matched_sentences(original: str | None, rewritten: str | None, least: float = 0.5, max_original: int = 1500, enough: float = 0.98) -> list[tuple[int, float, str, str]]:
    """(index, similarity, sentence, original) of rewritten sentences near an original one, best first.

    The earliest most similar original counts, or the first that is similar
    enough. Of more than ``max_original`` originals every k-th is compared.
    """
    own = checked_sentences(original or "")
    if len(own) > max_original:
        own = own[:: math.ceil(len(own) / max_original)]
    least = least or 0.5
    index, out = BigramIndex([bigram_set(s) for s in own]), []
    for i, s in enumerate(checked_sentences(rewritten or "")):
        mine = bigram_set(s)
        scores = [(similarity(mine, index.sets[k]), -k) for k in index.candidates(mine, least)]
        near = [-k for v, k in scores if v >= enough]
        if near:
            k = min(near)
            out.append((i, similarity(mine, index.sets[k]), s, own[k]))
        elif scores and max(scores)[0] >= least:
            best, k = max(scores)
            out.append((i, best, s, own[-k]))
    return sorted(out, key=lambda x: (-x[1], x[0]))


def flat_map(df: DataFrame, inputs: list[str], keep: list[str], schema: str, function: Callable[..., list[tuple]]) -> DataFrame:
    """For each row its ``keep`` columns beside each tuple that ``function`` of its ``inputs`` gives."""
    added = T._parse_datatype_string(schema)
    out = T.StructType([*(df.schema[c] for c in keep), *added.fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in added.fields]
    n = len(keep)

    def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The batch, cut where its inputs are long."""
        size = max(1, int(batch.num_rows * SLICE / max(1, sum(c.nbytes for c in batch.columns[n:]))))
        return (batch.slice(k, size) for k in range(0, batch.num_rows, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for whole in batches for x in pieces(whole)):
            rows, found = [], []
            for row, values in enumerate(zip(*(c.to_pylist() for c in batch.columns[n:]))):
                got = function(*values)
                rows += [row] * len(got)
                found += got
            take = pa.array(rows, pa.int32())
            columns = zip(*found) if found else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(take) for k in range(n)), *(pa.array(list(c), kind) for c, kind in zip(columns, kinds))], names=out.names)

    return df.select(*keep, *(df[c].alias(f"in{k}__") for k, c in enumerate(inputs))).mapInArrow(run, out)


def self_duplicates(df: DataFrame, keep: list[str], text_col: str = "text", least: float = 0.85, most: int = 30) -> DataFrame:
    return flat_map(df, [text_col], keep, "i int, j int, sim double, a string, b string", lambda t: repeated_sentences(t, least, most))


def overlap_rate(df: DataFrame, keep: list[str], original_col: str, rewritten_col: str) -> DataFrame:
    """Rows without an estimate are left out."""
    return flat_map(df, [original_col, rewritten_col], keep, "rate double, dup_windows int, total_windows int", lambda a, b: [x] if (x := overlap(a, b)) else [])


def sentence_report(df: DataFrame, keep: list[str], original_col: str, rewritten_col: str, least: float = 0.5, max_original: int = 1500) -> DataFrame:
    return flat_map(df, [original_col, rewritten_col], keep, "sent_idx int, sim double, sentence string, orig string", lambda a, b: matched_sentences(a, b, least, max_original))
