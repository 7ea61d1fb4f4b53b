"""Runs of repeated word sequences by suffix-tree longest common extensions.

A run is a stretch of words with a smallest period q that occurs at least ``repeats`` times and cannot be extended. Every
run holds a Lyndon word of length q that is the longest one at its place under the alphabetical order or under its
reverse (the runs theorem). So: Ukkonen trees of the words and of their reversal, Euler tours of both with range-minimum
tables (constant-time lowest common ancestors, hence extensions to both sides), the longest Lyndon word at every place
under both orders from the tree's suffix order, and one extension to the right and one to the left per candidate.

Only stretches that can hold a run enter the trees: a run contains a gram of ``min_words - min_words // repeats`` words
again one period later, and such grams cover the whole run. Grams are compared by hash here, which may only let more in;
the trees compare the words themselves. Each document is worked on by itself inside one task; its memory is bounded by
its own length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.tables import byte_steps

# words put into one pair of trees together; a longer document is a pair of its own
TREE_WORDS = 1 << 14
MIX = 0x9E3779B97F4A7C15


class SuffixTree:
    """Ukkonen's tree of a symbol list that ends in 0, which occurs nowhere else; symbols are below ``size``."""

    def __init__(self, symbols: list[int], size: int):
        n = len(symbols)
        first, last, link, child = [0], [0], [0], {}
        node = edge = length = open_suffixes = 0
        for i, symbol in enumerate(symbols):
            open_suffixes += 1
            pending = 0
            while open_suffixes:
                if not length:
                    edge = i
                key = node * size + symbols[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i)
                    last.append(n)
                    link.append(0)
                    if pending:
                        link[pending] = node
                        pending = 0
                else:
                    start = first[below]
                    span = last[below] - start
                    if length >= span:
                        edge += span
                        length -= span
                        node = below
                        continue
                    if symbols[start + length] == symbol:
                        length += 1
                        if pending:
                            link[pending] = node
                        break
                    fork = len(first)
                    child[key] = fork
                    child[fork * size + symbol] = fork + 1
                    child[fork * size + symbols[start + length]] = below
                    first += [start, i]
                    last += [start + length, n]
                    link += [0, 0]
                    first[below] = start + length
                    if pending:
                        link[pending] = fork
                    pending = fork
                open_suffixes -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - open_suffixes + 1
        self.n, self.nodes = n, len(first)
        keys = np.fromiter(child.keys(), dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self.kids = np.fromiter(child.values(), dtype=np.int64, count=len(child))[order]
        self.symbol = keys[order] % size
        self.at = np.searchsorted(keys[order] // size, np.arange(self.nodes + 1))
        self.span = np.array(last) - np.array(first)
        self._tour()

    def _tour(self) -> None:
        """Euler tour: string depth of every visit, and the visit of every suffix's leaf."""
        kids, span, upto = self.kids.tolist(), self.span.tolist(), self.at[1:].tolist()
        following, depth = self.at[:-1].tolist(), [0] * self.nodes
        visits, stack = [], [0]
        while stack:
            node = stack[-1]
            visits.append(node)
            k = following[node]
            if k < upto[node]:
                below = kids[k]
                following[node] = k + 1
                depth[below] = depth[node] + span[below]
                stack.append(below)
            else:
                stack.pop()
        visits = np.array(visits)
        depth = np.array(depth)
        leaf = self.at[:-1] == self.at[1:]
        seen = np.flatnonzero(leaf[visits])
        self.leaf_depth = depth[visits[seen]]
        self.depths = depth[visits]
        self.place = np.zeros(self.n, dtype=np.int64)
        self.place[self.n - self.leaf_depth] = seen

    def ranks(self) -> tuple[np.ndarray, np.ndarray]:
        """Rank of every suffix in the order of symbols and in the reverse order; the end (0) comes first in both."""
        rank = np.zeros((2, self.n), dtype=np.int64)
        rank[0, self.n - self.leaf_depth] = np.arange(self.n)
        owner = np.repeat(np.arange(self.nodes), np.diff(self.at))
        turned = self.kids[np.lexsort((np.where(self.symbol == 0, 1 << 62, self.symbol), owner))].tolist()  # popped from the end
        at, span = self.at.tolist(), self.span.tolist()
        stack, found = [(0, 0)], []
        while stack:
            node, depth = stack.pop()
            a, b = at[node], at[node + 1]
            if a == b:
                found.append(depth)
            else:
                stack += [(below, depth + span[below]) for below in turned[a:b]]
        rank[1, self.n - np.array(found)] = np.arange(self.n)
        return rank[0], rank[1]

    def extensions(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of suffixes i and j, i different from j: depths of lowest common ancestors.

        Table levels are built one after another, and each answers the queries of its width, so two levels are held.
        """
        a, b = np.minimum(self.place[i], self.place[j]), np.maximum(self.place[i], self.place[j])
        level = np.frexp((b - a + 1).astype(float))[1] - 1
        out, row = np.zeros(len(i), dtype=np.int64), self.depths
        for k in range(int(level.max()) + 1 if len(level) else 0):
            if k:
                half = 1 << (k - 1)
                row = np.minimum(row[:-half], row[half:])
            q = np.flatnonzero(level == k)
            out[q] = np.minimum(row[a[q]], row[b[q] - (1 << k) + 1])
        return out


def _next_smaller(rank: np.ndarray) -> np.ndarray:
    """For every place the next place of lower rank; the last place has the lowest rank of all."""
    ranks, out, stack = rank.tolist(), [0] * len(rank), []
    for i in range(len(ranks) - 1, -1, -1):
        r = ranks[i]
        while stack and ranks[stack[-1]] > r:
            stack.pop()
        out[i] = stack[-1] if stack else i
        stack.append(i)
    return np.array(out)


def runs_of(words: Sequence[np.ndarray], min_words: int = 24, repeats: int = 3) -> list[np.ndarray]:
    """Runs of each integer sequence: rows ``start, length, period``, by start, then period; all sequences share two trees."""
    parts, borders, at = [], [], 0
    for k, w in enumerate(words):
        borders.append(at)
        parts += [w, [-1 - k]]  # a separator of its own after each sequence: nothing repeats across it
        at += len(w) + 1
    names, ids = np.unique(np.concatenate(parts)[:-1] if parts else np.zeros(0, dtype=np.int64), return_inverse=True)
    size, n = len(names) + 1, len(ids)
    none = [np.zeros((0, 3), dtype=np.int64) for _ in words]
    if not n:
        return none
    symbols = (ids + 1).tolist()
    ahead = SuffixTree([*symbols, 0], size)
    starts, ends = [], []
    for rank in ahead.ranks():
        starts.append(np.arange(n))
        ends.append(_next_smaller(rank)[:n])
    i, j = np.concatenate(starts), np.concatenate(ends)
    right = np.where(j < n, ahead.extensions(i, np.minimum(j, n)), 0)
    behind = SuffixTree([*symbols[::-1], 0], size)
    left = np.where(i > 0, behind.extensions(n - i, n - j), 0)
    period, start = j - i, i - left
    length = j + right - start
    good = length >= np.maximum(min_words, repeats * period)
    found = np.unique(np.column_stack([start, period, length])[good], axis=0)[:, [0, 2, 1]] if good.any() else np.zeros((0, 3), dtype=np.int64)
    owner = np.searchsorted(borders, found[:, 0], side="right") - 1
    return [found[owner == k] - [[borders[k], 0, 0]] if len(found) else none[k] for k in range(len(words))]


def candidates(hashes: np.ndarray, min_words: int = 24, repeats: int = 3) -> list[tuple[int, int]]:
    """Stretches [a, b) of a word sequence outside of which no run lies, and each run in one of them."""
    width, n = min_words - min_words // repeats, len(hashes)
    if n < min_words:
        return []
    gram, factor, have = hashes.astype(np.uint64), MIX, 1
    total = None
    for bit in range(width.bit_length()):  # doubling: grams of 1, 2, 4, ... words joined to the wanted width
        if width >> bit & 1:
            total = gram if total is None else gram[: len(total) - have] * np.uint64(pow(MIX, width & (have - 1), 1 << 64)) + total[have:]
        if width >> (bit + 1):
            gram = gram[:-have] * np.uint64(factor) + gram[have:]
            have, factor = have * 2, factor * factor % (1 << 64)
    gram = total
    held = np.sort(gram)
    if not (held[1:] == held[:-1]).any():
        return []
    place, part, room = np.arange(len(gram)), np.zeros(len(gram), dtype=np.int64), np.full(len(gram), n // repeats)
    first = True
    while True:
        o = np.lexsort((gram, part))
        same = (gram[o[1:]] == gram[o[:-1]]) & (part[o[1:]] == part[o[:-1]]) & (place[o[1:]] - place[o[:-1]] <= room[o[1:]])
        keep = np.zeros(len(place), dtype=bool)
        keep[o[1:][same]] = True
        keep[o[:-1][same]] = True
        if keep.all() and not first:
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=len(place) + 1))
            return [(int(place[a]), int(place[b - 1]) + width) for a, b in zip(edges[:-1], edges[1:])]
        first = False
        gram, place = gram[keep], place[keep]
        if not len(place):
            return []
        part = np.cumsum(np.diff(place, prepend=place[0]) > width)
        edges = np.flatnonzero(np.diff(part, prepend=-1, append=len(place) + 1))
        sizes = place[edges[1:] - 1] + width - place[edges[:-1]]
        room = np.repeat(np.where(sizes >= min_words, sizes // repeats, -1), np.diff(edges))


def _solve(waiting: list[tuple[int, list[bytes], list[tuple[int, int]]]], min_words: int, repeats: int) -> dict[int, np.ndarray]:
    """Runs of the documents in ``waiting``: place in the batch, words, stretches."""
    number: dict[bytes, int] = {}
    pieces, where = [], []
    for place, words, stretches in waiting:
        for a, b in stretches:
            pieces.append(np.fromiter((number.setdefault(w, len(number)) for w in words[a:b]), dtype=np.int64, count=b - a))
            where.append((place, a))
    out: dict[int, list[np.ndarray]] = {}
    for (place, a), runs in zip(where, runs_of(pieces, min_words, repeats)):
        out.setdefault(place, []).append(runs + [[a, 0, 0]])
    return {place: np.concatenate(runs) for place, runs in out.items()}


def _collapse(words: list[bytes], runs: np.ndarray) -> bytes:
    """Words outside the repeats, joined by one space: of each run the first period stays."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


Rewrite = Callable[[object, list[bytes]], list[bytes]]


def find_runs(docs: DataFrame, min_words: int = 24, repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", rewrite: Rewrite | None = None) -> DataFrame:
    """``id_col, runs, collapsed`` per row: runs of at least ``min_words`` words and ``repeats`` periods, by start, then period.

    Words are separated by ASCII white space. ``runs`` holds structs of start (word number), length and period (words);
    ``collapsed`` is the text without the repeats of any run, words joined by one space. ``rewrite(id, words)`` may change
    the words first. A null or empty text has no words, no runs and an empty ``collapsed``. Repeated rows each get their
    own row, an empty table gives an empty result, other columns of ``docs`` are not looked at, and texts of any length
    are taken whole.
    """
    if repeats < 2 or min_words < repeats:
        raise ValueError("needs at least two repeats and as many words")
    kind = docs.schema[id_col].dataType.simpleString()
    item = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def handle(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = rows.column(0), rows.column(1).to_pylist()
        all_words, found, waiting, size = [], {}, [], 0
        for k, text in enumerate(texts):
            words = text.encode("utf-8", "surrogatepass").split() if text else []
            words = rewrite(ids[k].as_py(), words) if rewrite else words
            all_words.append(words)
            stretches = candidates(np.fromiter(map(hash, words), dtype=np.int64, count=len(words)), min_words, repeats) if len(words) >= min_words else []
            if stretches:
                waiting.append((k, words, stretches))
                size += sum(b - a for a, b in stretches)
                if size >= TREE_WORDS:
                    found |= _solve(waiting, min_words, repeats)
                    waiting, size = [], 0
        found |= _solve(waiting, min_words, repeats)
        empty = np.zeros((0, 3), dtype=np.int64)
        runs = [found.get(k, empty) for k in range(len(texts))]
        flat = np.concatenate([*runs, empty])
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, c])) for c in range(3)], fields=list(item)))
        collapsed = pa.array([_collapse(w, r) for w, r in zip(all_words, runs)], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([ids, lists, collapsed], names=[id_col, "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in byte_steps(batch, 1):
                yield handle(rows)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length/period; ties go to the smallest start, then period. Null without runs."""
    ahead = lambda x, y: (x["length"] * y["period"] > y["length"] * x["period"]) | (
        (x["length"] * y["period"] == y["length"] * x["period"]) & (F.struct(x["start"], x["period"]) < F.struct(y["start"], y["period"])))
    return F.aggregate(runs, F.get(runs, F.lit(0)), lambda best, x: F.when(ahead(x, best), x).otherwise(best))
