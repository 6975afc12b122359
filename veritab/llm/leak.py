"""Evaluation passages inside training documents: shared trigrams and exact bounds, then Smith-Waterman alignment.

Plan.  One scan of the corpus, without a shuffle; whether a document leaks depends on itself and the passages alone.

1. Words are lower-cased letters and digits (line-end hyphens closed); words that no passage has become 0, so a document is
   a short integer array.  Its word trigrams that passages hold are counted for every passage that holds them, however
   common they are.
2. A passage is a candidate unless a bound on its held words, which no alignment exceeds, shows that it can't reach
   ``min_cover`` (``Passages.candidates``).  The bounds lose no pair; they only save alignments.
3. Each candidate is aligned with affine-gap Smith-Waterman (match 1, mismatch -1, gap opening -2, extension 0, so that one
   path runs through several pieces).  A word counts as held if it lies in a run of one diagonal that has at least
   ``min_run`` right words, three of them one after another; single wrong words inside are included.  The item leaked if held / passage words >= ``min_cover``.

Passages are handled in blocks of ``block_items`` (a bound on what a task keeps in memory); all blocks are processed.
Items with the same words are one passage; its rows are given for each of them.

Defined results: null, empty or blank texts and passages give no rows; identical documents each give their rows; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.text import WordIds, words

N = 3
REACH = 8


def _grams(ids: np.ndarray) -> np.ndarray:
    """Codes of the word trigrams at each place; 0 where a word is 0. Ids stay below 2**21."""
    if len(ids) < N:
        return np.zeros(0, np.int64)
    a = ids.astype(np.int64)
    code = (a[:-2] << 42) | (a[1:-1] << 21) | a[2:]
    return np.where((a[:-2] > 0) & (a[1:-1] > 0) & (a[2:] > 0), code, 0)


class Passages:
    """The searched passages as classes of equal words, and their trigrams as sorted codes with the classes that hold them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.members: list[list[int]] = []  # the item ids of each class
        classes: dict[bytes, int] = {}
        owners: dict[int, dict[int, int]] = {}
        for item, passage in items:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(passage or "")], np.int32)
            if not len(ids):
                continue
            k = classes.setdefault(ids.tobytes(), len(self.words))
            if k < len(self.words):
                self.members[k].append(item)
                continue
            self.words.append(ids)
            self.members.append([item])
            for g, at in zip(*np.unique(_grams(ids), return_index=True)):
                owners.setdefault(int(g), {})[k] = int(at)
        self.codes = np.array(sorted(owners), np.int64)
        self.owners = [owners[int(c)] for c in self.codes]
        self.start = np.cumsum([0, *map(len, self.owners)])
        self.own = np.array([k for o in self.owners for k in o], np.int64)
        self.place = np.array([at for o in self.owners for at in o.values()], np.int64)
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.masks: list[dict[int, int]] = []  # of each class: the places of a word as bits
        for ids in self.words:
            mask: dict[int, int] = {}
            for i, w in enumerate(ids.tolist()):
                mask[w] = mask.get(w, 0) | 1 << i
            self.masks.append(mask)

    def common(self, k: int, doc: list[int]) -> int:
        """Length of the longest common subsequence of class ``k`` and a document, the places of the passage as bits."""
        mask, full = self.masks[k], (1 << int(self.size[k])) - 1
        rest = full
        for w in doc:
            if m := mask.get(w, 0) & rest:
                rest = ((rest + m) | (rest - m)) & full
        return int(self.size[k]) - rest.bit_count()

    def candidates(self, ids: np.ndarray, min_cover: float) -> list[int]:
        """The classes of which a document may hold ``min_cover``, by two bounds that no alignment exceeds.

        Held words lie within ``REACH`` words of shared trigrams, but for three foreign ones between two such stretches.  The best path
        has right - wrong - 2 * gaps = score, hence held <= right + wrong <= 2 * right - score, where right is at most the longest
        common subsequence and the score at least the longest run of right words.
        """
        codes = _grams(ids)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        pos = np.flatnonzero((self.codes[at] == codes) & (codes > 0))
        if not len(pos):
            return []
        gram = at[pos]
        n = self.start[gram + 1] - self.start[gram]
        entry = np.repeat(self.start[gram] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        order = np.argsort(self.own[entry], kind="stable")
        own, p = self.own[entry][order], np.repeat(pos, n)[order]
        diagonal = self.place[entry][order] - p
        step = np.diff(p)
        new = np.r_[True, own[1:] != own[:-1]]
        first = np.flatnonzero(new)
        width = N + 2 * REACH
        near = np.add.reduceat(np.where(new, width, np.r_[0, np.minimum(step, width + 3)]), first)
        starts = np.flatnonzero(new | np.r_[True, (step != 1) | (np.diff(diagonal) != 0)])
        run = np.maximum.reduceat(np.diff(np.r_[starts, len(p)]), np.searchsorted(starts, first)) + N - 1
        need = min_cover * self.size[own[first]]
        ends, out = np.r_[first[1:], len(p)], []
        for x in np.flatnonzero(near >= need):
            k = int(own[first[x]])
            around = np.unique(p[first[x] : ends[x], None] + np.arange(-REACH, REACH + N))
            around = around[(around >= 0) & (around < len(ids))]
            if 2 * self.common(k, ids[around].tolist()) - run[x] >= need[x]:
                out.append(k)
        return out


def _shorten(passage: np.ndarray, doc: np.ndarray, reach: int = REACH) -> np.ndarray:
    """The parts of ``doc`` that can hold runs of the passage, with three foreign words between them.

    A run has three right words one after another, so it lies about a shared trigram; ``reach`` words on either side stay.
    """
    codes = _grams(doc)
    at = np.flatnonzero(np.isin(codes, _grams(passage)) & (codes > 0))
    keep = np.zeros(len(doc) + 2 * reach + N, np.int32)
    np.add.at(keep, at, 1)
    np.add.at(keep, at + 2 * reach + N, -1)
    near = np.cumsum(keep)[reach : reach + len(doc)] > 0
    mask = np.zeros(int(max(passage.max(), doc.max(initial=0))) + 1, bool)
    mask[passage] = True
    d = np.where(near & mask[doc], doc, 0)
    zero = d == 0
    if len(d) > 3:
        drop = np.zeros(len(d), bool)
        drop[3:] = zero[3:] & zero[2:-1] & zero[1:-2] & zero[:-3]
        d = d[~drop]
    return d


def held_words(pairs: list[tuple[np.ndarray, np.ndarray]], min_run: int = 4) -> list[int]:
    """For each (passage, document): words of the passage on the best affine-gap Smith-Waterman path, gap extension free."""
    pairs = [(p, _shorten(p, d) if len(p) and len(d) else d) for p, d in pairs]
    move, src_up, src_left, _, top_at = _align(pairs)
    return [_trace(move[:, x], src_up[:, x], src_left[:, x], *pairs[x], *map(int, top_at[x]), min_run) for x in range(len(pairs))]


def best_scores(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
    """The score of the best path of each pair."""
    return _align(pairs)[3].tolist()


def _align(pairs: list[tuple[np.ndarray, np.ndarray]]):
    """Moves, their sources, best scores and where they end; all pairs advance together, a row of the matrix at a time."""
    m, n, k = max(len(p) for p, _ in pairs), max(len(d) for _, d in pairs), len(pairs)
    ps, ds = np.full((k, m), -1, np.int32), np.full((k, n), -2, np.int32)
    for x, (p, d) in enumerate(pairs):
        ps[x, : len(p)], ds[x, : len(d)] = p, d
    h = np.zeros((k, n + 1), np.int32)
    up_max, up_row = np.zeros((k, n + 1), np.int32), np.zeros((k, n + 1), np.int16)
    move = np.zeros((m + 1, k, n + 1), np.int8)  # 0 stop, 1 diagonal, 2 from the left, 3 from above
    src_up = np.zeros((m + 1, k, n + 1), np.int16)
    src_left = np.zeros((m + 1, k, n + 1), np.int32)
    cols = np.broadcast_to(np.arange(n + 1, dtype=np.int32), (k, n + 1))
    top, top_at = np.zeros(k, np.int32), np.zeros((k, 2), np.int32)
    for i in range(1, m + 1):
        best = np.zeros((k, n + 1), np.int32)
        best[:, 1:] = h[:, :-1] + np.where(ds == ps[:, i - 1 : i], 1, -1)
        mv = (best > 0).astype(np.int8)
        np.maximum(best, 0, out=best)
        better = up_max - 2 > best
        best[better], mv[better] = (up_max - 2)[better], 3
        src_up[i] = up_row
        run = np.maximum.accumulate(best, axis=1)
        rise = np.ones((k, n + 1), bool)
        rise[:, 1:] = run[:, 1:] > run[:, :-1]
        first = np.maximum.accumulate(np.where(rise, cols, 0), axis=1)
        src_left[i, :, 1:] = first[:, :-1]
        left = np.zeros((k, n + 1), np.int32)
        left[:, 1:] = run[:, :-1] - 2
        better = left > best
        best[better], mv[better] = left[better], 2
        h, move[i] = best, mv
        higher = best > up_max
        up_max[higher], up_row[higher] = best[higher], i
        at = best.argmax(axis=1)
        value = best[np.arange(k), at]
        new = value > top
        top[new], top_at[new] = value[new], np.stack([np.full(k, i), at], 1)[new]
    return move, src_up, src_left, top, top_at


def _trace(move, src_up, src_left, passage, doc, i: int, j: int, min_run: int) -> int:
    total, run = 0, []

    def close() -> int:
        while run and not run[-1]:
            run.pop()
        while run and not run[0]:
            run.pop(0)
        return len(run) if sum(run) >= min_run else 0

    while i > 0 and j > 0 and move[i, j]:
        if move[i, j] == 1:
            run.append(bool(doc[j - 1] == passage[i - 1]))
            i, j = i - 1, j - 1
            continue
        total += close()
        run = []
        if move[i, j] == 2:
            j = int(src_left[i, j])
        else:
            i = int(src_up[i, j])
    return total + close()


def leaks(
    documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "passage",
    min_cover: float = 0.5, min_run: int = 4, block_items: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, cover): every document that holds at least ``min_cover`` of an item's passage."""
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    held = items.select(F.col(item_col).cast("long"), F.col(passage_col)).where(F.col(passage_col).isNotNull())
    rows = [tuple(r) for r in held.distinct().orderBy(item_col).toLocalIterator()]
    out = spark.createDataFrame([], "doc_id long, item_id long, cover double")
    for k in range(0, len(rows), block_items):
        found = Passages(rows[k : k + block_items])
        if len(found.codes):
            out = out.union(docs.mapInPandas(_scan(found, min_cover, min_run), "doc_id long, item_id long, cover double"))
    return out


def _scan(found: Passages, min_cover: float, min_run: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words_of = WordIds(found.vocab)
        for pdf in batches:
            todo = []
            for doc, text in zip(pdf["id"].to_numpy(), pdf["text"]):
                ids = words_of.of(text)
                todo += [(int(doc), k, ids) for k in found.candidates(ids, min_cover)]
            todo.sort(key=lambda x: len(x[2]))  # pairs of like size advance together
            out, k = [], 0
            while k < len(todo):
                step = max(1, min(256, 100_000 // (len(todo[min(k + 255, len(todo) - 1)][2]) + 1)))
                part = todo[k : k + step]
                k += step
                for (d, i, _), n in zip(part, held_words([(found.words[i], w) for _, i, w in part], min_run)):
                    if n >= min_cover * len(found.words[i]):
                        out += [(d, item, n / len(found.words[i])) for item in found.members[i]]
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "cover"])

    return run
