"""Problem 8: passages of evaluation items inside a corpus, by greedy string tiling.

Windows of ``seed`` words of the items are hashed (Karp-Rabin) and joined with
the rolling hashes of all windows of the documents; seeds that follow each
other are maximal matches, and in each (item, text part) pair the longest
unmarked match is marked again and again, so reordered passages count together
against a threshold of the item's coverage.

Items are the small side as a rule: up to :data:`INDEX_WORDS` words, which is
checked, their windows are one index that all documents stream past, and no
document is moved.  More items are joined to the documents by a shuffle on the
hashes of windows, which gives the same rows.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.mail import text_parts

#: Words a passage must have, all consecutive in document and item.
MIN_MATCH = 10
#: Words of a seed, and share of an item's words in tiles, that show reordered passages.
SHINGLE, COVERAGE = 5, 0.5
#: Largest index that is sent to the executors, in words of items; more items are joined by a shuffle.
INDEX_WORDS = 2_000_000
#: Seeds verified at once.
SLAB = 1 << 16

_WORDS = re.compile(r"[^\W_]+")
_BASE = np.uint64(1_000_003)


def words(text: str) -> list[str]:
    """Longest strings of letters and digits, ignoring case."""
    return _WORDS.findall(text.lower())


def rolling(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes (modulo 2**64) of all windows of k word numbers."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * _BASE + ids[i : i + n]
    return h


class SeedIndex:
    """Words and window hashes of items; all items stand in one array, the number 0 (no word) between them."""

    def __init__(self, items: list[tuple[int, str]], k: int = MIN_MATCH):
        self.k, self.vocabulary = k, {}
        self.ids, ids, sizes = [i for i, _ in items], [], []
        for _, text in items:
            found = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text or "")]
            sizes.append(len(found))
            ids.extend(found)
            ids.append(0)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.words = np.array(ids, dtype=np.uint64)
        h, at = _windows(self.words, k)
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]

    def spans(self, text: np.ndarray) -> np.ndarray:
        """Maximal matches in a text, rows (item, place in text, place in item, words) in order; hash hits are verified word by word."""
        h, p = _windows(text, self.k)
        lo = np.searchsorted(self.hashes, h, "left")
        n = np.searchsorted(self.hashes, h, "right") - lo
        hit = np.flatnonzero(n)
        seeds = []
        inside = np.arange(self.k)
        for some in np.split(hit, np.searchsorted(np.cumsum(n[hit]), np.arange(SLAB, int(n[hit].sum()) + 1, SLAB))) if len(hit) else []:
            count = n[some]
            at = np.repeat(p[some], count)
            q = self.at[np.repeat(lo[some] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))]
            same = (text[at[:, None] + inside] == self.words[q[:, None] + inside]).all(axis=1)
            seeds.append(np.stack((at[same], q[same])))
        if not seeds or not (both := np.concatenate(seeds, axis=1)).size:
            return np.zeros((0, 4), dtype=np.int64)
        at, q = both
        order = np.lexsort((at, q - at))  # by diagonal, which lies in several items, and place
        at, q = at[order], q[order]
        first = np.flatnonzero(np.concatenate(([True], (np.diff(at) != 1) | (np.diff(q) != 1))))
        owner = np.searchsorted(self.starts, q[first], "right") - 1
        found = np.stack((owner, at[first], q[first] - self.starts[owner], np.diff(np.append(first, len(at))) + self.k - 1), axis=1)
        return found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]


def _windows(ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of k words, none of them 0."""
    h = rolling(ids, k)
    known = np.concatenate(([0], np.cumsum(ids != 0)))
    at = np.flatnonzero(known[k:] - known[:-k] == k) if len(h) else np.zeros(0, dtype=np.int64)
    return h[at], at


def tiles(spans: list[tuple[int, int, int]], text_words: int, item_words: int, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of maximal matches (place in text, place in item, words): the longest first, none overlapping another in text or item."""
    heap = [(-n, p, a) for p, a, n in spans]
    heapq.heapify(heap)
    in_text, in_item = np.zeros(text_words, dtype=bool), np.zeros(item_words, dtype=bool)
    out: list[tuple[int, int, int]] = []
    while heap:
        n, p, a = heapq.heappop(heap)
        free = ~(in_text[p : p - n] | in_item[a : a - n])
        if free.all():
            in_text[p : p - n] = in_item[a : a - n] = True
            out.append((p, a, -n))
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(np.int8), [0]))))
        for s, z in zip(edge[::2].tolist(), edge[1::2].tolist()):
            if z - s >= k:
                heapq.heappush(heap, (s - z, p + s, a + s))
    return out


def _pairs(index: SeedIndex, text: np.ndarray, min_coverage: float) -> Iterator[tuple]:
    """(item, tiles, longest, covered words, coverage) of the items that a text part holds enough of."""
    spans = index.spans(text)
    owners, cuts = np.unique(spans[:, 0], return_index=True)
    for o, some in zip(owners.tolist(), np.split(spans[:, 1:], cuts[1:])):
        size = int(index.sizes[o])
        found = tiles([tuple(x) for x in some.tolist()], len(text), size, index.k)
        covered = sum(n for _, _, n in found)
        if covered >= min_coverage * size:
            yield index.ids[o], len(found), found[0][2], covered, covered / size


_COLUMNS = ["item_id", "doc_id", "n_tiles", "longest", "covered_words", "coverage"]
_SCHEMA = "item_id long, doc_id long, n_tiles long, longest long, covered_words long, coverage double"


def _texts(text: str | None, mail: bool) -> list[str]:
    return [p.text for p in text_parts(text)] if mail else [text or ""]


def _search(index: SeedIndex, mail: bool, min_coverage: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k, get = index.k, index.vocabulary.get
        for pdf in batches:
            rows: list[tuple] = []
            # all texts of the batch in one array, word number 0 (in no item) between them
            ids: list[int] = []
            parts: list[tuple[int, int, int]] = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                for t in _texts(text, mail):
                    start = len(ids)
                    ids.extend([get(w, 0) for w in words(t)])
                    parts.append((doc, start, len(ids)))
                    ids.append(0)
            line = np.array(ids, dtype=np.uint64)
            h, at = _windows(line, k)
            if len(h) and len(index.hashes):
                lo = np.minimum(np.searchsorted(index.hashes, h), len(index.hashes) - 1)
                at = at[index.hashes[lo] == h]
                for i in sorted(set((np.searchsorted([s for _, s, _ in parts], at, side="right") - 1).tolist())):
                    doc, s, z = parts[i]
                    rows.extend((item, doc, *found) for item, *found in _pairs(index, line[s:z], min_coverage))
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


@lru_cache(maxsize=1 << 18)
def _word_number(word: str) -> int:
    return xxhash.xxh64_intdigest(word) | 1


def _hashes(key: str, mail: bool, k: int):
    """Different window hashes of the texts of each batch, for the join by a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: dict[tuple[int, int], None] = {}
            for key_value, text in zip(pdf[key], pdf["text"]):
                for t in _texts(text, mail):
                    h = rolling(np.array([_word_number(w) for w in words(t)], dtype=np.uint64), k)
                    out.update(dict.fromkeys((x, key_value) for x in h.view(np.int64).tolist()))
            yield pd.DataFrame(list(out), columns=["h", key])

    return run


def _verify(mail: bool, k: int, min_coverage: float):
    """Tiles of candidate pairs (item_id, item_text, doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for (item, item_text), docs in pdf.groupby(["item_id", "item_text"], sort=False):
                index = SeedIndex([(item, item_text)], k)
                rows += [r for part in _search(index, mail, min_coverage)(iter([docs[["doc_id", "text"]]])) for r in part.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=_COLUMNS)

    return run


def leaked_items(documents: DataFrame, items: DataFrame, mail: bool = True, seed: int = MIN_MATCH, min_coverage: float = 0.0, index_words: int = INDEX_WORDS) -> DataFrame:
    """(item_id, doc_id, n_tiles, longest, covered_words, coverage): documents (doc_id, text) that hold passages of items (item_id, text).

    seed: words that a tile has at least; min_coverage: share of the item's
    words that the tiles of one text part cover at least (0: one tile is
    enough).  With ``SHINGLE`` and ``COVERAGE`` passages are found that stand in
    another order and in pieces.  Of several parts of one mail the best covered
    one is given.  Null and empty texts match nothing; items shorter than
    ``seed`` words cannot occur; repeated rows of either table give one row;
    rows with a null id are left out.  ``mail``: texts are raw messages,
    searched in each text part.
    """
    tests = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    size = tests.agg(F.sum(F.expr("length(text) div 2 + 1"))).first()[0] or 0  # no text has more words
    if size <= index_words:
        index = SeedIndex([(r.item_id, r.text) for r in tests.orderBy("item_id", "text").collect()], seed)
        found = docs.mapInPandas(_search(index, mail, min_coverage), _SCHEMA)
    else:
        of_items = tests.mapInPandas(_hashes("item_id", False, seed), "h long, item_id long").distinct()
        of_docs = docs.mapInPandas(_hashes("doc_id", mail, seed), "h long, doc_id long")
        pairs = of_docs.join(of_items, "h").select("item_id", "doc_id").distinct()
        texts = pairs.join(tests.withColumnRenamed("text", "item_text"), "item_id").join(docs, "doc_id")
        found = texts.mapInPandas(_verify(mail, seed, min_coverage), _SCHEMA)
    best = F.max(F.struct("covered_words", "longest", "n_tiles", "coverage"))
    return found.groupBy("item_id", "doc_id").agg(best.alias("b")).select("item_id", "doc_id", "b.n_tiles", "b.longest", "b.covered_words", "b.coverage")
