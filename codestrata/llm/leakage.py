"""Evaluation texts leaking into training text.

One Aho-Corasick automaton over the word trigrams of the normalised test passages scans every text
once. A stretch of L >= 20 passage words with at most L/5 edits keeps at least 2L/5 - 2 trigrams, so
the trigram hits are a complete candidate search; an exact alignment then decides.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.normal import words_of, words_with_offsets
from codestrata.session import spread

SEED = 3  # words of a seed
WINDOW = 40  # document words in which a true stretch has at least LEAST seeds, whatever its length
LEAST = 6


def leaks(item: list[int], text: np.ndarray, stretch: int = 20, one_in: int = 5) -> bool:
    """Whether `text` holds `stretch` or more consecutive words of `item` with at most one edit in `one_in` words.

    Exact: a dynamic programme over (words of the stretch so far, capped; position in text) that keeps the
    largest value of stretch words minus one_in times edits; the answer is whether it can end at 0 or above.
    """
    low = np.int32(-(10**6))
    size = len(text) + 1
    before = np.full((stretch + 1, size), low, dtype=np.int32)
    before[0] = 0
    steps = one_in * np.arange(size, dtype=np.int32)
    for word in item:
        gain = np.where(text == word, 1, 1 - one_in).astype(np.int32)
        moved = before + np.int32(1 - one_in)  # the passage's word was dropped
        np.maximum(moved[:, 1:], before[:, :-1] + gain, out=moved[:, 1:])  # kept or replaced
        after = np.empty_like(before)
        after[0] = 0
        after[1:] = moved[:-1]
        np.maximum(after[stretch], moved[stretch], out=after[stretch])
        # words added to the text: each costs one_in
        after[1:] = np.maximum.accumulate(after[1:] + steps, axis=1) - steps
        if after[stretch].max() >= 0:
            return True
        before = after
    return False


def promising(chain: list[tuple[int, int]], stretch: int = 20, one_in: int = 5) -> bool | None:
    """What the seed hits (place in text, place in passage) alone say: True, False, or None for undecided.

    True: a whole stretch without any edit. False: no chain of hits can reach a value of 0. Between two
    successive hits of an alignment every seed is broken, and an edit breaks SEED seeds at most, so the edits
    between them are at least the broken seeds over SEED, and at least the change of diagonal.
    """
    present = set(chain)
    for k, p in chain:
        if (k - 1, p - 1) not in present:
            run = 1
            while (k + run, p + run) in present:
                run += 1
            if run + SEED - 1 >= stretch:
                return True
    if len(chain) > 60:
        return None
    for i, (k0, p0) in enumerate(chain):
        best = {i: SEED}  # value of the best chain from hit i to hit j
        for j in range(i + 1, len(chain)):
            k, p = chain[j]
            top = None
            for h, value in best.items():
                gap, shift = p - chain[h][1], (k - p) - (chain[h][0] - chain[h][1])
                if gap > 0 and k > chain[h][0] and (shift == 0 or gap >= SEED or k - chain[h][0] >= SEED):
                    value += gap - one_in * max(-(-(gap - 1) // SEED), abs(shift))
                    if top is None or value > top:
                        top = value
            if top is not None:
                best[j] = top
        for j, value in best.items():
            missing = max(0, stretch - (chain[j][1] - p0 + SEED))
            if value + missing - one_in * -(-missing // SEED) >= 0:
                return None
    return False


class Passages:
    """The automaton over a block of passages; built once per Python worker."""

    def __init__(self, items: list[tuple[int, str]], stretch: int = 20, one_in: int = 5):
        self.stretch, self.one_in = stretch, one_in
        self.ids: list[int] = []
        self.words: list[list[int]] = []
        self.number: dict[str, int] = {}
        seeds: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if len(words) < stretch:
                continue
            place = len(self.ids)
            self.ids.append(item_id)
            self.words.append([self.number.setdefault(w, len(self.number)) for w in words])
            for k in range(len(words) - SEED + 1):
                seeds[f" {' '.join(words[k : k + SEED])} "].append((place, k))
        self.automaton = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.automaton.add_word(seed, where)
        if seeds:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int]]:
        """(place of the item, first and last word in the text) of every passage that leaks into the text."""
        words = words_of(text)
        if not self.ids or len(words) < self.stretch - self.stretch // self.one_in:
            return []
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        starts: list[int] | None = None
        for end, where in self.automaton.iter(f" {' '.join(words)} "):
            if starts is None:
                starts = list(accumulate(map(len, words), lambda at, size: at + size + 1, initial=1))
            last = bisect_right(starts, end - 1) - 1
            for place, k in where:
                hits[place].append((last - SEED + 1, k))
        found = []
        numbers: np.ndarray | None = None
        for place, pairs in hits.items():
            if len(pairs) < LEAST:
                continue
            dense = self._dense(pairs)
            if dense is None:
                continue
            if numbers is None:
                numbers = np.array([self.number.get(w, -1) for w in words], dtype=np.int32)
            for first, last, chain in dense:
                known = promising(chain, self.stretch, self.one_in)
                if known is False:
                    continue
                lo, hi = max(0, first - WINDOW), min(len(words), last + WINDOW)
                if known or leaks(self.words[place], numbers[lo:hi], self.stretch, self.one_in):
                    found.append((place, first, last + SEED - 1))
                    break
        return found

    @staticmethod
    def _dense(pairs: list[tuple[int, int]]) -> list[tuple[int, int, list]] | None:
        """Document ranges of seeds, chained over gaps under WINDOW, that hold a dense window; None without any."""
        pairs = sorted(pairs)
        ranges, start = [], 0
        for i in range(1, len(pairs) + 1):
            if i == len(pairs) or pairs[i][0] - pairs[i - 1][0] > WINDOW:
                chain = pairs[start:i]
                left = 0
                for right in range(len(chain)):
                    while chain[right][0] - chain[left][0] > WINDOW:
                        left += 1
                    if right - left + 1 >= LEAST and len({k for _, k in chain[left : right + 1]}) >= LEAST:
                        ranges.append((chain[0][0], chain[-1][0], chain))
                        break
                start = i
        return ranges or None


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """Passages in blocks of at most block_chars characters (one longer passage is a block of its own)."""
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.where("item_id is not null and text is not null").select("item_id", "text").toLocalIterator():
        if block and size + len(row.text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    yield block


def leaked_spans(documents: DataFrame, items: DataFrame, stretch: int = 20, one_in: int = 5, block_chars: int = 8_000_000) -> DataFrame:
    """(doc_id, item_id, start, stop, excerpt_words): every document with a passage of an item, and where.

    start and stop are offsets into the original text, first of the item's dense ranges that align. The
    passages go to the workers in blocks of `block_chars` characters at most, one scan of the documents
    per block, so what is broadcast is bounded. Null, empty or short texts and items give no rows; a
    repeated document row gives its rows once per copy.
    """
    spark = documents.sparkSession
    texts = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"))
    out: DataFrame | None = None
    for block in _blocks(items, block_chars):
        shared = spark.sparkContext.broadcast(block)

        def batches(rows: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            passages = Passages(shared.value, stretch, one_in)
            for batch in rows:
                found = []
                for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist()):
                    if hits := passages.scan(text):
                        _, spans = words_with_offsets(text)
                        found += [(doc_id, passages.ids[p], spans[a][0], spans[b - 1][1], b - a) for p, a, b in hits]
                yield pd.DataFrame(found, columns=["doc_id", "item_id", "start", "stop", "excerpt_words"])

        part = texts.mapInPandas(batches, "doc_id long, item_id long, start int, stop int, excerpt_words int")
        out = part if out is None else out.unionByName(part)
    return out


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id), each pair once."""
    return leaked_spans(documents, items).select("doc_id", "item_id").distinct()


def leaks_per_item(documents: DataFrame, items: DataFrame) -> DataFrame:
    """For every item how many documents it leaked into (0 for none): item_id, suite, n_docs."""
    found = leaked_items(documents, items).groupBy("item_id").agg(F.count("*").alias("n_docs"))
    return items.select("item_id", "suite").distinct().join(found, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))
