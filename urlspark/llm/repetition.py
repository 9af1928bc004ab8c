"""Quality rules from repetition inside a text: suffix array and longest-common-prefix intervals over words.

Words are runs of anything but ASCII white space. A null or empty text has no words and fails the base rule.
Repeated rows are judged alone; ties (equal suffixes never occur, as texts end) and other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from urlspark.llm.common import codes, column, filled, map_batches, per_row, place, slices, texts, utf8, words

SYMBOLS = np.zeros(256, np.uint8)
SYMBOLS[list(b"#*$%&|<>")] = 1
BATCH_BYTES = 3_000_000  # of text handled at once; one longer text is handled alone
BATCH_WORDS = 400_000  # words sorted at once; one longer text is sorted alone
LEVEL_WORDS = 1_000_000  # longer texts keep no ranks per doubling but walk once through the array


@dataclass(frozen=True)
class Rules:
    """A repeat counts from ``min_repeat`` words on; a text is kept up to these limits."""

    min_repeat: int = 12
    max_covered: float = 0.3
    max_longest: int = 100
    min_words: int = 50
    max_windows: float = 0.5


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and for each place in it whether a new key begins."""
    order = np.argsort(keys)
    ordered = keys[order]
    head = np.ones(len(keys), bool)
    head[1:] = ordered[1:] != ordered[:-1]
    return order, head


def _open(head: np.ndarray) -> np.ndarray:
    """Places whose key occurs more than once."""
    last = np.ones(len(head), bool)
    last[:-1] = head[1:]
    return ~(head & last)


class WordSuffixes:
    """Suffix array over the words of several texts at once; suffixes of different texts never compare equal.

    Prefix doubling sorts only suffixes that are not yet told apart. The rank of a suffix is the
    first place of its group, so that ``ranks[k]`` are equal exactly if the first k words are.
    """

    def __init__(self, word: np.ndarray, owner: np.ndarray):
        self.n = n = len(word)
        self.levels: list[tuple[int, np.ndarray]] = []
        self.word, self.owner = word, owner
        self.array, head = _grouped(owner << 32 | word)
        rank = np.empty(n, np.int32)
        rank[self.array] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.levels.append((1, rank))
        slots, k = np.flatnonzero(_open(head)), 1
        while len(slots):
            suffix = self.array[slots]
            after = suffix + k
            next_rank = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            order, head = _grouped(rank[suffix].astype(np.int64) * (n + 1) + next_rank + 1)
            suffix = suffix[order]
            self.array[slots] = suffix
            rank = rank.copy()
            rank[suffix] = slots[np.maximum.accumulate(np.where(head, np.arange(len(slots)), 0))]
            k *= 2
            if n <= LEVEL_WORDS or k <= 2:
                self.levels.append((k, rank))
            slots = slots[_open(head)]

    def window_words(self) -> np.ndarray:
        """Whether each word lies in a 3-word window that its text holds twice or more."""
        hit = np.zeros(self.n, bool)
        if len(self.levels) > 1 and self.n > 2:
            one, two = self.levels[0][1], self.levels[1][1]
            order, head = _grouped(two[:-2].astype(np.int64) * (self.n + 1) + one[2:])
            at = order[_open(head)]
            at = at[self.owner[at] == self.owner[at + 2]]
            for i in range(3):
                hit[at + i] = True
        return hit

    def common_prefixes(self, least: int) -> np.ndarray:
        """Common words of each suffix with the one before it in the array; 0 where fewer than ``least``."""
        lcp = np.zeros(self.n + 1, np.int64)
        if self.n > LEVEL_WORDS:
            self._walk(lcp)
            lcp[lcp < least] = 0
            return lcp
        start = max((i for i, (k, _) in enumerate(self.levels) if k <= least), default=0)
        first = self.levels[start][1]
        at = np.flatnonzero(first[self.array[1:]] == first[self.array[:-1]]) + 1
        left, right, got = self.array[at - 1], self.array[at], np.zeros(len(at), np.int64)
        for k, rank in reversed(self.levels):
            a, b = left + got, right + got
            inside = (a < self.n) & (b < self.n)
            same = inside & (rank[np.minimum(a, self.n - 1)] == rank[np.minimum(b, self.n - 1)])
            got += np.where(same, k, 0)
        lcp[at] = np.where(got >= least, got, 0)
        return lcp

    def _walk(self, lcp: np.ndarray) -> None:
        """The same in text order, where the common prefix shrinks by one word at most; for one very long text."""
        place = np.empty(self.n, np.int64)
        place[self.array] = np.arange(self.n)
        word, owner, array, h = self.word, self.owner, self.array, 0
        for i, slot in enumerate(place.tolist()):
            if slot == 0:
                h = 0
                continue
            j = int(array[slot - 1])
            while i + h < self.n and j + h < self.n and word[i + h] == word[j + h] and owner[i + h] == owner[j + h]:
                h += 1
            lcp[slot] = h
            h = max(0, h - 1)

    def repeats(self, least: int) -> np.ndarray:
        """Length of the longest repeat that begins at each word.

        It is the value of the deepest LCP interval that holds the suffix, i.e. the larger of
        the common prefixes with its two neighbours in the array.
        """
        lcp = self.common_prefixes(least)
        out = np.zeros(self.n, np.int64)
        out[self.array] = np.maximum(lcp[:-1], lcp[1:])
        return out


def repeat_figures(word: np.ndarray, starts: np.ndarray, least: int) -> dict[str, np.ndarray]:
    """Per text: words in repeated 3-word windows; maximal repeats, words under their union, longest of them."""
    sizes = np.diff(starts)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if not len(word):
        zero = np.zeros(len(sizes), np.int64)
        return {"windows": zero, "covered": zero, "longest": zero, "maximal": zero}
    suffixes = WordSuffixes(word, owner)
    length = suffixes.repeats(least)
    longest = np.zeros(len(sizes), np.int64)
    at = np.flatnonzero(length)
    np.maximum.at(longest, owner[at], length[at])
    cover = np.zeros(len(word) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + length[at], -1)
    before = np.zeros(len(word), np.int64)
    before[1:] = np.where(owner[1:] == owner[:-1], length[:-1], 0)
    maximal = (length > 0) & (before <= length)  # the word in front doesn't belong to the same repeat
    return {
        "windows": per_row(suffixes.window_words(), starts),
        "covered": per_row(np.cumsum(cover[:-1]) > 0, starts),
        "longest": longest,
        "maximal": per_row(maximal, starts),
    }


def _duplicate_lines(strings: pa.Array) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    lines = pc.split_pattern(strings, "\n")
    sizes = pc.list_value_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    code, different = codes(lines.flatten())
    full = pc.not_equal(pc.binary_length(pc.ascii_trim_whitespace(different)), 0).to_numpy(zero_copy_only=False)
    key = np.repeat(np.arange(len(sizes)), sizes) << 32 | code
    order, head = _grouped(key)
    again = np.zeros(len(key), bool)
    again[order[~head]] = True
    return per_row(again & full[code], starts) if len(key) else np.zeros(len(sizes), np.int64)


def repetition_figures(strings: pa.Array, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """All figures and verdicts of an array of texts without nulls, some texts at a time."""
    sizes = np.diff(utf8(strings)[1])
    parts = [_figures(strings.slice(a, b - a), rules) for a, b in slices(sizes, BATCH_BYTES)]
    if not parts:
        return _figures(strings, rules)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _figures(strings: pa.Array, rules: Rules) -> dict[str, np.ndarray]:
    raw, offsets = utf8(strings)
    flat, starts = words(strings)
    code, _ = codes(flat)
    letters = np.concatenate([[0], np.cumsum(pc.utf8_length(flat).to_numpy(zero_copy_only=False), dtype=np.int64)])
    parts = [
        repeat_figures(code[starts[a]:starts[b]], starts[a:b + 1] - starts[a], rules.min_repeat)
        for a, b in slices(np.diff(starts), BATCH_WORDS)
    ]
    found = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
             for k in ("windows", "covered", "longest", "maximal")}
    n_words = np.diff(starts)
    base_failed = (n_words < rules.min_words) | (found["windows"] > rules.max_windows * n_words)
    repetitive = (found["covered"] > rules.max_covered * n_words) | (found["longest"] > rules.max_longest)
    return {
        "n_words": n_words, "word_chars": letters[starts[1:]] - letters[starts[:-1]],
        "n_symbols": per_row(SYMBOLS[raw], offsets), "n_dup_lines": _duplicate_lines(strings),
        "n_repeat_words": found["windows"], "base_failed": base_failed, "kept": ~(base_failed | repetitive),
        "covered_words": found["covered"], "longest_repeat": found["longest"], "n_maximal_repeats": found["maximal"],
    }


FIGURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, covered_words long, longest_repeat long, n_maximal_repeats long"
)


def repetition_report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row of figures and verdict per row of ``docs``; narrow, no shuffle."""
    kind = dict(docs.dtypes)[key]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = repetition_figures(texts(batch), rules)
            yield pa.RecordBatch.from_arrays([column(batch, "key"), *map(pa.array, found.values())], [key, *found])

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_batches(pairs, judge, f"`{key}` {kind}, {FIGURES}")


def keep_clean(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass the rules, with all their columns."""
    at = place(docs, text)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(repetition_figures(filled(batch.column(at)), rules)["kept"]))

    return map_batches(docs, drop, docs.schema)
