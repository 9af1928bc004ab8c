"""Character-level text expressions.

Everything here is a row-local Column. Counting is done with regular expressions over whole
strings rather than per-character lambdas: lambdas are interpreted per element, while one
regex pass is a tight loop. Entropies sort the characters of whole Arrow arrays of texts.

Java's ``.`` matches a whole code point under ``(?s)``, so lengths and grams agree with
code-point based text handling.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"\p{L}"
DIGIT = r"\p{Nd}²³¹"
ALNUM = r"\p{L}\p{N}"
UPPER = r"\p{Lu}"

WINDOW = 5


def count_class(text: Column, char_class: str) -> Column:
    """Number of characters of ``text`` inside the regex class body ``char_class``."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def count_not_class(text: Column, char_class: str) -> Column:
    return F.length(F.regexp_replace(text, f"[{char_class}]+", ""))


def count_sub(text: Column, piece: str) -> Column:
    """Non-overlapping occurrences of the literal ``piece``."""
    removed = F.length(text) - F.length(F.replace(text, F.lit(piece), F.lit("")))
    return removed if len(piece) == 1 else F.floor(removed / len(piece))


def count_matches(text: Column, pattern: str) -> Column:
    """Number of matches of ``pattern``.

    To count overlaps use ``first(?=rest)``: one character is consumed, the rest is looked
    at. (A fully zero-width pattern would also stop inside surrogate pairs.)
    """
    return F.regexp_count(text, F.lit("(?s)" + pattern))


def ratio(num: Column, den: Column) -> Column:
    """num/den with 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(num.cast("double"), den), F.lit(0.0))


def distinct_chars(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.size(F.array_distinct(F.split(text, "")))).otherwise(0)


def grams(text: Column, k: int) -> Column:
    """All overlapping k-character pieces of ``text`` (order not kept).

    One pass per offset with a plain ``.{k}`` regex; no zero-width match, so a pass can
    never stop inside a surrogate pair.
    """
    passes = [
        F.regexp_extract_all(F.substring(text, i + 1, 2147483647) if i else text,
                             F.lit(f"(?s).{{{k}}}"), F.lit(0))
        for i in range(k)
    ]
    return passes[0] if k == 1 else F.concat(*passes)


CHARS_AT_ONCE = 2_000_000  # of texts whose grams are sorted together, some 100 MB; one longer text goes alone


def gram_counter(limit: int):
    """Function from an Arrow array of texts and a size k to (row, first character of a place with the gram, count).

    Characters are numbers of 21 bits, so a gram of up to three is one number; the grams of each row are sorted and equal
    ones lie together. Nested like all that goes to the workers, so that they need only numpy and pyarrow.
    """
    def characters(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(code points of all texts in a row, where each text begins and the last one ends)."""
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        try:
            points = np.frombuffer(b"".join(raw).decode().encode("utf-32-le"), np.uint32)
            sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
        except UnicodeDecodeError:  # as the JVM reads them
            shown = [t.decode(errors="replace") for t in raw]
            points, sizes = np.frombuffer("".join(shown).encode("utf-32-le"), np.uint32), [len(t) for t in shown]
        return points, np.append(0, np.cumsum(sizes, dtype=np.int64))

    def runs(points: np.ndarray, ends: np.ndarray, k: int):
        """(row, gram, count) of every different gram of every row, by row and gram."""
        n, sizes = len(points), np.maximum(np.diff(ends) - (k - 1), 0)
        total = int(sizes.sum())
        if not total:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        gram = np.zeros(n - k + 1, np.int64)
        for i in range(k):
            gram = gram << 21 | points[i:n - k + 1 + i]
        starts = np.append(0, np.cumsum(sizes))
        gram = gram[np.arange(total) + np.repeat(ends[:-1] - starts[:-1], sizes)]
        for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
            gram[a:b].sort()
        new = np.append(True, gram[1:] != gram[:-1])
        new[starts[:-1][sizes > 0]] = True
        at = np.flatnonzero(new)
        return np.searchsorted(starts, at, side="right") - 1, gram[at], np.diff(np.append(at, total))

    def named(gram: np.ndarray, k: int) -> pa.Array:
        """Grams as strings, each different one spelled out once."""
        different, code = np.unique(gram, return_inverse=True)
        points = np.stack([different >> 21 * (k - 1 - i) & 0x1FFFFF for i in range(k)], axis=1).astype("<u4")
        text = points.tobytes().decode("utf-32-le")
        words = pa.array([text[i:i + k] for i in range(0, len(text), k)], pa.string())
        return words.take(pa.array(code))

    def slices(texts: pa.Array):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        begin, total = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > limit:
                yield begin, i
                begin, total = i, 0
            total += size
        if begin < len(sizes):
            yield begin, len(sizes)

    return characters, runs, named, slices


def entropy_measure():
    """Function from (code points, where each text begins and the last one ends, k) to the entropy of each text's k-grams.

    H = log2(n) - sum(c*log2(c))/n over the counts c; one gram or none give 0. Nested for the workers, too.
    """
    _, runs, _, _ = gram_counter(CHARS_AT_ONCE)

    def entropy(points: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        total = np.maximum(np.diff(ends) - (k - 1), 1).astype(float)
        row, _, n = runs(points, ends, k)
        sums = np.bincount(row, weights=n * np.log2(n), minlength=len(total))
        return np.where(total > 1, np.log2(total) - sums / total, 0.0)

    return entropy


def _measured(text: Column, measure) -> Column:
    """``measure`` of (code points, where each text begins and the last one ends) for whole Arrow arrays; null for null.

    Spark hands all measures of a projection to Python together.
    """
    characters, _, _, slices = gram_counter(CHARS_AT_ONCE)

    @F.arrow_udf("double")
    def value(texts: pa.Array) -> pa.Array:
        out = [measure(*characters(texts.slice(a, b - a))) for a, b in slices(texts)]
        return pa.array(np.concatenate([np.zeros(0), *out]), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return value(text)


def char_entropy(text: Column) -> Column:
    """Shannon entropy in bits over characters; empty text gives 0."""
    return gram_entropy(text, 1)


def gram_entropy(text: Column, k: int) -> Column:
    """Shannon entropy in bits over overlapping k-grams (k up to 3); fewer than k characters give 0."""
    entropy = entropy_measure()
    return _measured(text, lambda points, ends: entropy(points, ends, k))


def piece_entropy_variance(text: Column, separator: str = "/") -> Column:
    """Population variance of the character entropies of the non-empty pieces; fewer than two give 0."""
    entropy, mark = entropy_measure(), ord(separator)

    def measure(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        texts, cut = np.arange(len(ends) - 1), points == mark
        text_of = np.repeat(texts, np.diff(ends))
        # a piece begins with each text and behind each separator
        owner = np.repeat(texts, np.bincount(text_of[cut], minlength=len(texts)) + 1)
        sizes = np.bincount((np.cumsum(cut) + text_of)[~cut], minlength=len(owner))
        owner, sizes = owner[sizes > 0], sizes[sizes > 0]
        h = entropy(points[~cut], np.append(0, np.cumsum(sizes)), 1)
        n, s, ss = (np.bincount(owner, weights=w, minlength=len(texts)) for w in (None, h, h * h))
        few = np.maximum(n, 1)
        return np.where(n >= 2, np.maximum(ss / few - (s / few) ** 2, 0.0), 0.0)

    return _measured(text, measure)


def _pair_entropies() -> np.ndarray:
    """Entropy of a window by the number of pairs of equal characters in it, which tells its seven shapes apart."""
    shapes = [(1, 1, 1, 1, 1), (2, 1, 1, 1), (2, 2, 1), (3, 1, 1), (3, 2), (4, 1), (5,)]
    out = np.zeros(WINDOW * (WINDOW - 1) // 2 + 1)
    for sizes in shapes:
        out[sum(s * (s - 1) // 2 for s in sizes)] = math.log2(WINDOW) - sum(s * math.log2(s) for s in sizes) / WINDOW
    return out


def window_entropy_range(text: Column) -> Column:
    """Max minus min character entropy over sliding 5-character windows.

    The last window is left out, as the feature is defined; five or fewer characters
    give 0. More pairs of equal characters in a window mean less entropy.
    """
    by_pairs, window = _pair_entropies(), WINDOW

    def measure(points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sizes, out = np.maximum(np.diff(ends) - window, 0), np.zeros(len(ends) - 1)
        total, n = int(sizes.sum()), len(points) - window + 1
        if not total:
            return out
        pairs = np.zeros(n, np.int8)
        for gap in range(1, window):
            same = points[gap:] == points[:-gap]
            for i in range(window - gap):
                pairs += same[i:i + n]
        starts = np.append(0, np.cumsum(sizes))
        pairs = pairs[np.arange(total) + np.repeat(ends[:-1] - starts[:-1], sizes)]
        heads = starts[:-1][sizes > 0]
        out[sizes > 0] = by_pairs[np.minimum.reduceat(pairs, heads)] - by_pairs[np.maximum.reduceat(pairs, heads)]
        return out

    return _measured(text, measure)


def window_distinct_mean(text: Column) -> Column:
    """Mean number of distinct characters over sliding 5-character windows (last one left out).

    A character lowers the count of every window that also holds its previous occurrence.
    With ``g`` characters in between these are 4 - g windows, all found by one regex that
    captures the gaps; the windows that would reach over either end (and the last one) are
    taken off again.
    """
    windows = F.length(text) - WINDOW
    gaps = F.regexp_extract_all(text, F.lit(r"(?s)(.)(?=(.{0,3}?)\1)"), F.lit(2))
    repeats = (WINDOW - 1) * F.size(gaps) - F.length(F.array_join(gaps, ""))
    ends = [F.left(text, F.lit(m)) for m in range(2, WINDOW)] + [F.right(text, F.lit(m)) for m in range(2, WINDOW + 1)]
    for piece in ends:
        repeats = repeats - (F.length(piece) - F.size(F.array_distinct(F.split(piece, ""))))
    return F.when(windows > 0, F.lit(float(WINDOW)) - repeats / windows).when(
        text.isNotNull(), F.lit(0.0)
    )


def longest_match(text: Column, pattern: str) -> Column:
    """Length of the longest match of ``pattern``; 0 when there is none."""
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    return F.coalesce(F.array_max(lengths), F.lit(0))


def contains_any(text: Column, terms: list[str]) -> Column:
    """True when any literal term occurs in ``text``.

    One alternation regex with the terms grouped by first character, so a position is
    rejected after one comparison instead of one per term. Terms that contain another
    term are implied by it and left out.
    """
    needed = [t for t in terms if not any(o != t and o in t for o in terms)]
    by_first: dict[str, list[str]] = {}
    for term in dict.fromkeys(needed):
        by_first.setdefault(term[0], []).append(term[1:])
    groups = [
        quote(first) + "(?:" + "|".join(quote(rest) for rest in rests) + ")"
        for first, rests in by_first.items()
    ]
    return F.regexp_like(text, F.lit("|".join(groups)))


def quote(literal: str) -> str:
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|#&~ " else c for c in literal)
