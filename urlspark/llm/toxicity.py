"""Toxicity: Levenshtein automata intersected with a lexicon trie find terms and their misspellings, context weighs them.

The lexicon is learnt from a bounded sample of labelled rows, one of each key: words far likelier in toxic texts. If the
labels name none, it is empty and every text gets the same low score. All words of a text walk through the product of the trie with the automata of its
terms, which is made deterministic as it is walked, so a word costs one step per letter. Matches are weighed by distance,
by quotation marks around them, by words of report or citation and by address in a window; a logistic model over the sums
gives the score. A null or empty text has no matches and the model's lowest kind of score.
Rows without a key are scored and never learnt from, repeated rows get equal scores, an empty table gives an empty result;
equally telling terms are taken by their letters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urlspark.llm.common import column, map_batches, texts
from urlspark.llm.quality import labelled_sample
from urlspark.session import cut_lineage

SAMPLE_ROWS = 20_000  # labelled rows that lexicon and weights are learnt from
LEXICON = 20_000  # terms at most, which keeps a worker's trie at some 20 MB; the model tells how many are left out
WINDOW = 6  # words on either side of a match
CACHED_WORDS = 300_000
WORD = re.compile(r"[^\W_]+(?:[*@$!|0-9][^\W_]+)*")
LEET = str.maketrans("013457@$!|", "oieastasil")
ADDRESS = frozenset("you your youre u ur yourself they them she he".split())
REPORT = frozenset(
    "said says say called calls wrote writes word words term quote quoted quotes phrase cites cited reported insult".split()
)
QUOTES = "\"“”«»„‘’'`"
BY_EDITS = (1.0, 0.6, 0.3)  # weight of a match by its edits
FEATURES = ("abuse", "quoted", "reported", "addressed", "clustered", "different", "density")


def edits(term: str) -> int:
    """Misspellings that count: none for short terms, one up to eight letters, two beyond."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


@dataclass
class LexiconAutomaton:
    """Levenshtein automata over a trie, made deterministic on demand.

    A state is a set of (trie node, edits used); a letter leads to all nodes it can reach by match, substitution,
    insertion or skipped letters. Each node knows the most edits that some term below it allows.
    """

    terms: list[str]
    children: list[dict[str, int]] = field(default_factory=list)
    term_at: dict[int, int] = field(default_factory=dict)
    allowed: list[int] = field(default_factory=list)
    moves: dict[frozenset, dict[str, frozenset]] = field(default_factory=dict)

    def __post_init__(self):
        self.children, self.allowed = [{}], [0]
        for number, term in enumerate(self.terms):
            node = 0
            self.allowed[0] = max(self.allowed[0], edits(term))
            for letter in term:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], edits(term))
            self.term_at[node] = number
        self.start = self._closed({(0, 0)})
        self.moves = {}

    def _closed(self, state: set[tuple[int, int]]) -> frozenset:
        """With letters of a term skipped; of each node only the fewest edits are kept."""
        least: dict[int, int] = {}
        todo = list(state)
        while todo:
            node, used = todo.pop()
            if used > self.allowed[node] or least.get(node, 99) <= used:
                continue
            least[node] = used
            todo += [(child, used + 1) for child in self.children[node].values()]
        return frozenset(least.items())

    def _step(self, state: frozenset, letter: str) -> frozenset:
        reached = set()
        for node, used in state:
            reached.add((node, used + 1))  # one letter too many
            for edge, child in self.children[node].items():
                reached.add((child, used + (edge != letter)))
        return self._closed(reached)

    def match(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within its edits, the first of equals."""
        state, moves = self.start, self.moves
        for letter in word:
            known = moves.get(state)
            if known is None:
                if len(moves) > 50_000:
                    moves.clear()
                known = moves[state] = {}
            after = known.get(letter)
            if after is None:
                after = known[letter] = self._step(state, letter)
            if not after:
                return None
            state = after
        ends = [(used, self.term_at[n]) for n, used in state
                if n in self.term_at and used <= edits(self.terms[self.term_at[n]])]
        return min(ends)[::-1] if ends else None


class Matcher(dict):
    """Terms of words: (term, edits) or None, each different word walked once while it is remembered."""

    def __init__(self, terms: list[str], spared: frozenset[str] = frozenset()):
        super().__init__()
        self.automaton, self.spared = LexiconAutomaton(terms), spared

    def __missing__(self, word: str) -> tuple[int, int] | None:
        found = self.automaton.match(word)
        if (found is None or found[1]) and not word.isalpha():  # digits and marks in place of letters
            plain = self.automaton.match(word.translate(LEET))
            if plain and (found is None or plain[1] + 1 < found[1]):
                found = plain[0], plain[1] + 1
        if found and found[1] and word in self.spared:
            found = None
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def _quoted(text: str, begin: int, end: int) -> bool:
    """Whether a quotation mark stands close in front and another close behind, on the same line."""
    front, back = text[max(0, begin - 60):begin].rpartition("\n")[2], text[end:end + 60].partition("\n")[0]
    opened = any(front.count(q) % 2 for q in "\"'`") or any(front.rfind(a) > front.rfind(b) for a, b in ("“”", "«»", "‘’"))
    return opened and any(q in back for q in QUOTES)


def features(text: str, matcher: Matcher) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(sums over matches, matches as (start, end, term, edits))."""
    out, lowered, found = np.zeros(len(FEATURES)), text.lower(), []
    if len(lowered) != len(text):  # offsets must hold in the original
        lowered = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    words = WORD.findall(lowered)
    hits = list(map(matcher.__getitem__, words))
    at = [(i, *hit) for i, hit in enumerate(hits) if hit is not None] if any(hits) else []
    if not at:
        return out, found
    spans = [m.span() for m in WORD.finditer(lowered)]
    for k, (i, term, used) in enumerate(at):
        near = words[max(0, i - WINDOW):i] + words[i + 1:i + 1 + WINDOW]
        quoted, reported = _quoted(text, *spans[i]), not REPORT.isdisjoint(near)
        abusive = (0.25 if quoted or reported else 1.0) * BY_EDITS[min(used, 2)]
        out[0] += abusive
        out[1] += quoted
        out[2] += reported and not quoted
        out[3] += abusive * (not ADDRESS.isdisjoint(near))
        out[4] += abusive * any(0 < abs(i - j) <= WINDOW for j, _, _ in at[max(0, k - 2):k + 3])
        found.append((*spans[i], term, used))
    out[5] = len({t for _, t, _ in at})
    out[6] = 100 * out[0] / len(words)
    return np.sqrt(out), found


@dataclass
class Model:
    terms: list[str]
    spared: frozenset[str]  # words near a term that clean texts use
    coefficients: np.ndarray
    intercept: float
    left_out: int = 0  # telling words beyond LEXICON

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.coefficients + self.intercept, -50, 50)))


def learn_lexicon(sample: DataFrame, share: float = 0.008, ratio: float = 100.0) -> tuple[list[str], frozenset[str], int]:
    """(terms, spared words, telling words left out) of (text, label).

    Terms are ``ratio`` times likelier in toxic texts and stand behind different words there, as many as ``share`` of
    those texts: words of a copied passage always stand behind the same one. Spared words are near a term, but stand in
    clean texts and are less than the root of ``ratio`` times likelier in toxic ones. The driver gets LEXICON terms at
    most, and of the bounded sample's words those near a term. Without texts of both labels there are no terms.
    """

    def list_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(texts(batch).to_pylist(), column(batch, "label").to_pylist())
            rows = []
            for t, y in both:
                words = WORD.findall(t.lower())
                rows += [(w, before if y else "", y) for w, before in dict(zip(words[1:], words)).items() if len(w) > 2]
            cols = zip(*rows) if rows else ((), (), ())
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["word", "before", "label"])

    n, toxic = sample.agg(F.count("*"), F.sum("label")).first()
    if not toxic or toxic == n:
        return [], frozenset(), 0
    listed = map_batches(sample.select("text", "label"), list_words, "word string, before string, label long")
    pairs = listed.groupBy("word", "before").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    counted = cut_lineage(pairs.groupBy("word").agg(
        F.sum("bad").alias("bad"), F.sum("all").alias("all"), F.count(F.when(F.col("bad") > 0, 1)).alias("contexts")))
    odds = (F.col("bad") + 0.1) / (toxic + 1) / ((F.col("all") - F.col("bad") + 0.1) / (n - toxic + 1))
    telling = counted.where((F.col("contexts") >= F.lit(max(4.0, share * toxic))) & (odds >= ratio))
    top = telling.orderBy((F.col("bad") * F.log(odds)).desc(), "word").limit(LEXICON).collect()
    terms = [r["word"] for r in top]
    left_out = telling.count() - len(terms)

    def near_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = LexiconAutomaton(terms)
        for batch in batches:
            near = pa.array([bool((automaton.match(w) or (0, 0))[1]) for w in column(batch, "word").to_pylist()])
            yield batch.filter(near)

    clean = counted.where((F.col("all") > F.col("bad")) & (odds < ratio ** 0.5)).select("word")
    return terms, frozenset(r["word"] for r in map_batches(clean, near_terms, "word string").collect()), left_out


def _fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Newton steps on the log loss; slopes are held at zero or more, as matches never speak for a clean text."""
    design = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(design.shape[1])
    ridge = np.append(np.full(x.shape[1], penalty), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p))[:, None]) / len(y) + np.diag(ridge)
        step = np.linalg.solve(hessian, design.T @ (p - y) / len(y) + ridge * w)
        w = w - 0.5 * step
        free = [i for i, name in enumerate(FEATURES) if name not in ("quoted", "reported")]
        w[free] = np.maximum(w[free], 0)
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, label: str, away: Column, key: str = "doc_id", text: str = "text",
        rows: int = SAMPLE_ROWS) -> Model:
    """Lexicon and weights from at most ``rows`` labelled rows; the driver gets one short vector per sampled row."""
    sample = cut_lineage(labelled_sample(docs, labels, label, away, key, text, rows))
    terms, spared, left_out = learn_lexicon(sample)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(terms, spared)
        for batch in batches:
            x = pa.array([features(t, matcher)[0].tolist() for t in texts(batch).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([column(batch, "id"), x, column(batch, "label")], ["id", "x", "label"])

    kind = dict(docs.dtypes)[key]
    found = map_batches(sample.select("id", "text", "label"), weigh, f"id {kind}, x array<double>, label int")
    got = sorted(map(tuple, found.collect()))
    y = np.array([r[2] for r in got], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(terms, spared, np.ones(len(FEATURES)), -3.0, left_out)
    return Model(terms, spared, *_fit_logistic(np.array([r[1] for r in got]), y), left_out)


def score_documents(docs: DataFrame, model: Model, away: Column, key: str = "doc_id", text: str = "text",
                    threshold: float = 0.7) -> DataFrame:
    """Per row: key, held_out, score, predicted, and the matches as ``term:start:end`` (code points, end exclusive)."""
    kind = dict(docs.dtypes)[key]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model.terms, model.spared)
        for batch in batches:
            rows = [features(t, matcher) for t in texts(batch).to_pylist()]
            scores = model.score(np.array([x for x, _ in rows]).reshape(len(rows), len(FEATURES)))
            named = [",".join(f"{model.terms[t]}:{b}:{e}" for b, e, t, _ in found) for _, found in rows]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), column(batch, "held_out"), pa.array(scores),
                 pa.array((scores >= threshold).astype(np.int32)), pa.array(named, pa.string())],
                [key, "held_out", "score", "predicted", "matches"])

    rows = docs.select(docs[key].alias("key"), docs[text].alias("text"), away.alias("held_out"))
    return map_batches(rows, score, f"`{key}` {kind}, held_out boolean, score double, predicted int, matches string")
