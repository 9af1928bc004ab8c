"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

E-mail, IP, card and phone spans follow fixed patterns, leftmost and without overlap per kind, and always stay.
Added kinds (bank account numbers with a mod-97 check, social security shapes, phone shapes without a plus sign)
are kept only if checksum and context reach the threshold and they touch no other span. Offsets are code points,
ends exclusive. A null or empty text has no spans; rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from urlspark.llm.common import column, map_batches, place, sha256_hex, texts

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "localphone")

AFTER_AT = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
BEFORE_AT = re.compile(r"[^A-Za-z0-9._%+-]")
# A run of digits either starts a match or none of its later digits does, so only its first one is tried.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?= ?[0-9A-Z])")  # its first group; _ibans looks for the end
IBAN_TAIL = re.compile(r"[0-9A-Z]")
WORD_GOES_ON = re.compile(r"[0-9A-Za-z]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")

CONTEXT = {  # words near a span that make its kind likelier
    "email": "email e-mail mail contact write".split(),
    "ip": "ip address host server".split(),
    "card": "card visa mastercard amex credit debit payment".split(),
    "phone": "phone tel telephone call mobile fax".split(),
    "iban": "iban bank account transfer".split(),
    "ssn": "ssn social security".split(),
    "localphone": "phone tel telephone call mobile fax".split(),
}
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "localphone": 0.4}
WORD = re.compile(r"[A-Za-z-]+")


@dataclass(frozen=True)
class Settings:
    window: int = 40  # characters on either side that are searched for context words
    bonus: float = 0.2  # for context of the own kind
    malus: float = 0.2  # for context of another kind only
    threshold: float = 0.5  # for added kinds


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """The check of international bank account numbers: country and check digits to the end, letters as 10 to 35."""
    plain = account.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """From each country code and check digits: groups of four (the last may be shorter) with or without blanks, to the
    last word end within 34 characters at which mod-97 holds."""
    done = 0
    for m in IBAN.finditer(text):
        if m.start() < done:
            continue
        at, ends = m.end(), []
        for n in range(4, 34):
            at += n % 4 == 0 and text.startswith(" ", at)
            if not IBAN_TAIL.match(text, at):
                break
            at += 1
            if not WORD_GOES_ON.match(text, at):
                ends.append(at)
        end = next((e for e in reversed(ends) if mod97(text[m.start():e])), None)
        if end is not None:
            yield m.start(), end
            done = end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @: the run in front of it (not before the last match) and the domain behind it."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and not BEFORE_AT.match(text, begin - 1):
            begin -= 1
        found = AFTER_AT.match(text, at + 1) if begin < at else None
        if found:
            yield begin, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def _digits(text: str) -> str:
    return "".join(DIGIT.findall(text))


def _base(text: str, digits: bool) -> Iterator[tuple[str, int, int]]:
    for begin, end in _emails(text):
        yield "email", begin, end
    if not digits:
        return
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 13 <= len(number := _digits(m.group())) <= 19 and luhn(number):
            yield "card", m.start(), m.end()
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield "phone", m.start(), m.end()


def _score(text: str, kind: str, begin: int, end: int, settings: Settings) -> float:
    near = text[max(0, begin - settings.window):begin] + " " + text[end:end + settings.window]
    seen = {w.lower() for w in WORD.findall(near)}
    own = not seen.isdisjoint(CONTEXT[kind])
    other = any(not seen.isdisjoint(words) for k, words in CONTEXT.items() if k != kind)
    return min(1.0, max(0.0, PRIOR[kind] + settings.bonus * own - settings.malus * (other and not own)))


def find_personal_data(text: str, settings: Settings = Settings()) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind as in KINDS, then start."""
    digits = DIGIT.search(text) is not None
    spans = [(k, b, e, _score(text, k, b, e, settings)) for k, b, e in _base(text, digits)]
    if digits:
        taken = sorted((b, e) for _, b, e, _ in spans)
        found = [("iban", *span) for span in _ibans(text)]
        found += [(k, *m.span()) for k, p in (("ssn", SSN), ("localphone", LOCAL_PHONE)) for m in p.finditer(text)]
        for kind, begin, end in found:
            score = _score(text, kind, begin, end, settings)
            if score >= settings.threshold and all(e <= begin or end <= b for b, e in taken):
                spans.append((kind, begin, end, score))
                taken.append((begin, end))
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def written_spans(spans: list[tuple[str, int, int, float]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e, _ in spans)


def mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span (overlapping ones together) replaced by the name of its kind in brackets."""
    out, done = [], 0
    for kind, begin, end, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if begin >= done:
            out += [text[done:begin], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, kind, start, end, score) of all spans: one row per span."""
    kind = dict(docs.dtypes)[key]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *s) for i, t in enumerate(texts(batch).to_pylist()) for s in find_personal_data(t, settings)]
            at, *rest = zip(*rows) if rows else ((), (), (), (), ())
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.float64())
            keys = column(batch, "key").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, *map(pa.array, rest, kinds)], [key, "kind", "start", "end", "score"])

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    return map_batches(pairs, find, f"`{key}` {kind}, kind string, start long, end long, score double")


def personal_data_report(docs: DataFrame, key: str = "doc_id", text: str = "text",
                         settings: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs``: counts of the four base kinds, digest of their spans, all spans and added ones."""
    kind = dict(docs.dtypes)[key]

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, listed, added = {k: [] for k in BASE_KINDS}, [], [], []
            for t in texts(batch).to_pylist():
                spans = find_personal_data(t, settings)
                base = [s for s in spans if s[0] in BASE_KINDS]
                for k in BASE_KINDS:
                    counts[k].append(sum(s[0] == k for s in base))
                digests.append(sha256_hex(written_spans(base).encode()))
                listed.append(written_spans(spans))
                added.append(len(spans) - len(base))
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [column(batch, "key"), *(pa.array(counts[k], long) for k in BASE_KINDS), pa.array(digests, pa.string()),
                 pa.array(listed, pa.string()), pa.array(added, long)],
                [key, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "n_added"],
            )

    pairs = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    fields = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return map_batches(pairs, report, f"`{key}` {kind}, {fields}, base_sha256 string, spans string, n_added long")


def mask_documents(docs: DataFrame, text: str = "text", length: str | None = None,
                   settings: Settings = Settings()) -> DataFrame:
    """``docs`` with personal data masked in ``text`` and, if named, the length column set to the new code points.

    Texts without spans, null ones too, and their lengths stay as they are.
    """
    at, size = place(docs, text), None if length is None else place(docs, length)

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(at).to_pylist():
                spans = find_personal_data(t, settings) if t else []
                out.append((mask(t, spans), True) if spans else (t, False))
            arrays = list(batch.columns)
            arrays[at] = pa.array([o[0] for o in out], arrays[at].type)
            if size is not None:
                kept = arrays[size].to_pylist()
                arrays[size] = pa.array([len(o[0]) if o[1] else n for o, n in zip(out, kept)], arrays[size].type)
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return map_batches(docs, cover, docs.schema)
