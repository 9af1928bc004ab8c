import random
import re

import pytest

from tests.llm.cases import odd_docs, rows
from urlspark.llm import pii


def brute(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and pii.luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_base_spans():
    rng = random.Random(8)
    texts = ["".join(rng.choice("1234567890..@@ --+ab()é") for _ in range(rng.randint(0, 60))) for _ in range(20_000)]
    for t in texts:
        assert [s[:3] for s in pii.find_personal_data(t) if s[0] in pii.BASE_KINDS] == brute(t), t


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "1." * 150_000, "a" * 300_000, "a@" * 150_000, "+1" * 150_000, "1 " * 150_000):
        pii.find_personal_data(t)


@pytest.mark.parametrize("text, kinds", [
    ("bank account GB82 WEST 1234 5698 7654 32 please", ["iban"]),
    ("code GB83 WEST 1234 5698 7654 32", []),
    ("my ssn is 078-05-1120.", ["ssn"]),
    ("part 078-05-1120.", []),
    ("call (212) 555-0187 now", ["localphone"]),
    ("card 4111 1111 1111 1111", ["card"]),
    ("ref 4111 1111 1111 1112", []),
    ("", []),
])
def test_added_kinds(text, kinds):
    spans = pii.find_personal_data(text)
    assert [s[0] for s in spans] == kinds
    assert all(0 <= s[3] <= 1 for s in spans)


def test_context_moves_the_score():
    near = pii.find_personal_data("payment card 4111111111111111")[0][3]
    alone = pii.find_personal_data("xx 4111111111111111")[0][3]
    other = pii.find_personal_data("phone 4111111111111111")[0][3]
    assert near > alone > other


def test_mask_and_report(spark):
    texts = [None, "", "mail a.b@c.org or 10.0.0.1, 4111111111111111", "+1 (212) 555-0187 x@y.zz", "plain " * 100]
    docs = odd_docs(spark, texts * 2)
    masked = pii.mask_documents(docs, length="n_chars")
    assert masked.schema == docs.schema
    out = {r["text"] for r in masked.collect()}
    assert out == {None, "", "mail [EMAIL] or [IP], [CARD]", "[PHONE] [EMAIL]", "plain " * 100}
    assert all(r["n_chars"] == len(r["text"]) for r in masked.collect() if r["text"])
    report = pii.personal_data_report(docs).collect()
    assert len(report) == docs.count()
    for r in report:
        assert sum(r[f"n_{k}"] for k in pii.BASE_KINDS) + r["n_added"] == len([s for s in r["spans"].split(",") if s])
    assert pii.personal_data(docs).count() == sum(len([s for s in r["spans"].split(",") if s]) for r in report)
    assert rows(pii.personal_data(docs.limit(0))) == [] and pii.mask_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("number", [
    "BE68 5390 0754 7034", "ES9121000418450200051332", "AT611904300234573201", "GB82 WEST 1234 5698 7654 32",
    "DE89370400440532013000",
])
@pytest.mark.parametrize("after", ["", " EUR", " 12 May", " BIC", " Please pay", " EUROS", " AB12 3456", ".", "\n12"])
def test_iban_gives_back_what_follows(number, after):
    assert [s[:3] for s in pii.find_personal_data(f"to {number}{after}") if s[0] == "iban"] == [("iban", 3, 3 + len(number))]


def test_iban_search_is_linear():
    for t in ("AA11" * 75_000, "AA11 " * 60_000, "AA11 1 " * 40_000):
        pii.find_personal_data(t)
