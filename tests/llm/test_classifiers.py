import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import odd_docs, sentence
from urlspark.llm import quality as Q
from urlspark.llm import toxicity as X
from urlspark.llm.common import held_out, table
from urlspark.llm.queries import op1_quality, op2_toxicity


def away():
    return held_out("doc_id", 3, 1)


@pytest.mark.parametrize("query, label, accuracy", [(op1_quality, "quality", 0.97), (op2_toxicity, "toxic", 0.93)])
def test_held_out_accuracy(spark, query, label, accuracy):
    folder = "/root/testdata/sf0.1"
    got = query(spark, folder).join(table(spark, folder, "labels"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"] == got[label]).mean() > accuracy
    assert got.loc[got[label] == 1, "score"].mean() > got.loc[got[label] == 0, "score"].mean() + 0.3


def test_tokens():
    found = Q.tokens(pa.array(["", "Ab ab AB 12 ##", "ab", " "]))
    assert found.starts.tolist() == [0, 0, 5, 6, 6]
    assert len({*found.bucket[:3], found.bucket[5]}) == 1 and found.capital.tolist() == [False, False, True, False, False, False]
    assert found.kind.tolist() == [Q.LETTER] * 3 + [Q.DIGIT, Q.SYMBOL, Q.LETTER]


def test_neighbours_against_brute_force():
    texts = pa.array(["a b c d", "", "b a", "c"])
    found, (place, sign) = Q.tokens(texts), Q.random_index()
    sums = np.zeros(Q.BUCKETS * Q.DIMENSIONS)
    Q._add_neighbours(found, sums, place, sign)
    want = np.zeros((Q.BUCKETS, Q.DIMENSIONS))
    for a, b in zip(found.starts, found.starts[1:]):
        for i in range(a, b):
            for j in range(max(a, i - Q.REACH), min(b, i + Q.REACH + 1)):
                if i != j:
                    for k in range(Q.NONZERO):
                        want[found.bucket[i], place[found.bucket[j], k]] += sign[found.bucket[j], k]
    assert (sums.reshape(want.shape) == want).all()


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_quality_odd_rows(spark):
    docs = odd_docs(spark)
    for labels in (labels_of(spark, [(i, i % 2, 0) for i in range(15)] * 2), labels_of(spark, []),
                   labels_of(spark, [(1, None, 1), (None, 1, 1)])):
        got = Q.score_documents(docs, Q.fit(docs, labels, "quality", away()), away()).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    model = Q.fit(docs.limit(0), labels_of(spark, []), "quality", away())
    assert Q.score_documents(docs.limit(0), model, away()).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    terms = ["idiot", "moron", "abc", "disgusting", "idiots", "stupidest"]
    automaton = X.LexiconAutomaton(terms)
    words = ["", *terms]
    for _ in range(3000):
        w = list(rng.choice(terms))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "i", "st"])
        words.append("".join(w))
    for w in words:
        near = [(distance(w, t), i) for i, t in enumerate(terms) if distance(w, t) <= X.edits(t)]
        assert automaton.match(w) == (min(near)[::-1] if near else None), w


def test_quotation_counts_less():
    matcher = X.Matcher(["idiot", "moron"])
    abuse = X.features("you idiot , you moron go away", matcher)[0]
    quote = X.features('she said " you idiot , moron " and left', matcher)[0]
    assert abuse[0] > quote[0] and quote[1] > 0 and abuse[1] == 0
    assert X.features("you 1d1ot", matcher)[1] and X.features("you idi0t", matcher)[1]
    assert not X.features("nothing here", matcher)[1] and not X.features("", matcher)[1]


def test_toxicity_learns_and_spares(spark):
    rng = random.Random(7)
    texts, pairs = [], []
    for i in range(300):
        words = sentence(rng, 60).split()
        if i % 5 == 0:
            for t in ("grubbler", "snorfel", "grubbler", "wexling"):
                words.insert(rng.randrange(len(words)), t)
        texts.append(" ".join(words))
        pairs.append((i, 1, int(i % 5 == 0)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = X.fit(docs, labels_of(spark, pairs), "toxic", away())
    assert {"grubbler", "snorfel", "wexling"} <= set(model.terms)
    more = odd_docs(spark, [None, "", sentence(rng, 50), "grubler snorfell " + sentence(rng, 20) + " gru88ler wexxling"])
    got = {r["doc_id"]: r for r in X.score_documents(more, model, away()).collect()}
    assert got[0]["predicted"] == got[1]["predicted"] == got[2]["predicted"] == 0
    assert X.score_documents(docs, model, away()).where("predicted <> int(doc_id % 5 = 0)").count() == 0
    assert X.score_documents(docs.limit(0), model, away()).count() == 0


def test_one_row_of_each_key_is_sampled(spark):
    """A labelled key that 50,000 rows have gives one row, and it does not depend on their order."""
    docs = spark.range(50_020).selectExpr("if(id < 50000, 1, id) AS doc_id", "concat('text ', id % 977) AS text")
    labels = labels_of(spark, [(1, 0, 1), (1, 1, 0), (50_003, 0, 0), (50_004, 1, 1), (None, 1, 1)])
    got = Q.labelled_sample(docs, labels, "quality", away(), "doc_id", "text", 100).collect()
    assert sorted(r["id"] for r in got) == sorted({1, 50_003, 50_004} & {
        r["doc_id"] for r in docs.where(~away()).select("doc_id").distinct().collect()})
    again = Q.labelled_sample(docs.repartition(7), labels, "quality", away(), "doc_id", "text", 100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again)) and len(got) >= 1


@pytest.mark.parametrize("toxic", [0, 1])
def test_without_two_labels_the_lexicon_is_empty(spark, toxic):
    docs = odd_docs(spark)
    model = X.fit(docs, labels_of(spark, [(i, 1, toxic) for i in range(15)]), "toxic", away())
    assert model.terms == [] and model.left_out == 0
    got = X.score_documents(docs, model, away()).collect()
    assert len({r["score"] for r in got}) == 1 and not any(r["predicted"] for r in got)


def test_words_are_spared_by_ratio_and_terms_beyond_the_limit_counted(spark, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(400):
        words = sentence(rng, 40).split()
        if i % 4 == 0:
            for t in ("grubbler", "snorfel", "wexling", "grubblor"):
                words.insert(rng.randrange(len(words)), t)
        elif i % 4 == 1:
            words.insert(rng.randrange(len(words)), "wexlin")  # a clean word near a term
        elif i == 2:
            words.insert(3, "grubblor")  # one slip does not spare a misspelling
        rows.append((" ".join(words), int(i % 4 == 0)))
    sample = spark.createDataFrame(rows, "text string, label int")
    terms, spared, left_out = X.learn_lexicon(sample)
    assert {"grubbler", "snorfel", "wexling"} <= set(terms) and left_out == 0
    assert "wexlin" in spared and "grubblor" not in spared
    monkeypatch.setattr(X, "LEXICON", 2)
    fewer, _, left_out = X.learn_lexicon(sample)
    assert len(fewer) == 2 and left_out == len(terms) - 2
