"""The learning queries run their operators with the operators' own settings."""

import inspect

import pytest

from urlspark import constants as K
from urlspark.operators import ngrams, select
from workload import queries


class Seen(Exception):
    pass


@pytest.mark.parametrize("query, module, name, want", [
    ("ngram_l1_rank", ngrams, "select_ngrams", {"k": K.NGRAM_TOP, "max_iter": 100}),
    ("ngram_validation", ngrams, "select_ngrams", {"k": K.NGRAM_TOP, "max_iter": 100}),
    ("ngram_validation", ngrams, "validate_ngrams", {"max_iter": 100}),
    ("tree_gain", select, "tree_gain", {"trees": K.IMPORTANCE_TREES}),
])
def test_full_settings(spark, sf, monkeypatch, query, module, name, want):
    signature = inspect.signature(getattr(module, name))

    def seen(*args, **named):
        call = signature.bind(*args, **named)
        call.apply_defaults()
        raise Seen({k: call.arguments[k] for k in want})

    if name == "validate_ngrams":
        monkeypatch.setattr(ngrams, "select_ngrams", lambda *args, **named: None)
    monkeypatch.setattr(module, name, seen)
    with pytest.raises(Seen) as found:
        getattr(queries, query)(spark, sf)
    assert found.value.args[0] == want
