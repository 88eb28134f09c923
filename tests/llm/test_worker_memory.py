"""What earlier tasks left unused in a worker is freed before an operator fills its tables there."""

import sys

from quizloom.llm import common, packing


def test_a_new_table_frees_what_is_unused(monkeypatch):
    monkeypatch.delitem(sys.__dict__, "_kept_in_worker", raising=False)
    freed = []
    monkeypatch.setattr(common, "_release_unused", lambda: freed.append(1), raising=False)
    assert common.kept_in_worker("one a", lambda: 5) == 5 and len(freed) == 1
    assert common.kept_in_worker("one a", lambda: 6) == 5 and len(freed) == 1
    common.drop_kept_in_worker()
    assert len(freed) == 2 and "_kept_in_worker" not in sys.__dict__


def test_packing_remembers_a_bounded_number_of_words():
    import public_tokenizers

    coder = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert coder.words.limit + coder.bare.limit <= 500_000
