"""What the packing's encoder remembers between batches."""

import pyarrow as pa

from costlens.llm import packing
from costlens.llm.common import default_tokenizer


def test_frequent_words_stay_and_the_rest_goes(monkeypatch):
    frequent = [f"common{i}." for i in range(20)]
    batches = [pa.array([" ".join(frequent + [f"once{b}x{i}" for i in range(30)])]) for b in range(12)]
    whole = packing.WordEncoder(default_tokenizer())
    want = [[ids.tolist() for ids, _ in whole.texts(b)] for b in batches]

    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 150)
    encoder, learned = packing.WordEncoder(default_tokenizer()), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (learned.extend(new), learn(new)))
    for batch, ids in zip(batches, want):
        assert [x.tolist() for x, _ in encoder.texts(batch)] == ids
        assert len(encoder.slot_of) <= 150
    assert learned.count("common3.") == 1
    assert len(learned) == len(set(learned))


def test_an_executor_s_encoders_remember_few_words():
    assert packing.REMEMBERED_WORDS <= 250_000
