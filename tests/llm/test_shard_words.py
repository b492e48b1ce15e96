"""Words of token shards: cut and encoded as the whole texts are, and each distinct one once."""

import base64
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from lodestrand.llm import token_shards

END = 50256


@pytest.fixture
def coder():
    return token_shards.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_runs_of_texts_have_the_ids_of_whole_texts(coder):
    rnd, signs = random.Random(5), [" "] * 9 + list("ab'slté1ß,.\n\t\r\x0b\x1c\x1f\x00  　\u0085—か中😀​_-")
    runs = [["".join(rnd.choices(signs, k=rnd.choice([0, 1, 2, 5, 30]))) for _ in range(rnd.randint(0, 12))] for _ in range(300)]
    runs += [[], [None], ["", None, ""], [" ", " ", " x"], ["x", "x", " x", "x "], ["a\n", " b"], ["word " * 3000, " " * 500, None]]
    for local in (coder.local, False):
        coder.local = local
        for texts in runs:
            for column in (pa.array(texts, pa.string()), pa.array([None, "cut off", *texts, "cut off"], pa.large_string())[2:-1]):
                n, ids = coder.encode_many(column, END)
                want = [[*coder.coder.encode_ordinary(t or ""), END] for t in texts]
                assert [np.frombuffer(x, "<u2").tolist() for x in ids.to_pylist()] == want and n.tolist() == [len(x) for x in want]


def test_distinct_words_reach_the_tokenizer_once_and_together(coder, monkeypatch):
    calls, encode = [], coder.ids_of
    monkeypatch.setattr(coder, "ids_of", lambda text: calls.append(len(text)) or encode(text))
    words = [f"tok{k}ens," for k in range(2000)]
    coder.encode_many(pa.array(["Start " + " ".join(words)] * 50), END)
    # One call for the words within texts, one for the word that starts each.
    assert len(calls) == 2 and sum(calls) < 2 * len(" ".join(words))


def test_a_pattern_that_joins_words_is_told_apart():
    joins = token_shards.Coder(public_tokenizers.path("byte_bpe_50k.tiktoken"), r"\p{L}+ ?\p{L}*|\s+|.")
    assert not joins.local
    n, ids = joins.encode_many(pa.array(["over and over", " and"]), END)
    assert [np.frombuffer(x, "<u2").tolist() for x in ids.to_pylist()] == [[*joins.coder.encode_ordinary(t), END] for t in ("over and over", " and")]
