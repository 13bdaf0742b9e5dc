"""New parts of texts are encoded in batches of bounded size, with the same ids."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from gritstone.llm.token_output import _Tokens


def test_batches_of_parts_give_the_same_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = _Tokens(path, at_once=3), _Tokens(path)
    sizes, encode = [], few.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, **more):
            sizes.append(len(texts))
            return encode(texts, **more)

    few.tokenizer = Counted()
    for texts in (["The cat sat.", None, "", "one two three four five six"], ["seven two eight", "the cat ran, nine ten"], ["the cat"]):
        for x, y in zip(few.ids(pa.array(texts, pa.string())), many.ids(pa.array(texts, pa.string())), strict=True):
            assert np.array_equal(x, y)
    assert max(sizes) == 3
