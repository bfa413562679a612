"""Added tokens of the vocabulary in texts, as the tokenizers library finds them."""

import zlib

import numpy as np
import pytest


def test_added_tokens_in_texts(spark):
    pytest.importorskip("tokenizers")
    import public_tokenizers
    from tokenizers import Tokenizer

    from voltlake.llm import packing

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"a {mark} b", mark, f"{mark}{mark}", f"x  {mark}  y\n\n{mark}\n", f"don't {mark}'s <|endoftext| > <|ENDOFTEXT|>", "no mark", f"é{mark}字 " * 400]
    out = packing.tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    want = set()
    for i, text in enumerate(texts):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert (50256 in ids) == (mark in text)
        want |= {(i, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.piece_bounds(len(ids), packing.CAPACITY))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out} == want
