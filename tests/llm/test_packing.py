"""Token ids of vectorised parts against the tokenizer on whole texts."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from paywake.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = "abcXYZ019!#$.,'-_<|>  \t\n\r\x0b\x0c\x00\x1c\x85\xa0éÉßñüÜ×÷²¼ªµİŒſʼnǅʰ˙éΩΣς日本\U0001f600 　"


def coded(texts, coder):
    table = packing.PartTable(pa.array(texts), packing._LOWER)
    ids, sizes = coder(table.words.to_pylist())
    first = np.cumsum(sizes) - sizes
    out = [[] for _ in texts]
    for row, code in zip(table.row, table.code):
        out[row] += ids[first[code]:first[code] + sizes[code]].tolist()
    return out


def test_parts_have_the_ids_of_whole_texts():
    rng, tokenizer = random.Random(7), Tokenizer.from_file(TOKENIZER)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|startoftext|> a<|endoftext|>b", "it's we'll they're 'tis", "", "<", "é", "a" * 5000]
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    coder = packing.TokenIds(TOKENIZER)
    assert coded(texts, coder) == expected
    assert coded(texts[::-1], coder) == expected[::-1]      # mostly remembered now
    assert coded([None, "", " \n"], coder) == [[], [], []] and coded([], coder) == []


def test_a_full_table_still_gives_the_ids(monkeypatch):
    monkeypatch.setattr(packing, "SETS", 3)
    tokenizer, coder = Tokenizer.from_file(TOKENIZER), packing.TokenIds(TOKENIZER)
    for seed in range(5):
        rng = random.Random(seed)
        texts = [" ".join(f"w{rng.choice('abcdefgh')}{rng.choice('stuvxyz') * 3}" for _ in range(20)) for _ in range(30)]
        assert coded(texts, coder) == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert (coder.size > 0).all()
