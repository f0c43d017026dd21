import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe

SCHEMA = "doc_id long, text string, ids string, decoded string"
TEXTS = [None, "", " ", "Hello world", "aaaaaaaaaaaa", "  two  spaces\n\n\ttabs \r\n", "don't we'll I'm", "<|endoftext|>", "a<|endoftext|>b<|endoftext|><|endoftext|>", "naïve façade Ünïcödé 漢字 🙂🙂", "1234567 3.14", "x" * 3000, " nbsp em", "\x00\x01", "é"]


def random_texts(n):
    random.seed(4)
    pools = ["abcdefghij ", "aAbB \n\t'", "éüßñ €漢", "0123456789.,-", "🙂🙃 a", " \n ​"]
    return ["".join(random.choice(random.choice(pools)) for _ in range(random.choice([1, 5, 60, 900]))) for _ in range(n)]


def test_same_as_the_library(spark):
    texts = TEXTS + random_texts(120) + ["word " * 40_000]
    docs = spark.createDataFrame([(i, t, "x", None) for i, t in enumerate(texts)] + [(0, None, "x", None)], SCHEMA)
    tok = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    tok.no_padding()
    tok.no_truncation()
    one = {r.id: r for r in bpe.round_trip(docs).collect()}
    two = {r.id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    assert len(one) == len(texts)
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert list(one[i].ids) == ids, repr(t)[:80]
        assert one[i].decoded == tok.decode(ids, skip_special_tokens=False) == (t or "")
        assert two[i] == one[i]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert bpe.round_trip(docs).collect() == []


@pytest.mark.parametrize("word", [b"aaaa", b"banana", b"\xff\xfe"])
def test_bytes_survive(word):
    table = bpe.Bpe(bpe.vocabulary())
    ids, sizes = table.merge([word])
    assert table.decode(ids) == word and sizes.sum() == len(ids)


def test_several_special_tokens():
    """The leftmost one first and of several there the longest, however many stand in a text."""
    import json

    import regex

    spec = json.loads(bpe.vocabulary())
    last = max(t["id"] for t in spec["added_tokens"])
    spec["model"]["vocab"]["<|endoftext|>"] = last
    for n, content in enumerate(["<s>", "<s>>", "</s>"], last + 1):
        spec["added_tokens"].append({"id": n, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True})
        spec["model"]["vocab"][content] = n
    table, tok = bpe.Bpe(json.dumps(spec)), Tokenizer.from_str(json.dumps(spec))
    texts = ["a<s>b</s>c", "<s>><s></s>", "<s>" * 3000 + " x", "<|endoftext|><s> <s", ""]
    ids, offsets = table.encode(texts, regex.compile(bpe.SPLIT))
    for i, t in enumerate(texts):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, t
