import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*"ab  \n\t é½²٣中'sdll  \x1c\x85!-_🙂", "<|endoftext|>", "'ll", " don't", "\r\n", "   "]


@pytest.fixture(scope="module")
def coder():
    return bpe.coder_for(bpe.read_vocabulary(PATH))


def test_same_as_the_library(coder):
    library, rng = Tokenizer.from_file(PATH), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(40)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_decode_replaces_what_is_no_utf8(coder):
    assert coder.decode(coder.encode("é")[:1])[-1] in "é�"


def test_documents(spark):
    long = "ab " * 60_000 + "x" * 5_000
    rows = [(1, "Hello  world<|endoftext|>", "z"), (2, "", "z"), (3, None, "z"), (3, None, "z"), (4, long, "z"), (None, "a", "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string")
    got = sorted((r.doc_id or 0, r.n_tokens, r.decoded_sha256) for r in bpe.encode_documents(docs, PATH).collect())
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert [(d, s) for d, _, s in got] == sorted((d or 0, sha(t)) for d, t, _ in rows)
    assert bpe.encode_documents(docs.where("false"), PATH).count() == 0
