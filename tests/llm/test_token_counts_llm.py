import re
import tempfile

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm.token_counts import read_cache, token_counts

from .conftest import nasty_texts

FILE = str(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def cache():
    return f"file://{tempfile.mkdtemp(prefix='tideline-test-')}/cache"


def test_counts_equal_the_library(spark, nasty, library):
    path = cache()
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(nasty, path, FILE).collect())
    want = []
    for k, t in nasty_texts():
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((str(k), len((t or "").encode()), n, n > 2048))
    assert got == sorted(want)
    stored = read_cache(spark, path)
    distinct = {re.sub("[ \t\r\n]+", " ", t or "").strip(" ") for _, t in nasty_texts()}
    assert stored.count() == stored.select("digest").distinct().count() == len(distinct)


def test_special_strings_white_space_and_composition(spark, library):
    texts = ["a<|endoftext|>b  <|startoftext|>", "it's  don't\n\nWE'LL", "é ́x y\x1cz\x85w", "<| endoftext|>", "12 345", " "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts(docs, cache(), FILE).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_second_run_encodes_only_misses(spark):
    path = cache()
    docs = spark.createDataFrame([(1, "some words"), (2, "some  words "), (3, "more")], "doc_id long, text string")
    token_counts(docs, path, FILE).collect()
    assert read_cache(spark, path).count() == 2
    more = docs.union(spark.createDataFrame([(4, "quite new")], docs.schema))
    assert token_counts(more, path, FILE).count() == 4
    assert read_cache(spark, path).count() == 3


def test_empty(spark, nothing):
    assert token_counts(nothing, cache(), FILE).count() == 0
