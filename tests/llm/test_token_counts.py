import json
import random

import numpy as np
import pytest

from quarrymill.llm.common import public_tokenizer, table
from quarrymill.llm.queries import op12_token_counts
from quarrymill.llm.token_counts import LONG, Merges, count_tokens, load_merges, merge_long, merge_ragged, text_counter

PATH = public_tokenizer("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(PATH).encode_batch(list(texts), add_special_tokens=False)]


@pytest.fixture(scope="module")
def merges():
    return load_merges(PATH)


def test_query_equals_the_library(spark):
    rows = {r.doc_id: r for r in op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    docs = table(spark, "/root/testdata/sf0.001", "documents").collect()
    assert len(rows) == len(docs)
    for d, n in zip(docs, library([d.text or "" for d in docs])):
        assert (rows[d.doc_id].n_bytes, rows[d.doc_id].n_tokens, rows[d.doc_id].over_limit) == (len((d.text or "").encode()), n, n > 512)


@pytest.mark.parametrize("seed", range(3))
def test_any_characters(merges, seed):
    rng = random.Random(seed)
    ranges = [(32, 127), (0, 0x250), (0x2000, 0x2100), (0x4E00, 0x4F00), (0, 0xD800), (0xE000, 0x110000)]
    texts = ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(80))) for _ in range(1500)]
    texts += ["".join(rng.choice("aab ") for _ in range(rng.randrange(LONG * 3))) for _ in range(20)]
    assert list(text_counter(merges, lot=5000, bound=300)(iter(texts))) == library(texts)


def test_blanks_specials_and_contractions(merges):
    texts = ["", " ", "  x", "a \n\n b\t", "\x1c\x85　 z", "don't I'LL we've", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endof", "é՘ ՘", "\x00"]
    assert list(text_counter(merges)(iter([None, *texts]))) == [0, *library(texts)]


def test_long_texts_without_blanks(merges):
    rng = random.Random(4)
    texts = ["a" * 50_000, "ab" * 9_999, "".join(rng.choice("abcdefghij") for _ in range(40_000)), "é" * 3000, " " * 5000, "<" * 4096]
    assert list(text_counter(merges)(iter(texts))) == library(texts)


def test_rounds_of_both_kinds_agree(merges):
    rng = np.random.default_rng(5)
    sequences = [merges.first[rng.integers(97, 97 + k, size=n)] for k, n in ((1, 9), (2, 40), (3, 700), (26, 1000), (5, 2), (5, 1))]
    assert merge_ragged(merges, np.concatenate(sequences), np.array(list(map(len, sequences)))).tolist() == [merge_long(merges, s) for s in sequences]


def test_empty_arrays(merges):
    assert merge_ragged(merges, np.zeros(0, np.int32), np.zeros(0, np.int64)).tolist() == []


def test_table_cases(spark):
    rows = [(1, None, "x"), (1, "two words", "y"), (None, "two words", "z"), (2**60 + 1, "", "x")]
    got = count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, limit=1).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, 0, 0, False), (1, 9, 2, True), (None, 9, 2, True), (2**60 + 1, 0, 0, False)], key=str)
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_tokenizers_are_an_error(tmp_path):
    spec = json.load(open(PATH, encoding="utf-8"))
    spec["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        load_merges(str(tmp_path / "t.json"))
    with pytest.raises(ValueError):
        Merges(np.arange(3), np.array([[3, 0], [0, 1]]), np.array([4, 3]), [])
