"""Speculated BPE against the tokenizers library."""

import hashlib
import json
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from pairforge.llm import bpe_speculate
from tests.sides import duck

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def bpe():
    with open(PATH, encoding="utf-8") as f:
        return bpe_speculate.Bpe(f.read())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_every_token_of_one_symbol_and_most_others_encode_to_themselves(bpe):
    assert bpe.ordered and bpe.itself.mean() > 0.9
    inverse = {i: s for s, i in bpe.ids.items()}
    for i in random.Random(0).sample(range(bpe.size), 3000):
        assert (bpe.merged(inverse[i]) == [i]) == bool(bpe.itself[i])


def test_speculation_equals_exact_merging_on_joined_tokens(bpe):
    """Pairs and triples of random tokens: where a border is crossed by no merge, and where it is."""
    draw = random.Random(1)
    inside = [s for s in bpe.ids if all(ord(c) < 0x10000 for c in s)]
    words = {"".join(draw.choice(inside) for _ in range(draw.randint(1, 3))) + chr(0x10000 + ord(draw.choice("aest!"))) for _ in range(20_000)}
    words |= {a * n + chr(0x10000 + ord(a)) for a in "aehx!." for n in range(40)}
    words = sorted(words)
    greedy = [[t for _, t in bpe.automaton.iter_long(w)] for w in words]
    exact = [bpe.merged(w) for w in words]
    assert 0.1 < sum(g == e for g, e in zip(greedy, exact, strict=True)) / len(words) < 0.95  # both branches are used
    assert bpe.speculated(words) == exact
    assert [bpe._merged_long([bpe.ids[s] for s in w]) for w in words] == exact


def test_pieces_of_code_points_equal_the_library(bpe, library):
    """Each character between letters, digits, signs and spaces; special tokens; marks that compose; a final sigma."""
    draw = random.Random(2)
    points = [*range(0x3000), *draw.sample([c for c in range(0x3000, 0x110000) if not 0xD800 <= c < 0xE000], 3000)]
    texts = [f"Ab{chr(c)}1{chr(c)}{chr(c)} {chr(c)}!x{chr(c)}" for c in points]
    texts += ["", " ", "<|endoftext|>", "a<|endoftext|><|startoftext|> b<|endoftext", "ȩ́ ΑΣ ΣΑΣ. ΟΔΟΣ", "it's we'LL 'sx 'S", "x</w> y</w", "\x00\x1c\x1d﻿", "Ünï 漢字 テスト 🙂🙂", "a" * 5000, "!" * 3001]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert bpe.encoded(texts).to_pylist() == want
    assert bpe.decoded(pa.array(want, pa.list_(pa.int32()))).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_a_long_word_takes_time_that_grows_little_more_than_its_length(bpe, library):
    draw = random.Random(3)
    word = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))
    assert bpe.encoded([word]).to_pylist() == [library.encode(word, add_special_tokens=False).ids]
    assert word not in bpe.kept


def test_merges_out_of_order_are_merged_exactly():
    spec = {"model": {"type": "BPE", "vocab": {"a": 0, "b": 1, "c": 2, "abc": 3, "ab": 4}, "merges": [["ab", "c"], ["a", "b"]], "end_of_word_suffix": None}, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "version": "1.0"}
    text = json.dumps(spec)
    mine = bpe_speculate.Bpe(text)
    assert not mine.ordered
    for t in ("abc", "ab", "cab abab", "abcabc"):
        assert mine.encoded([t]).to_pylist() == [Tokenizer.from_str(text).encode(t, add_special_tokens=False).ids]


def test_the_kept_words_are_bounded(bpe, monkeypatch, library):
    monkeypatch.setattr(bpe_speculate, "KEPT_WORDS", 10)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(400))
    for _ in range(2):
        assert bpe.encoded([text]).to_pylist() == [library.encode(text, add_special_tokens=False).ids]
        assert len(bpe.kept) <= 10


def digests(ids, text):
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_the_library(spark, library, sf):
    folder = f"/root/testdata/{sf}"
    got = sorted(tuple(r) for r in bpe_speculate.op11_speculative_bpe(spark, folder).collect())
    rows = duck("select doc_id, text from documents", folder)
    want = []
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, *digests(ids, library.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)


def test_odd_rows_clashing_columns_and_an_empty_table(spark, library):
    rows = [(1, None, None), (None, "", "en"), (None, "Two words", "en"), (3, "Two words", None), (3, "Two words", None), (4, " \n\t", "en"), (5, "Wörter und " * 20_000, "de")]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' AS ids", "'y' AS decoded", "1 AS n_tokens")
    out = bpe_speculate.decode(bpe_speculate.encode(docs, PATH), PATH)
    assert set(out.columns) == set(docs.columns)
    got = out.collect()
    assert sorted(str((r.doc_id, r.text, r.lang, r.n_tokens)) for r in got) == sorted(str((*r, 1)) for r in rows)
    for r in got:
        assert r.ids == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == library.decode(r.ids, skip_special_tokens=False)
    assert bpe_speculate.encode(docs.where("false"), PATH).collect() == []
    odd_ids = spark.createDataFrame([(1, None), (2, []), (3, [0, None, -1, 10**6])], "doc_id long, ids array<int>")
    assert [r.decoded for r in bpe_speculate.decode(odd_ids, PATH).orderBy("doc_id").collect()] == [None, "", "!"]
