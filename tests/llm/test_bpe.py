"""Forced-boundary encoding against the library that reads the same vocabulary file, and against merging without cuts."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from framelake.llm import bpe_codec, registry
from framelake.llm.vocab import default_path

PATH = default_path(bpe_codec.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def want(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return ids, library.decode(ids, skip_special_tokens=False)


def test_query_matches_library_on_every_document(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    expected = set()
    for d in docs:
        ids, text = want(library, d.text)
        expected.add((d.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(text)))
    assert {tuple(x) for x in registry.op11_bpe(spark, sf_dir).collect()} == expected


def test_settled_characters_are_read_as_the_library_reads_them(library):
    c = bpe_codec.codec(PATH)
    for low, high in bpe_codec.SETTLED:
        for cp in range(low, high + 1, 1 if high - low < 4096 else 17):
            s = f"a{chr(cp)}{chr(cp)}1{chr(cp)}́b"
            assert list(c.encode(s)) == want(library, s)[0], hex(cp)


def test_random_texts(library):
    c, r = bpe_codec.codec(PATH), random.Random(5)
    letters = "ab'sS<|>endoftx startΣσς́̇İIéñ1２½\n\t\x1c\x85\xa0؀ẞß😀👍𝟘字한가‍﻿ ៝\U00010d50"
    for _ in range(5000):
        s = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        if r.random() < 0.3:
            s = s[:5] + "<|endoftext|>" + s[5:]
        ids, text = want(library, s)
        assert list(c.encode(s)) == ids and c.decode(ids) == text, repr(s)


def test_cuts_change_nothing_and_do_cut():
    """Fragments apart give the ids of the whole word, and no token holds a pair that is cut."""
    c, r = bpe_codec.codec(PATH), random.Random(2)
    n_cuts = 0
    for _ in range(3000):
        word = "".join(r.choice("etaoinqzxjvkw") for _ in range(r.randint(1, 12)))
        symbols = c.symbols(word + c.end)
        at = c.cuts(symbols)
        n_cuts += len(at) - 2
        assert list(c.encode_word(word)) == c.merged(symbols)
        assert not any((symbols[i - 1], symbols[i]) in c.inside for i in at[1:-1])
    assert n_cuts > 1000


def test_words_without_any_space_stay_fast(library):
    c = bpe_codec.codec(PATH)
    for s in ("a" * 100_000, "xq" * 50_000, "é" * 20_000):
        assert list(c.encode(s)) == want(library, s)[0]


def test_odd_rows_and_parts(spark, make, odd_rows, library):
    docs = make(odd_rows).withColumnRenamed("label", "d.id").withColumnRenamed("key", "ids")
    for part in (bpe_codec.PART, 64):
        got = sorted((repr(x.doc_id), tuple(x.ids), x.decoded) for x in bpe_codec.encode(docs, part=part, decoded=True).collect())
        assert got == sorted((repr(i), tuple(want(library, t)[0]), want(library, t)[1]) for i, t, *_ in odd_rows)
    assert bpe_codec.encode(docs.limit(0), decoded=True).collect() == []


def test_decode_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, [320, None, 49407, 99999999], "x"), (2, None, "y"), (3, [], "z")], "k int, ids array<int>, decoded string")
    got = {x.k: x.decoded for x in bpe_codec.decode(rows).collect()}
    assert got == {1: f"{bpe_codec.codec(PATH).names[320]} <|endoftext|>", 2: "", 3: ""}
