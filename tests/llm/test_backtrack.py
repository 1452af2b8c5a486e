"""The backtracking encoder against the tokenizers library and against plain merging of a small vocabulary."""

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wardflow.llm import backtrack, queries
from wardflow.llm.common import table

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def check(rows, texts, library):
    assert len(rows) == len(texts)
    got = sorted((str(r["doc_id"]), r["n_tokens"], list(r["ids"]), r["decoded"]) for r in rows)
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((str(doc_id), len(ids), ids, library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)


def test_odd_rows(odd, odd_rows, none, library):
    encoded = backtrack.encode_documents(odd, FILE)
    check(encoded.collect(), [(r[0], r[1]) for r in odd_rows], library)
    assert backtrack.encode_documents(none, FILE).count() == 0
    back = backtrack.decode_documents(encoded, FILE).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r[0]), r[1] or "") for r in odd_rows)


def test_hard_texts(library):
    draw = random.Random(7)
    bits = ["a", "e", "aa", "the", "ing", " ", "  ", "\n", "ab", "é", "😀", "<|endoftext|>", "<|endof", "0", "11", "!", "--", "='", "'s", "'S", "　", "\x1c", "\x85", "中", "​", "\x00"]
    texts = ["".join(draw.choice(bits) for _ in range(draw.randint(0, 30))) for _ in range(4000)]
    texts += ["".join(draw.choice("aeist" if k % 2 else "qzxjvk") for _ in range(200)) for k in range(400)]
    texts += ["".join(chr(draw.choice([draw.randint(0, 0x7FF), draw.randint(0x800, 0xD7FF), draw.randint(0xE000, 0x3FFFF)])) for _ in range(8)) for _ in range(4000)]
    texts += ["x" * 70_000, " " * 9_000 + "end", "ab" * 50_000, "=-" * 40_000]
    mine = backtrack.encoder(FILE)
    assert [mine.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_every_later_sign_splits_as_in_the_library(library):
    mine = backtrack.encoder(FILE)
    signs = [chr(c) for c in range(0x80, 0x40000) if backtrack._IS_LATER.match(chr(c))]
    texts = [f"a{s}1{s}! {s}" for s in signs[::7]]
    assert len(signs) > 10_000
    assert [mine.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def plain(merges, ids):
    """Merge the pair of lowest rank, the leftmost first, until none is left."""
    ids = list(ids)
    while True:
        at = min(((merges[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in merges), default=None)
        if at is None:
            return ids
        k = at[1]
        ids[k:k + 2] = ["".join(ids[k:k + 2])]


def test_all_short_words_of_made_vocabularies():
    """Vocabularies with runs of one letter and overlapping merges, where the longest match is often wrong."""
    for seed in range(12):
        draw = random.Random(seed)
        tokens, merges = ["a", "b", "c"], []
        while len(merges) < 14:
            pair = (draw.choice(tokens), draw.choice(tokens))
            if "".join(pair) not in tokens and len("".join(pair)) < 7:
                merges.append(pair)
                tokens.append("".join(pair))
        vocab = {s: k for k, s in enumerate(backtrack.byte_signs())}
        vocab |= {"".join(m): 256 + k for k, m in enumerate(merges)}
        enc = backtrack.Encoder(vocab, merges, {})
        name = {v: k for k, v in vocab.items()}
        rank = {m: k for k, m in enumerate(merges)}
        for word in itertools.chain.from_iterable(itertools.product("abc", repeat=n) for n in range(1, 8)):
            word = "".join(word)
            assert [name[t] for t in enc.encode_bytes(word.encode())] == plain(rank, word), (merges, word)


def test_broken_bytes_decode_with_marks(library):
    ids = [library.token_to_id("Ã"), library.token_to_id("Ġthe"), 50256]
    assert backtrack.encoder(FILE).decode(np.array(ids)).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_query(spark, sf_dir, library):
    import hashlib

    texts = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    want = []
    for doc_id, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((doc_id, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    rows = queries.op11_backtracking_bpe(spark, sf_dir).select(F.struct("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").alias("r")).collect()
    assert sorted(tuple(r["r"]) for r in rows) == sorted(want)
