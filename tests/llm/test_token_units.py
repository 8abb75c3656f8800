"""The units that token files are encoded by, held against the library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa

from termlake.llm import token_files
from termlake.llm.common import chunks, utf8

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def encoded(encoder, texts, block=1 << 16):
    raw, off = utf8(pa.array(texts, pa.string()))
    for a, b in chunks(off, block):
        ids, places = encoder(raw, off[a : b + 1])
        yield from (ids[i:j].tolist() for i, j in zip(places[:-1], places[1:], strict=True))


def by_library(texts):
    library = token_files.tokenizer(WORD_BPE)
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_every_character_beside_plain_ones():
    texts = [f"ab{c}cd {c} Xe{c} {c}'s J{c}9 \n{c}{c}" for c in map(chr, [*range(0x3100), *range(0xFB00, 0x10000), *range(0x1F600, 0x1F650)])]
    assert list(encoded(token_files.WordEncoder(WORD_BPE), texts)) == by_library(texts)


def test_mixed_units_with_a_cache_that_starts_anew():
    rng = random.Random(1)
    parts = [*"abcABZ  \n\t\r\x0b\x0c019'!#&$%<|>/éÉßÀÞ×÷ªµ\x1c\x1f\x85\xa0́̌ 　日ſKİΣς’—\x00\x7f", "<|endoftext|>", "'ll", "'s", "the", "</w>", "É" * 70]
    texts = ["", None, " ", *("".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(5000)), "x" * 200 + "'s " + "!" * 100]
    encoder = token_files.WordEncoder(WORD_BPE, most=500)
    assert list(encoded(encoder, texts, block=4096)) == by_library(texts)
    assert len(encoder.known) < 5000


def test_other_tokenizers_get_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  Words,\n it's A\tB 2024!", "", None, "<|endoftext|> Übung ÉTÉ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in token_files.read_token_files(token_files.write_token_files(docs, path, 2)).collect()}
    library = token_files.tokenizer(path)
    assert got == {i: zlib.crc32(np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, t in enumerate(texts)}


class Counted:
    """The library, counting what it is asked for."""

    def __init__(self, library, asked):
        self.library, self.asked = library, asked

    def encode_batch_fast(self, texts, **more):
        self.asked.extend(texts)
        return self.library.encode_batch_fast(texts, **more)


def test_new_words_go_to_the_library_many_at_once():
    """Made-up words with signs behind them, most of them new, as in the corpus that took over 400 CPU seconds a GB, as each new one was a call's item."""
    rng = random.Random(2)
    syllables = ["er", "th", "an", "ing", "est", "ou", "ion", "ed", "ä", "ble", "sch", "or", "ze", "ki"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 7))).capitalize() + rng.choice(["", ",", "&&&", "$$$", "###", "%%%."]) for _ in range(100)) for _ in range(200)]
    encoder, asked = token_files.WordEncoder(WORD_BPE), []
    encoder.library, encoder.pieces = Counted(encoder.library, asked), Counted(encoder.pieces, asked)
    assert list(encoded(encoder, texts, block=8 << 20)) == by_library(texts)
    parts = sum(len(t.split()) for t in asked)
    assert parts > 5000 and len(asked) < parts / 200, (parts, len(asked))
    del asked[:]
    assert list(encoded(encoder, texts)) == by_library(texts)
    assert not asked
