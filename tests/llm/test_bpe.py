"""The streaming transducer: any cut into pieces gives the library's tokens, and memory doesn't grow with a text or a word."""

import hashlib
import random
import tracemalloc
import unicodedata

import pytest

from quilt.llm import bpe
from quilt.llm.queries import vocabulary


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(vocabulary())
    out.no_truncation()
    out.no_padding()
    return out


@pytest.fixture(scope="module")
def small():
    """A transducer whose pieces and blocks are so short that every boundary is met."""
    t = bpe.Transducer(vocabulary())
    t.piece = 23
    return t


POOL = "abcdefghijklmnopqrstuvwxyzthethe  ''sdllve1234567890½²Ⅷ٣\t\n\x85\xa0　!?ΣσςİıßŉÀàééà中文字🙂ǅก̀̂_-#각ᅡᆨ"


def test_pieces_of_any_size_give_the_library_s_tokens(lib, small):
    r = random.Random(3)
    for k in range(500):
        pool = POOL if k % 3 else "ab'sdlrevtm!?1é̀"
        x = "".join(r.choice(pool) for _ in range(r.randint(0, 200)))
        if k % 5 == 0:
            x = x[:90] + "<|endoftext|>" + x[:7] + "<|startoftext|>" + x[90:]
        small.piece = r.choice([2, 5, 23, 64])
        ids = lib.encode(x, add_special_tokens=False).ids
        assert small.encode(x) == ids
        machine = bpe.Decoder(small)
        shown = "".join(machine.feed_words(c) for c in small.stream(x)) + machine.close()
        assert shown == lib.decode(ids, skip_special_tokens=False)


def test_words_longer_than_a_piece_are_streamed(lib, small):
    r = random.Random(4)
    for pool in ("theandionsrt", "中文字", "!?*#", "aé̂", "theandionsrt'"):
        x = "start " + "".join(r.choice(pool) for _ in range(6000)) + "1 end"
        for small.piece in (300, 1000):
            assert small.encode(x) == lib.encode(x, add_special_tokens=False).ids


def test_pieces_are_cut_where_normalisation_can_t_reach():
    r = random.Random(5)
    for _ in range(300):
        x = "".join(r.choice("aeéÀ̀̂각가 \n") for _ in range(80))
        cut = [p for p, _ in bpe.pieces_of(x, 0, len(x), r.choice([2, 7, 20]))]
        assert "".join(cut) == x
        assert "".join(unicodedata.normalize("NFC", p) for p in cut) == unicodedata.normalize("NFC", x)


def test_memory_is_constant_for_one_long_word(lib):
    t = bpe.Transducer(vocabulary())
    r = random.Random(6)
    peaks = []
    for n in (200_000, 800_000):
        x = "".join(r.choice("theandionsrt") for _ in range(n))
        count, digest = 0, hashlib.sha256()
        next(t.stream("warm up"))
        tracemalloc.start()
        for chunks in t.stream(x):
            count += sum(c.count(" ") + 1 for c in chunks)
            digest.update(" ".join(chunks).encode() + b" ")
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if n == 200_000:
            ids = lib.encode(x, add_special_tokens=False).ids
            assert count == len(ids) and digest.hexdigest() == hashlib.sha256((" ".join(map(str, ids)) + " ").encode()).hexdigest()
    assert peaks[1] < 1.3 * peaks[0]


def test_readable_text_is_decoded_byte_by_byte(small):
    for x in ("héllo 🙂 wörld", "naïve 中文 text"):
        ids = small.encode(x)
        assert "".join(small.decode_stream(ids)).split() == x.split()
    machine = bpe.Decoder(small, readable=True)
    euro = [next(i for i, v in small.bytes_of_token.items() if v[0] == bytes([b]) and not v[1]) for b in "€".encode()]
    assert [machine.feed([i]) for i in euro] == ["", "", "€"] and machine.close() == ""
    assert machine.feed(euro[:1]) == "" and machine.close() == "�"
