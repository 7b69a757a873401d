import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import packing, tokens


ODD = ["a it's, don't. x!! y!? 's. foo.", "a foo, foo. foo foo! Foo, foo.", "", " ", "  ", " a", "a ", " a  b \n c\n d", "a　 b c",
       "it's  don't 12 3", "\x1c a \x85 b", " \n", "<|endoftext|> a", "a <|endoftext|>, b<|endoftext|>.", " <|endoftext|> <|endoftext|>x",
       "a\nb c\n\nd, e \n f", "x" * 200 + " y " + "z" * 200]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_direct_tokenisation(plain, monkeypatch):
    """Against tokenizers as they are made from the file."""
    monkeypatch.setattr(tokens, "CACHE", 40)
    direct = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    direct.encode_special_tokens = plain
    encoder, pick = tokens.Encoder(tokens.VOCABULARY, plain), random.Random(1)
    odd = [*ODD, *("".join(pick.choice(" \n\ta1é.'s  \x1c") for _ in range(30)) for _ in range(500)),
           *(" ".join(pick.choice(("word", "words", "naïve", "<|endoftext|>", "so,", "1,5", "end.")) for _ in range(9)) for _ in range(200))]
    for _ in range(3):  # later times from the cache
        for at in range(0, len(odd), 7):
            for text, ids in zip(odd[at: at + 7], encoder.encode(odd[at: at + 7])):
                assert np.frombuffer(ids, "<u4").tolist() == direct.encode(text, add_special_tokens=False).ids, repr(text)
        assert len(encoder.cache) + len(encoder.elder) < 200


def check(rows, ids):
    """rows: (doc, start, length, crc, total, sequence, offset); ids: by document."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in rows:
        body = ids[doc]
        assert total == len(body) and length > 0 and crc == zlib.crc32(body[start: start + length].astype("<u4").tobytes())
        pieces[doc].append((start, length)), sequences[sequence].append((offset, length))
    for doc, body in ids.items():
        at = 0
        for start, length in sorted(pieces[doc]):
            assert start == at
            at += length
        assert at == len(body)
    padding = tokens = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        tokens += at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding / max(1, tokens)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(1, 70), st.integers(1, 9000)), max_size=80))
def test_each_token_in_one_piece(lengths):
    ids = {k: np.arange(n, dtype="<u4") for k, n in enumerate(lengths)}
    packer = packing.Packer(0)
    rows = [r for k, body in ids.items() for r in packer.add(k, body.tobytes())]
    check([*rows, *packer.end()], ids)


def test_table(table, texts):
    rows = [(k, t) for k, t in enumerate([*(t for _, t in texts), *ODD])]
    found = packing.pack(table(rows)).collect()
    direct = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    ids = {k: np.append(direct.encode(t or "", add_special_tokens=False).ids, 1).astype("<u4") for k, t in rows}
    assert check([tuple(r) for r in found], ids) < 0.02
    again = packing.pack(table([(None, "a b"), (None, "a b"), (7, None)])).collect()
    assert sum(r.length for r in again) == 3 + 3 + 1 and packing.pack(table([])).count() == 0


def test_words_of_letters_equal_direct_tokenisation():
    """Of all letters that the encoder hands to the model itself."""
    direct = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))
    letters = [chr(c) for c in range(0x250) if chr(c).isalpha()]
    pick = random.Random(7)
    words = [" " + "".join(pick.choices(letters, k=pick.randrange(1, 12))) for _ in range(5000)] + [f" {c}" for c in letters]
    words += [" " + "".join(pick.choices("abcdeABCinguäöß", k=9)) for _ in range(3000)]
    made = tokens.Encoder(tokens.VOCABULARY)._packed(words)
    for word in words:
        assert np.frombuffer(made[word], "<u4").tolist() == direct.encode(word, add_special_tokens=False).ids, word
