"""Token ids of a public byte-level BPE vocabulary, with a bounded cache of what stands between spaces.

Ids are those of ``tokenizers`` without special tokens around the text. What the vocabulary lists as a special token
becomes that token's id also where it stands in a text, unless ``plain`` asks to read it like any other text, as must be
where such an id has a meaning of its own. A text that holds a special token is encoded in one piece.

The vocabulary's rule never lets a token reach over a space that follows a visible character, so that a text may be cut
before each such space and the parts encoded alone. Parts repeat far more often than texts do. The cut is made only
after characters known to be visible (printable ASCII, U+00A1 to U+024F); elsewhere the text stays in one part. The
rule also ends a run of letters at a punctuation mark.
"""

from __future__ import annotations

import json
import os
import re
import string
import struct

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
CACHE = 500_000  # parts kept per worker in each of two halves, together some 200 MB
_PART = 64  # characters; longer parts are not kept
_LINES = 500  # words encoded as one text

MARKS = ".,;:!?"

# The character that stands for each byte in byte-level vocabularies: its own if that is visible in Latin-1, else one from 256 on.
_shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
_of_byte = {b: chr(b) for b in _shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in set(_shown))}
_as_bytes = {c: "".join(_of_byte[b] for b in chr(c).encode()) for c in range(0x250)}

_letters = frozenset(string.ascii_letters)
_visible = frozenset(map(chr, [*range(0x21, 0x7F), *range(0xA1, 0x250)]))
_cut = re.compile("(?<=[!-~¡-ɏ])(?= )")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit numbers."""

    _made: dict[tuple[str, bool], Encoder] = {}

    def __init__(self, vocabulary: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        known = self.tokenizer.get_added_tokens_decoder().values()
        special = [re.escape(token.content) for token in known if not (plain and token.special)]
        self.special = re.compile("|".join(special)) if special else None
        rule = json.loads(self.tokenizer.to_str())
        byte_level = rule["pre_tokenizer"] or {}
        plain_rule = (byte_level.get("type"), byte_level.get("add_prefix_space"), byte_level.get("use_regex")) == ("ByteLevel", False, True)
        self.model = self.tokenizer.model if plain_rule and rule["model"]["type"] == "BPE" and rule["normalizer"] is None else None
        line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line_break = line_break[0] if len(line_break) == 1 else None
        # What is found in the elder half moves to the younger; when that is full, it becomes the elder.
        self.cache: dict[str, bytes] = {}
        self.elder: dict[str, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str = VOCABULARY, plain: bool = False) -> Encoder:
        """The worker's encoder of a vocabulary: a name among the public ones, or a path."""
        key = (vocabulary, plain)
        if key not in cls._made:
            cls._made[key] = cls(vocabulary, plain)
        return cls._made[key]

    def width(self) -> int:
        """Bytes that hold any id of the vocabulary: 2 or 4."""
        return 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def _packed(self, texts: list[str]) -> dict[str, bytes]:
        """Ids of each text. Words of letters are what the vocabulary's rule leaves whole and go to its model, byte by byte as
        characters; other words go to one text of lines."""
        out, lines, rest = {}, [], []
        model = self.model
        for x in texts:
            if x[0] == " " and x[1:2] in _visible and x[-1] in _visible:
                if model is not None and x[1:].isalpha() and (x.isascii() or max(x) < "\u0250"):
                    ids = [token.id for token in model.tokenize("Ġ" + x[1:] if x.isascii() else x.translate(_as_bytes))]
                    out[x] = struct.pack(f"<{len(ids)}I", *ids)
                elif "\n" not in x:
                    lines.append(x)
                else:
                    rest.append(x)
            else:
                rest.append(x)
        joined = self._lines(lines) if len(lines) > 1 else None
        if joined is None:
            rest += lines
        else:
            out.update(zip(lines, joined))
        out.update(zip(rest, self._one_by_one(rest)))
        return out

    def _one_by_one(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in made]

    def _lines(self, words: list[str]) -> list[bytes] | None:
        """Ids of words that begin with a space, from texts with a line break, which is a token of its own there, behind
        each. None where that does not hold."""
        if self.line_break is None:
            return None
        texts = ["".join(f"{x}\n" for x in words[k: k + _LINES]) for k in range(0, len(words), _LINES)]
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, "<u4") for x in made])
        ends = np.flatnonzero(ids == self.line_break)
        if len(ends) != len(words):
            return None
        raw, edges = ids.tobytes(), (4 * ends).tolist()
        return [raw[a:b] for a, b in zip([0, *(e + 4 for e in edges)], edges)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of every text. Parts not met before are encoded together."""
        if len(self.cache) > CACHE:
            self.cache, self.elder = {}, self.cache
        whole = [k for k, text in enumerate(texts) if self.special and self.special.search(text)]
        cut = [self._parts(text) for text in texts]
        for k in whole:
            cut[k] = [], []
        fresh = self._fresh({part for _, missing in cut for _, part in missing})
        for found, missing in cut:
            for k, part in missing:
                found[k] = fresh[part]
        out = [b"".join(found) for found, _ in cut]
        for k, ids in zip(whole, self._one_by_one([texts[k] for k in whole])):
            out[k] = ids
        return out

    def _fresh(self, new: set[str]) -> dict[str, bytes]:
        """Ids of parts. A mark after a word is a token of its own, so that the word is encoded, or known, without it."""
        cache, elder, fresh, sought = self.cache, self.elder, {}, set()
        if elder:
            fresh = {part: ids for part in new if part[0] == " " and (ids := elder.get(part[1:])) is not None}
            new = new.difference(fresh)
        marked = [part for part in new if part[-1] in MARKS and part[-2:-1] in _letters and len(part) > 1]
        for part in marked:
            word = part[:-1]
            ids = None
            if word[0] == " ":
                ids = cache.get(word[1:]) or elder.get(word[1:])
            if ids is None:
                sought.add(word)
            else:
                fresh[word] = ids
            sought.add(part[-1])
        fresh.update(self._packed(list(new.difference(marked) | sought)))
        for part in marked:
            fresh[part] = fresh[part[:-1]] + fresh[part[-1]]
        cache.update({part[1:]: ids for part, ids in fresh.items()
                      if part[0] == " " and part[-1] in _visible and len(part) <= _PART and " " not in part[1:]})
        return fresh

    def _parts(self, text: str) -> tuple[list, list[tuple[int, str]]]:
        """Ids of a text's parts as far as the cache has them, and the parts that it lacks, with their places."""
        if not text:
            return [], []
        first, *words = text.split(" ")
        cache = self.cache
        found = [None, *map(cache.get, words)]  # only words with a visible last character are in the cache
        missing = [(k, " " + words[k - 1]) for k, ids in enumerate(found) if ids is None and k]
        last = len(words)
        if (not words or first[-1:] in _visible) and all(part[-1] in _visible or k == last for k, part in missing):
            return found, [(0, first), *missing] if first else missing
        parts = _cut.split(text)
        found = [cache.get(part[1:]) if part[0] == " " and " " not in part[1:] else None for part in parts]
        return found, [(k, parts[k]) for k, ids in enumerate(found) if ids is None]
