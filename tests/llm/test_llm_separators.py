import numpy as np
import pytest

from tallyspark.llm import separators
from tallyspark.llm.tokens import VOCABULARY

import public_tokenizers
from tokenizers import Tokenizer


@pytest.mark.parametrize("block", [2, 10, 998, 1_000_000])
def test_counts_equal_direct_tokenisation(table, texts, block):
    rows = texts[:25] + texts[-17:] if block < 1000 else texts
    rows = [(i, t[:300] if t and block == 2 else t) for i, t in rows]
    rows.append((5, "x <|endoftext|> y<|endoftext|>"))
    direct = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    direct.encode_special_tokens = True
    want = sorted((str(i), len(direct.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    got = sorted((str(r.doc_id), r.n_tokens) for r in separators.token_counts(table(rows), block=block).collect())
    assert got == want


def test_files_without_index(spark, table, tmp_path, monkeypatch):
    """Flat files: neighbouring separators, an open end, no separator at all, an empty file."""
    end = separators.SEPARATOR
    files = {"a": [1, 2, end, end, 3, end, 4, 5], "b": [7] * 40, "c": [], "d": [end, end]}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    monkeypatch.setattr(separators, "SEGMENT", 2)
    for block in (2, 4, 6, 1000):
        found = separators.scan(separators.blocks_of(spark, str(tmp_path), block)).collect()
        got = sorted((r.file[-1], r.ordinal, r.start, r.n_tokens, r.complete) for r in found)
        assert got == [("a", 0, 0, 2, True), ("a", 1, 3, 0, True), ("a", 2, 4, 1, True), ("a", 3, 6, 2, False),
                       ("b", 0, 0, 40, False), ("d", 0, 0, 0, True), ("d", 1, 1, 0, True)]


def test_larger_vocabulary_takes_wider_ids(table, tmp_path):
    """A vocabulary of more than 65,536 ids, among them one that is the separator's in its low 16 bits."""
    tokenizer = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    tokenizer.add_tokens([f"extra{k}" for k in range(70_000)])
    path = str(tmp_path / "wide.json")
    tokenizer.save(path)
    low = next(k for k in range(70_000) if tokenizer.token_to_id(f"extra{k}") == (1 << 16) + separators.SEPARATOR)
    rows = [(1, f"a extra{low} extra{low} b"), (2, f"extra{low}"), (3, None)]
    assert separators.width_of(path) == 4 and separators.width_of() == 2
    got = {r.doc_id: r.n_tokens for r in separators.token_counts(table(rows), vocabulary=path, block=8).collect()}
    assert got == {i: len(tokenizer.encode(t or "").ids) for i, t in rows}


def test_empty_table(table):
    assert separators.token_counts(table([])).count() == 0
