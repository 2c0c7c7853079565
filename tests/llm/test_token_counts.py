"""Compiled token counts against the tokenizer's library."""

import json
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from broadsheet.llm import token_counts as module
from broadsheet.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
LETTERS = "abcstrevmld'''''  \n12½٣éÉÅΣσİŁŸ日本\U0001f389!?.-_<|>́̀​ 　ﬁǅ\x00\x1c\x85ẞK"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "word " * 20_000), (5, "a" * 50_000), (6, "<|endoftext|>a<|startoftext|>'s<|ENDOFTEXT|><|endoftext|"),
       (6, "It's we'll WE'RE 'RE 're're 'r 'v' 'l"), (7, "'r"), (8, "'"), (None, "''s"), (9, "ΟΔΟΣ Σ İ ĳ Å é"), (10, " " * 5000 + "x")]


def library(texts):
    return [len(e.ids) for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def machine():
    return module.Compiled(PATH)


def test_counts_equal_the_library(machine):
    rng = random.Random(1)
    texts = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [f"a{c}b{c} {c}" for c in points[::41]]
    assert machine.tokens(list(texts)).tolist() == library(texts)
    assert machine.tokens([]).tolist() == []


def test_forgetting_states_and_words_changes_nothing(monkeypatch):
    monkeypatch.setattr(module, "STATES", 50)
    monkeypatch.setattr(module, "WORDS", 20)
    fresh, rng = module.Compiled(PATH), random.Random(2)
    for _ in range(20):
        texts = ["".join(rng.choice("abcde fgh ij") for _ in range(40)) for _ in range(10)]
        assert fresh.tokens(list(texts)).tolist() == library(texts)
    assert len(fresh.counter.places) < 500


def test_chunks_compose(monkeypatch):
    """However a sequence is cut into state maps, the same words start as in one pass by definition."""
    scanner = module.Scanner(["'s", "'re", "'ll"])
    rng = np.random.default_rng(3)
    for chunk in (1, 2, 7, 64):
        monkeypatch.setattr(module, "CHUNK", chunk)
        for n in (0, 1, 5, 200):
            classes = rng.integers(0, scanner.width, n).astype(np.uint8)
            state, want = 0, np.zeros(n + scanner.back, bool)
            for i, c in enumerate([*classes.tolist(), *[module.BLANK] * scanner.back]):
                at = state * scanner.width + c
                for back in range(scanner.back + 1):
                    if scanner.marks[at] >> back & 1:
                        want[i - back] = True
                state = int(scanner.next[at])
            assert scanner.starts(classes).tolist() == want[:n].tolist()


def test_query_and_odd_rows(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + ODD
    spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, n_tokens string, of int").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op12_token_counts"](spark, str(tmp_path)).collect()]
    want = [(i or -1, len((t or "").encode()), n, n > 2048) for (i, t), n in zip(rows, library([t for _, t in rows]))]
    assert sorted(got) == sorted(want)
    assert module.token_counts(docs.limit(0), PATH).count() == 0


def test_other_files_are_refused(tmp_path):
    content = json.load(open(PATH))
    content["model"]["end_of_word_suffix"] = None
    (tmp_path / "other.json").write_text(json.dumps(content))
    with pytest.raises(ValueError):
        module.Compiled(str(tmp_path / "other.json"))
