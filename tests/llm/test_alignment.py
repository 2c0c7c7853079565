"""Alignment of two tokenizers against a pair-by-pair search."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from broadsheet.llm import alignment
from broadsheet.llm.queries import QUERIES
from broadsheet.llm.vocabularies import byte_level, token_bytes

A, B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
LONG = "word, naïve 日本 \U0001f389 " * 3000
ODD = [(1, None), (2, ""), (3, " "), (4, "a  b\t\n c"), (5, LONG), (6, "x <|endoftext|> <s>y</s>"), (6, "x <|endoftext|> <s>y</s>"),
       (7, "under▁score"), (None, "no id"), (8, " lead and trail "), (9, "\x00\x7f"), (10, " " * 3000 + "x"), (11, "ﬁ ½ ​ é")]


def brute(rows):
    """The contract, link by link."""
    tokenizer = Tokenizer.from_file(A)
    tokenizer.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    vocabulary = {i: token_bytes(t) for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
    piece = lambda i: bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
    found, holders = [], collections.Counter()
    for doc_id, text in rows:
        links, groups, a, b = collections.Counter(), [], [], []
        if text:
            a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            b = model.encode(text)
            sa, sb = [vocabulary[i] for i in a], [piece(i) for i in b]
            if not b"".join(sa) == b"".join(sb) == (" " + text).encode():
                a, b, sa, sb = [], [], [], []
            ea, eb = np.cumsum([len(x) for x in sa]).tolist(), np.cumsum([len(x) for x in sb]).tolist()
            low = 0
            for i, x in enumerate(a):
                while low < len(b) and eb[low] <= ea[i] - len(sa[i]):
                    low += 1
                j = low
                while j < len(b) and eb[j] - len(sb[j]) < ea[i]:
                    links[x, b[j]] += 1
                    j += 1
            at = 0
            for end in sorted(set(ea) & set(eb)):
                groups.append(",".join(str(x) for x, e in zip(a, ea) if at < e <= end) + "|" + ",".join(str(x) for x, e in zip(b, eb) if at < e <= end) if len(a) < 3000 else "")
                at = end
        holders.update(links.keys())
        found.append((doc_id, len(a), len(b), len(groups), links, ";".join(groups)))
    best = collections.defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, text in found:
        sha = (hashlib.sha256(text.encode()).hexdigest() if text else "") if n_a < 3000 else None
        out.append((doc_id, n_a, n_b, n_groups, sum(links.values()), sum(n for p, n in links.items() if holders[p] == best[p[0]]),
                    sum(holders[p] * n for p, n in links.items()), sha))
    return out


def check(got, rows):
    got = sorted((r.doc_id or -1, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256 if r.n_a < 3000 else None) for r in got)
    want = sorted(((w[0] or -1), *w[1:]) for w in brute(rows))
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(w[-1] in (None, g[-1]) for g, w in zip(got, want))


def test_alignment_equals_pairwise_search(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + ODD
    spark.createDataFrame([(i, t, 7, "x") for i, t in rows], "doc_id long, text string, pair long, chunk string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    check(QUERIES["op13_token_alignment"](spark, str(tmp_path)).collect(), rows)


def test_chunks_blocks_and_lanes_do_not_matter(spark):
    rows = [(i, f"Some text of {i % 3} words, and mörè. " * (i % 5)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    tables = alignment.Bytes(byte_level(A, plain=True).tokens), alignment.Bytes(alignment.piece_bytes(B))
    assert alignment.link_counts(alignment.aligned(frame, A, B, 200, 400)).select("chunk").distinct().count() > 2
    check(alignment.corpus_alignment(frame, A, B, 200, 400).collect(), rows)
    texts = [t.encode() for t in (" a b c d", " efg h")]
    a = alignment.Side([x.astype(int) for x in byte_level(A, plain=True).encode([t.decode() for t in texts])], tables[0])
    assert alignment.same_bytes(a, texts).tolist() == [True, True] and alignment.same_bytes(a, texts[::-1]).tolist() == [False, False]
    for lane in (1, 2, 100):
        links = alignment.merge(a, a, lane)
        assert sorted(links[0].tolist()) == list(range(len(a.ids))) == sorted(links[3].tolist())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "  ")]])
def test_tables_without_tokens(spark, rows):
    got = alignment.corpus_alignment(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    assert len(got) == len(rows) and all((r.n_best, r.count_sum) == (0, 0) or r.n_a for r in got)


def test_byte_level_ids_equal_the_tokenizers():
    texts = ["a<|endoftext|>b", " " * 2500 + "x", "é 日本 12's!\n\n x", "", "　  y"]
    for plain in (False, True):
        tokenizer = Tokenizer.from_file(A)
        tokenizer.encode_special_tokens = plain
        for text, ids in zip(texts, byte_level(A, plain).encode(texts)):
            assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
