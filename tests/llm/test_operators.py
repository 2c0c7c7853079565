"""The training-data operators against brute force, round trips and held-out labels."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from broadsheet.llm import common, counting, decontaminate, jaccard, langid, licenses, lm, packing, reputation, spotjoin, spotsigs, tool_calls, toxicity, vocabularies
from broadsheet.llm.queries import PHRASES, QUERIES, URL_RULES
from broadsheet.llm.reputation import judge_urls

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 20_000

#: nulls, empty, blank, very long, repeated rows, a repeated id, clashing column `score`
ODD = [(1, None, None, None, None, 0.5), (2, "", "en", "s", 0, 0.5), (3, " \n\t ", "en", "s", 4, None), (4, LONG, "en", "s", 1, 0.1),
       (5, "The same text of it.", "en", "s", 1, 0.1), (5, "The same text of it.", "en", "s", 1, 0.1), (6, "The same text of it.", "de", None, 1, 0.1),
       (7, "12 34 !", None, "s", 1, 0.1), (8, "日本語 \U0001f389 é", "fr", "s", 1, 0.1)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def test_language_is_found_on_held_out_documents(spark, docs, odd, none):
    got = QUERIES["op1_language_id"](spark, FOLDER).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got) > 0
    model = langid.fit(docs, public_tokenizers.path("piece_bpe_32k.model"))
    rated = {r.doc_id: r for r in langid.predict(odd, model).collect()}
    assert [rated[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and rated[8].lang_pred != "und"
    assert langid.predict(none, model).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(none, model.vocabulary)).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces, listed = langid.Pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    p = np.random.default_rng(0).random((len(listed), 2))
    words = [b"the", b"\xc3\xa9t", b"a"]
    number = {x: i for i, x in enumerate(listed)}
    got = langid.Words(words, pieces).likelihood(p)
    for word, row in zip(words, got):
        whole, total = b" " + word, np.zeros(2)
        for cuts in itertools.product([0, 1], repeat=len(whole) - 1):
            ends = [i + 1 for i, c in enumerate(cuts) if c] + [len(whole)]
            parts = [whole[a:b] for a, b in zip([0, *ends], ends)]
            if all(x in number for x in parts):
                total += np.prod([p[number[x]] for x in parts], axis=0)
        assert np.allclose(row, np.log(total))


def test_long_words_are_cut_between_characters(spark):
    for word in ("é" * 100, "日本語" * 50, "a" * 100, "\U0001f389" * 33, "ab"):
        cut = langid.parts(word.encode())
        assert b"".join(cut) == word.encode() and all(len(x) <= langid.WORD and x.decode() for x in cut)
    model = langid.fit(spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("the of and", "en"), ("der und die", "de")] * 9)],
                                             "doc_id long, text string, lang string"), public_tokenizers.path("piece_bpe_32k.model"))
    frame = spark.createDataFrame([(1, "the and of the", 5, "x")], "doc_id long, text string, best int, has_letter string")
    row, = langid.predict(frame, model, ["doc_id", "best", "has_letter"]).collect()
    assert (row.doc_id, row.best, row.has_letter, row.lang_pred) == (1, 5, "x", "en")


def test_toxic_documents_are_found_and_located(spark, odd, none):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(400):
        sentences = [" ".join(rng.choices(words, k=6)) for _ in range(5)]
        if i % 4 == 0:
            sentences[i % 5] += f" nastyx{i % 7}"
        rows.append((i, ". ".join(sentences), i % 4 == 0))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic boolean")
    model = toxicity.fit(frame.where("doc_id < 300"), frame.selectExpr("doc_id", "int(toxic) toxic"))
    for r in toxicity.score(frame.where("doc_id >= 300"), model, ["doc_id", "text", "toxic"]).collect():
        assert (r.score >= 0.3) == r.toxic
        assert not r.toxic or any("nasty" in r.text[s.start : s.start + s.length] for s in r.offending)
    rated = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert rated[1] == rated[2] == rated[3] == 0
    assert toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, frame.selectExpr("doc_id", "int(toxic) toxic")).bias < -20


def test_tool_calls_orders_links_and_flags(spark):
    tools = {"t": {"q": ("string", True), "n": ("integer", False)}}
    calls = spark.createDataFrame(
        [(1, "a", 0, "t", '{"q":"x","n": 3}', ["b"]), (1, "b", 1, "t", '{"n":"3"}', ["c"]), (1, "c", 2, "t", '{"q":"y"}', None),
         (1, "c", 5, "t", "{}", None), (1, "d", 3, "t", "{bad", ["zz"]), (2, "x", 0, "t", "{}", ["y"]), (2, "y", 1, "u", "{}", ["x"]),
         (None, "k", 0, "t", "{}", None)],
        "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>")
    results = spark.createDataFrame([(1, "a", 3, "r"), (1, "a", 4, "s"), (1, "q", 4, None)], "conv_id long, call_id string, seq long, content string")
    got = {(r.conv_id, r.call_id): r for r in tool_calls.link_tool_calls(calls, results, tools).collect()}
    assert [k for k, r in sorted(got.items(), key=lambda kr: kr[1].position if kr[1].position is not None else 99) if k[0] == 1][:4] == [
        (1, "c"), (1, "b"), (1, "a"), (1, "d")]
    assert got[1, "a"].record == '{"arguments":{"n":3,"q":"x"},"id":"a","name":"t","result":"r"}' and got[1, "a"].status == "ok"
    assert got[1, "a"].n_results == 2 and got[1, "c"].n_calls == 2 and got[1, "c"].status == "unanswered"
    assert got[1, "b"].errors == "missing:q,type:n" and got[1, "d"].status == "malformed" and got[1, "d"].missing == 1
    assert got[2, "x"].status == got[2, "y"].status == "cycle"
    assert got[1, "q"].status == "orphan" and got[None, "k"].status == "no_id"
    assert tool_calls.link_tool_calls(calls.limit(0), results.limit(0), tools).count() == 0


def check_packing(rows, texts):
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_window = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_window[r.sequence_id].append(r)
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        ids = np.array([*encoder.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    return by_window


def test_packing_keeps_every_id_and_pads_little(docs, texts, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    windows = check_packing(packing.pack(docs.coalesce(1), path).collect(), texts)
    assert sum(sum(r.length for r in w) < 2048 for w in windows.values()) <= 1
    check_packing(packing.pack(odd.dropDuplicates(["doc_id"]), path).collect(), {r[0]: r[1] for r in ODD})
    assert packing.pack(none, path).count() == 0


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = ["".join(rng.choice("ab'1 \n\t é 日!\x85\x1c\r🎉") for _ in range(40)) for _ in range(2000)] + ["a<|endoftext|>b", " " * 3000]
    want = tokenizer.encode_batch(texts, add_special_tokens=False)
    assert all(a.tolist() == b.ids for a, b in zip(vocabularies.byte_level(path).encode(texts), want))


def test_level_minimises_the_sum_of_squares():
    rng = random.Random(2)
    packer = packing.Packer(16)
    for n in range(300):
        size = rng.randint(1, 15)
        def cost(h):
            c = packer.count.copy()
            c[h] -= h > 0
            if h + size < 16:
                c[h + size] += 1
            return int((c[1:16] ** 2).sum())
        allowed = [0, *[h for h in range(1, 17 - size) if packer.count[h]]]
        assert cost(packer.level(size)) == min(map(cost, allowed))
        packer.place((n, 0, np.zeros(size, np.int32), size))


def test_backoff_scores_equal_counts_of_the_other_documents(docs, texts, odd, none):
    words = {i: spaced(t) for i, t in texts.items()}
    one, two = collections.Counter(), collections.Counter()
    for w in words.values():
        one.update(w)
        two.update(zip(w, w[1:]))
    for r in lm.stupid_backoff(docs).collect():
        w = words[r.doc_id]
        mine, mine2, total = collections.Counter(w), collections.Counter(zip(w, w[1:])), 0.0
        for i, x in enumerate(w):
            pair = (w[i - 1], x)
            seen = two[pair] - mine2[pair] if i else 0
            alone = max(one[x] - mine[x], 1) / (sum(one.values()) - len(w))
            total += np.log(seen / (one[pair[0]] - mine[pair[0]]) if seen else (0.4 if i else 1) * alone)
        assert r.n_words == len(w) and r.log_score == pytest.approx(total)
    rated = {r.doc_id: r for r in lm.stupid_backoff(odd).collect()}
    assert rated[1].n_words == 0 and rated[1].mean_log_score is None and rated[4].n_words == 20_000
    assert lm.stupid_backoff(none).count() == 0


@pytest.mark.parametrize("order", [3, 4])
def test_backoff_of_higher_orders_equals_counts(spark, docs, texts, order):
    words = {i: spaced(t) for i, t in texts.items()}
    grams = lambda w: collections.Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1))
    everywhere, size = sum(map(grams, words.values()), collections.Counter()), sum(map(len, words.values()))
    for r in (lm.stupid_backoff(docs, order) if order > 3 else QUERIES["op5_stupid_backoff"](spark, FOLDER)).collect():
        w, mine, total, lower = words[r.doc_id], grams(words[r.doc_id]), 0.0, 0
        seen = lambda g: everywhere[g] - mine[g]  # noqa: B023, E731
        for i in range(len(w)):
            k, steps = min(i + 1, order), 0
            while k > 1 and not seen(tuple(w[i - k + 1 : i + 1])):
                k, steps = k - 1, steps + 1
            share = seen(tuple(w[i - k + 1 : i + 1])) / seen(tuple(w[i - k + 1 : i])) if k > 1 else max(seen((w[i],)), 1) / (size - len(w))
            total, lower = total + np.log(0.4**steps * share), lower + (i >= order - 1 and steps > 0)
        assert (r.n_words, r.n_backoff) == (len(w), lower) and r.log_score == pytest.approx(total)


def test_totals_go_beyond_32_bits(spark):
    keys = np.array([0, 5 << 60, 15 << 60], np.uint64)
    counts = {0: [3 << 30, 1, 7], 1: [3 << 30, 2, (1 << 32) - 1], 2: [1, 3, (1 << 32) - 1]}
    plan = counting.Layout(3, 2, 6)
    chunked = spark.createDataFrame([(c,) for c in counts], "chunk int")
    replies = counting.totals(chunked, lambda chunk: (keys, np.array(counts[chunk["chunk"][0].as_py()])), plan)
    use = lambda chunk, total: pa.table({"chunk": chunk["chunk"], "totals": pa.array([total.tolist()])})
    got = counting.with_totals(chunked, replies, use, "chunk int, totals array<long>").collect()
    assert len(got) == 3 and all(r.totals == [(6 << 30) + 1, 6, (1 << 33) + 5] for r in got)


def test_fingerprints_and_edited_texts(docs, texts, odd, none):
    got = {r.doc_id: r for r in spotsigs.neighbour_fingerprints(docs).collect()}
    ids = sorted(texts)
    for i, j in zip(ids, [*ids[1:], ids[0]]):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[j][:half]
        mine, other = (spotsigs.decode(got[k].fingerprint) for k in (i, j))
        assert got[i].n_chars == len(texts[i]) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_next == pytest.approx(len(set(mine) & set(other)) / max(len(set(mine) | set(other)), 1))
        assert set(mine) == set(next(spotsigs.signature_sets(pa.array([texts[i]]))))
    assert len({got[i].fingerprint for i in ids}) <= len(set(texts.values()))
    assert spotsigs.neighbour_fingerprints(odd).count() == len(ODD)
    assert spotsigs.neighbour_fingerprints(none).count() == 0


def plain_signatures(text):
    """Spot signatures as tuples of words: an anchor, or the beginning, and the content words that follow."""
    words, anchors = alnum(text), set(spotsigs.ANCHORS.split())
    content = lambda i: tuple([w for w in words[i:] if w not in anchors][: spotsigs.CHAIN])
    found = {(w, *content(i + 1)) for i, w in enumerate(words) if w in anchors}
    return found | {(None, *content(0))} if words else set()


def test_neighbours_equal_plain_signatures(spark, texts):
    rows = [(i, t[:2000]) for i, t in list(texts.items())[:60]] + [(9000, None), (9001, ""), (9002, "!"), (9003, "the"), (9004, "é日\U0001f389 the of a b c"), (9005, "the the x")]
    frame = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, place int, tie string")
    got = {r.doc_id: r for r in spotsigs.neighbour_fingerprints(frame).collect()}
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(not a and not b)
    ordered = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, after) in zip(ordered, [*ordered[1:], ordered[0]]):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i].n_signatures == len(plain_signatures(t)) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i].near_next == pytest.approx(like(plain_signatures(t), plain_signatures(after)))
        assert got[i].near_edited == pytest.approx(like(plain_signatures(t), plain_signatures(edited)))
        assert len(spotsigs.decode(got[i].edited_fingerprint)) == len(plain_signatures(edited))


def test_neighbours_of_null_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 64)  # so that there are many ranges
    rows = [(None, f"null {i} text") for i in range(40)] + [(i // 2, f"of the row {i}") for i in range(60)]
    got = spotsigs.neighbour_fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), spotjoin.place_classes(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    edited = collections.Counter(r.edited_sha256 for r in got)
    sha = lambda a, b: hashlib.sha256((a[: len(a) - len(a) // 2] + b[: len(a) // 2]).encode()).hexdigest()
    place = dict(zip(range(len(rows)), [r.t for r in spark.createDataFrame(rows, "d long, x string").selectExpr("xxhash64(x) t").collect()]))
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] if rows[k][0] is not None else place[k], place[k]))
    assert edited == collections.Counter(sha(rows[a][1], rows[b][1]) for a, b in zip(order, [*order[1:], order[0]]))
    assert all(r.class_id is not None or r.doc_id is None for r in got)


def test_reordered_items_are_found_and_clean_documents_left_alone(spark, odd, none):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=30))) for i in range(20)] + [(99, None), (98, "two words")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(20):
        w = items[i][1].split()
        noise = [" ".join(rng.choices(vocabulary, k=40)) for _ in range(2)]
        rows.append((i, f"{noise[0]} {' '.join(w[15:])}, X. {' '.join(w[:15])} {noise[1]}"))
        rows.append((100 + i, " ".join(noise)))
    got = {r.doc_id: r for r in decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), benchmark).collect()}
    for i in range(20):
        assert got[i].contaminated and got[i].item_id == i and got[i].coverage == 1 and got[i].n_tiles == 2
        assert not got[100 + i].contaminated
    assert not any(r.contaminated for r in decontaminate.contamination(odd, benchmark).collect())
    assert decontaminate.contamination(none, benchmark).count() == 0
    assert decontaminate.drop_contaminated(odd, benchmark.limit(0)).count() == len(ODD)


def test_null_ids_keep_their_findings(spark):
    item = " ".join(f"v{i}" for i in range(30))
    benchmark = spark.createDataFrame([(3, item)], "item_id long, text string")
    rows = [(7, item), (None, item), (None, "nothing here"), (None, f"It is released under the MIT License. {item}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r.doc_id, r.contaminated, r.item_id) for r in decontaminate.contamination(frame, benchmark).collect())
    assert got == collections.Counter({(7, True, 3): 1, (None, True, 3): 2, (None, False, None): 1})
    rated = collections.Counter((r.labels, r.score) for r in licenses.scan(frame, PHRASES).collect())
    assert rated == collections.Counter({("", 0.0): 3, ("mit", 1.0): 1})


def test_license_places_equal_brute_force(docs, odd, none, spark):
    extra = [(10**6, "x UNDER the MIT-license, under the mit license. CC BY-NC 4.0!", "en", "s", 1),
             (10**6 + 1, "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated "
                         "documentation files, to deal in the Software without restriction", "en", "s", 1)]
    every = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    texts = {r.doc_id: r.text for r in every.collect()}
    for r in licenses.scan(every, PHRASES).collect():
        words, places, labels = alnum(texts[r.doc_id]), [], set()
        for phrase, label in PHRASES:
            p = alnum(phrase)
            found = [i for i in range(len(words)) if words[i : i + len(p)] == p]
            places += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted(labels)))
        assert (r.first_word, r.last_word) == ((min(places), max(places)) if places else (None, None))
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        if r.doc_id == 10**6 + 1:
            assert r.labels == "mit" and r.score > 0.6
    assert licenses.scan(odd, PHRASES).count() == len(ODD) and licenses.scan(none, PHRASES).count() == 0


def classes(sets, num, den):
    """Components by comparing all pairs."""
    root = {i: i for i in sets}
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for a, b in itertools.combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and den * shared >= num * len(sets[a] | sets[b]) and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def gram_set(text, width):
    w = spaced(text)
    return frozenset(zip(*(w[k:] for k in range(width)))) if len(w) >= width else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("width,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_classes_equal_all_pairs(spark, width, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 7)  # so that groups are split
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 30)) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(120):
        w = list(base[i % 4])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(60)] = f"new{rng.randint(0, 3)}"
        rows.append((i, " ".join(w[: rng.choice([60, 59, 57])])))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (204, "a b"), (0, rows[0][1]), (None, rows[0][1])]
    want = classes({i: gram_set(t, width) for i, t in rows if i is not None}, num, den)
    for r in jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den).collect():
        if r.doc_id is not None:
            assert r.component_id == want[r.doc_id] and r.n_shingles == len(gram_set(dict(rows)[r.doc_id], width))


def test_jaccard_odd_rows(odd, none):
    got = collections.Counter((r.doc_id, r.component_id) for r in jaccard.jaccard_classes(odd).collect())
    assert got == collections.Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 5): 2, (6, 5): 1, (7, 7): 1, (8, 8): 1})
    assert jaccard.jaccard_classes(none).count() == 0


def test_jaccard_links_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(100)]
    x, near = " ".join(words), " ".join([*words, "more"])
    y = " ".join(f"y{i}" for i in range(100))
    rows = [(5, x, "a"), (5, y, "b"), (9, y + " one", "c"), (None, near, "d"), (None, "null near " + x, "e"), (None, "z " * 3, "f"), (None, "z " * 3, "g"), (5, x, "h"), (None, None, "i")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, component string")
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_classes(frame, 3, 9, 10).collect())
    assert got == collections.Counter({(5, 98, 5): 3, (9, 99, 5): 1, (None, 99, 5): 1, (None, 100, 5): 1, (None, 1, None): 2, (None, 0, None): 1})
    kept = jaccard.one_of_each(frame, 3, 9, 10).collect()
    assert collections.Counter(r.text for r in kept)[None] == 1 and len(kept) == 4 and {r.doc_id for r in kept} == {5, None}
    assert sorted(r.text for r in kept if r.doc_id == 5) == sorted([x, y])


def test_spot_classes_equal_all_pairs(spark, docs, texts, odd, none, monkeypatch):
    monkeypatch.setattr(spotjoin, "BLOCK", 7)  # so that groups are split
    monkeypatch.setattr(spotjoin, "STRIP", 3)
    rng = random.Random(6)
    base = [[w for k in range(40) for w in ("the", f"{rng.choice('abcdefgh')}{k}", f"x{k}")] for _ in range(3)]
    rows = []
    for i in range(90):
        w = list(base[i % 3])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 3)}"
        rows.append((i, " ".join(w[: rng.choice([120, 117, 99])])))
    rows += [(200, None), (201, ""), (202, "one"), (203, "ONE"), (0, rows[0][1]), (None, rows[0][1])]
    planted = spark.createDataFrame(rows, "doc_id long, text string")
    for table, found in ((planted, {i: t or "" for i, t in rows if i is not None}), (docs, texts)):
        sets = {i: set(s.tolist()) for i, s in zip(found, spotsigs.signature_sets(pa.array(list(found.values()), pa.string())))}
        want = classes(sets, 4, 5)
        got = spotjoin.spot_classes(table).collect()
        assert len(got) == table.count() and len(set(want.values())) < len(want)
        for r in got:
            if r.doc_id is not None:
                assert (r.class_id, r.n_signatures) == (want[r.doc_id], len(sets[r.doc_id]))
    assert spotjoin.spot_classes(odd).count() == len(ODD)
    assert spotjoin.spot_classes(none).count() == 0
    assert spotjoin.spanning_links([np.arange(10), np.arange(8), np.arange(20, 30)], 4, 5) == [(1, 0)]


def test_spot_query_names_classes_beyond_neighbours(spark, texts, tmp_path):
    base = texts[min(t for t in texts if len(texts[t]) > 400)]
    rows = [(0, base), (50, "another thing of the river bank"), (51, base + " zebra quartz"), (70, None), (80, ""), (None, base), (50, base)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.n_signatures > 0) for r in QUERIES["op6_spot_signatures"](spark, str(tmp_path)).collect())
    assert got == [(-1, 0, True), (0, 0, True), (50, 0, True), (50, 50, True), (51, 0, True), (70, 70, False), (80, 80, False)]


def test_url_rules_and_odd_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://a.example.com/en/1"), (3, "http://example.com"), (4, "x://net/es/1#f"), (5, None), (6, "no scheme")]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), F.lit(None).cast("int"), URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block") and got[3].rule is None and got[4].rule == "net/es/"
    assert got[5].host == got[6].host == got[5].path == "" and got[5].verdict == "block"


def test_registered_domains_under_two_label_suffixes(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "taco.uk": ("uk", "taco.uk"),
             "x.taco.uk": ("uk", "taco.uk"), "x.com": ("com", "x.com"), "m.x.com": ("com", "x.com"), "localhost": ("localhost", "localhost"), "": ("", "")}
    suffix, domain = reputation.suffix_and_domain(F.col("host"), reputation.TWO_LABEL_SUFFIXES)
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select("host", suffix.alias("s"), domain.alias("d")).collect()
    assert {r.host: (r.s, r.d) for r in got} == hosts
    pages = spark.createDataFrame([], "page_id long, url string, n int, host string")
    assert judge_urls(pages, F.lit(1), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        reputation.suffix_and_domain(F.col("host"), ("x.y",) * 1001)


def greedy_tiles(at, item_at, k):
    """Longest match of free words first, of equals the first in the item, then in the document."""
    seeds = set(zip(at, item_at))
    linked = {(p + j, t + j) for p, t in seeds for j in range(k)}  # words matched inside a seed
    used, used_item, tiles = set(), set(), []
    while True:
        best = None
        for p, t in linked:
            n = 0
            while (p + n, t + n) in linked and p + n not in used and t + n not in used_item and (n < k or (p + n - k + 1, t + n - k + 1) in seeds):
                n += 1
            if n >= k and (p, t) in seeds and (best is None or (-n, t, p) < best):
                best = (-n, t, p)
        if best is None:
            return tiles
        n, t, p = -best[0], best[1], best[2]
        used |= set(range(p, p + n))
        used_item |= set(range(t, t + n))
        tiles.append((p, t, n))


def test_tiles_equal_a_plain_greedy_search():
    rng = random.Random(11)
    for _ in range(300):
        letters = rng.choice([2, 3, 8])
        item = [rng.randrange(letters) for _ in range(rng.randint(4, 18))]
        doc = [rng.randrange(letters) for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(item))
            doc += item[i : i + rng.randint(1, 12)] + [rng.randrange(letters) for _ in range(rng.randint(0, 3))]
        k = decontaminate.K
        seeds = [(p, t) for p in range(len(doc) - k + 1) for t in range(len(item) - k + 1) if doc[p : p + k] == item[t : t + k]]
        if seeds:
            at, item_at = map(np.array, zip(*seeds))
            assert decontaminate.tile(at, item_at, len(item)) == greedy_tiles(at.tolist(), item_at.tolist(), k)


def test_noisy_or_scores_equal_a_plain_product(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(30)]
    texts = [". ".join(" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(rng.randint(1, 6))) for _ in range(80)] + ["", "!!!"]
    block = next(toxicity.blocks(pa.array([" ".join(words)]), toxicity.ALNUM))
    keys = np.unique(toxicity.features(block)[0])
    weights = np.array([rng.uniform(-1, 3) for _ in keys])
    model = toxicity.Model(keys, weights, -2.0)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in toxicity.score(frame, model, least=0.0).collect()}
    for i, text in enumerate(texts):
        clean, found = 1.0, 0
        for sentence in text.split(". "):
            for b in toxicity.blocks(pa.array([sentence]), toxicity.ALNUM):
                if len(b.starts):
                    kept = np.unique(model.known(b)[0])
                    clean *= 1 - 1 / (1 + np.exp(-(model.bias + weights[kept].sum())))
                    found += 1
        assert got[i].score == pytest.approx(1 - clean) and len(got[i].offending) == found
        for s in got[i].offending:
            assert text[s.start : s.start + s.length].strip(" .").count(".") == 0


def test_reversed_chains_and_long_arguments(spark):
    n, long = 30, "x" * 100_000
    calls = [(1, f"c{i}", i, "t", '{"q":"%s"}' % (long if i == 3 else i), [f"c{i + 1}"] if i < n - 1 else None, "k", 0) for i in range(n)]
    frame = spark.createDataFrame(calls, "conv_id long, call_id string, seq long, name string, arguments string, depends_on array<string>, content string, position int")
    results = spark.createDataFrame([(1, "c3", 99, long, "k")], "conv_id long, call_id string, seq long, content string, name string")
    got = sorted(tool_calls.link_tool_calls(frame, results, {"t": {"q": ("string", True)}}).collect(), key=lambda r: r.position)
    assert [r.call_id for r in got] == [f"c{i}" for i in range(n - 1, -1, -1)] and len(got[n - 4].record) > 200_000


def plain_keys(calls):
    """Keys and cyclic calls by plain search; calls: id -> (seq, needs)."""
    needs = {c: [n for n in wanted if n in calls] for c, (_, wanted) in calls.items()}
    settled = set()
    while more := {c for c in calls if c not in settled and settled.issuperset(needs[c])}:
        settled |= more
    keys = {c: (calls[c][0], 0) for c in calls}
    for _ in calls:
        for c in settled:
            for n in needs[c]:
                if keys[c] <= keys[n]:
                    keys[c] = (keys[n][0], keys[n][1] + 1)
    return keys, set(calls) - settled


def test_order_against_plain_search(spark, monkeypatch):
    rng = random.Random(5)
    talks = {1: {f"c{i}": (i, [f"c{(i + 1) % 40}"]) for i in range(40)},  # one cycle
             2: {f"c{i}": (i, [f"c{i + 1}"]) for i in range(60)},  # a reversed chain
             3: {f"c{i}": (i, ["c50"] if i < 50 else []) for i in range(51)}}  # all wait for one
    for conv in range(4, 30):
        n, loops = rng.randint(1, 14), conv % 3 == 0
        rank = rng.sample(range(n), n)
        talks[conv] = {f"c{i}": (rng.randrange(n) if conv % 2 else i, [f"c{j}" for j in range(n) if rng.random() < 0.25 and (loops or rank[j] < rank[i])])
                       for i in range(n)}
    calls = spark.createDataFrame([(t, c, seq, needs) for t, talk in talks.items() for c, (seq, needs) in talk.items()],
                                  "conv_id long, call_id string, seq long, depends_on array<string>")
    passes = []
    monkeypatch.setattr(tool_calls, "stored", lambda df, name: passes.append(name) or common.stored(df, name))
    keys = tool_calls.order_keys(calls)
    assert len(passes) < 60
    got = collections.defaultdict(dict)
    for r in tool_calls.numbered(keys, ["place", "step", "call_id"]).collect():
        got[r.conv_id][r.call_id] = r
    for t, talk in talks.items():
        want, cyclic = plain_keys(talk)
        assert {c for c, r in got[t].items() if r.cycle} == cyclic
        assert {c: (r.place, r.step) for c, r in got[t].items()} == want
        assert [got[t][c].position for c in sorted(talk, key=lambda c: (*want[c], c))] == list(range(len(talk)))


def test_pipeline_stages_take_odd_empty_and_clashing_rows(spark, odd, none):
    for frame in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, FOLDER)
            assert out.columns == frame.columns and collections.Counter(out.collect()) <= collections.Counter(frame.collect())
        assert corpus_pipeline.STAGES[-1][1](spark, frame, FOLDER).where("doc_id IS NULL OR length IS NULL").isEmpty()


def test_pipeline_stages_keep_columns_and_decide(spark, docs, texts):
    now, kept = docs, set(texts)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = spark.createDataFrame(stage(spark, now, FOLDER).collect(), docs.schema)
        ids = {r.doc_id for r in now.collect()}
        assert now.columns == docs.columns and ids <= kept
        if name == "n-gram Jaccard join":
            assert ids == {i for i, c in classes({i: gram_set(texts[i], 5) for i in kept}, 4, 5).items() if i == c}
        kept = ids
    check_packing(corpus_pipeline.STAGES[-1][1](spark, now, FOLDER).collect(), {i: texts[i] for i in kept})
