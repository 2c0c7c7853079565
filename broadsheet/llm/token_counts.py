"""Token counts by finite-state transducers compiled from a tokenizer file.

The file (BPE over words of letters, single digits, other characters and contractions;
lower case; word ends marked) is compiled into two deterministic transducers.

The scanner reads classes of characters and annotates its transitions with the word starts
they emit, at this character or, where a contraction fails, at an earlier one. Its states
are few, so the text is cut into chunks, each chunk becomes the map from every state before
it to the state after it, the maps are composed by a parallel prefix scan, and all chunks
then emit at once from their true states.

The counter reads the bytes of a word and annotates its transitions with the change in the
number of tokens. Its state tells, for each place from which a longer token may still come,
the node in the prefix tree of tokens, the last token before that place and the tokens
counted there. The last token of a prefix is the only token that ends it and may follow the
last token of what precedes it (two tokens may follow each other if merging their bytes
gives them again), so the machine is deterministic. Its states are built when first needed
and dropped when they are too many, which changes no result. A long word costs a step a byte.
Words seen lately are looked up by a 64-bit hash.

Characters are classed and normalised as the file's library does: each code point is put
to it once; code points that Python normalises otherwise send their text through the
library's normaliser.

Null and empty text: no tokens. A special token's string in a text is one token, as in the
library. Repeated rows are counted each. Empty tables give an empty result. Extra columns
are not returned.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from broadsheet.llm.bytewords import Block, powers, slices
from broadsheet.llm.common import ship_package
from broadsheet.llm.vocabularies import token_bytes

BLOCK_BYTES = 1 << 20  #: of text scanned at once; one document at least
CHUNK = 64  #: characters of one state map
STATES = 150_000  #: of the counter, kept at most
WORDS = 1_000_000  #: counts looked up by hash, kept at most

BLANK, LETTER, NUMBER, OTHER, UNKNOWN = 0, 1, 2, 3, 255
_RUNS = [r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"]  #: what follows the contractions in the file's pattern
_START, _LETTERS, _OTHERS = 0, 1, 2


class Scanner:
    """Words as a transducer over classes; `contractions` are an apostrophe and letters."""

    def __init__(self, contractions: list[str]):
        self.classes = {c: OTHER + 1 + i for i, c in enumerate(sorted({c for x in contractions for c in x}))}
        prefixes = sorted({x[:k] for x in contractions for k in range(1, len(x))}, key=len)
        if any(x in contractions for x in prefixes) or {x[0] for x in contractions} != {"'"}:
            raise ValueError("contractions are expected to begin with an apostrophe and not with each other")
        state = {p: _OTHERS + 1 + i for i, p in enumerate(prefixes)}
        self.states, width = len(prefixes) + 3, OTHER + 1 + len(self.classes)
        self.width = width
        letters = {LETTER, *(i for c, i in self.classes.items() if c != "'")}

        def fresh(c: int) -> tuple[int, int]:
            if c == BLANK:
                return _START, 0
            return (_LETTERS if c in letters else _START if c == NUMBER else state["'"] if c == self.classes["'"] else _OTHERS), 1

        def plain(s: int, c: int) -> tuple[int, int]:
            stays = c in letters if s == _LETTERS else s == _OTHERS and c in (OTHER, self.classes["'"])
            return (s, 0) if stays else fresh(c)

        def step(s: int, c: int) -> tuple[int, int]:
            if s <= _OTHERS:
                return plain(s, c)
            prefix = prefixes[s - _OTHERS - 1]
            for x, i in self.classes.items():
                if i == c and prefix + x in contractions:
                    return _START, 0
                if i == c and prefix + x in state:
                    return state[prefix + x], 0
            s, marks = _OTHERS, 0  # no contraction: the apostrophe stands alone and its letters start a word
            for back, x in zip(range(len(prefix) - 1, -1, -1), [*(self.classes[x] for x in prefix[1:]), c]):
                s, mark = plain(s, x)
                marks |= mark << back
            return s, marks

        self.back = max(map(len, prefixes))  #: characters that a start may lie behind
        table = [step(s, c) for s in range(self.states) for c in range(width)]
        self.next = np.array([s for s, _ in table], np.uint8)
        self.marks = np.array([m for _, m in table], np.uint8)

    def starts(self, classes: np.ndarray) -> np.ndarray:
        """Where words start in a sequence of classes; what precedes and follows counts as blank."""
        n = len(classes)
        chunks = -(-(n + self.back) // CHUNK)
        padded = np.zeros(chunks * CHUNK, np.uint8)
        padded[:n] = classes
        steps = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
        maps = np.repeat(np.arange(self.states, dtype=np.intp)[:, None], chunks, axis=1)
        for column in steps:
            maps = self.next.take(maps * self.width + column).astype(np.intp)
        apart = 1
        while apart < chunks:  # prefix scan: after it a map leads from the very beginning
            later = np.take_along_axis(maps[:, apart:], maps[:, :-apart], axis=0)
            maps = np.concatenate([maps[:, :apart], later], axis=1)
            apart *= 2
        state = np.concatenate([[_START], maps[_START, :-1]])
        marks = np.empty_like(steps)
        for row, column in zip(marks, steps):
            at = state * self.width + column
            row[:] = self.marks.take(at)
            state = self.next.take(at).astype(np.intp)
        flat = np.ascontiguousarray(marks.T).reshape(-1)
        found = (flat & 1).astype(bool)
        for back in range(1, self.back + 1):
            found[:-back] |= (flat[back:] >> back & 1).astype(bool)
        return found[:n]


class Counter:
    """Tokens of a word by BPE with marked word ends; symbols are bytes, 256 more at the end."""

    def __init__(self, vocabulary: dict[str, int], merges: list[list[str]], suffix: str):
        def symbols(entry: str) -> tuple[int, ...]:
            whole = token_bytes(entry.removesuffix(suffix))
            return (*whole[:-1], whole[-1] + 256) if entry.endswith(suffix) else tuple(whole)

        spelled = {i: symbols(entry) for entry, i in vocabulary.items()}
        self.spelled = spelled
        self.single = {s[0]: i for i, s in spelled.items() if len(s) == 1}
        self.rank = {(vocabulary[a], vocabulary[b]): (n, vocabulary[a + b]) for n, (a, b) in enumerate(merges)}
        self.child: dict[int, int] = {}  #: node * 512 + symbol -> node
        self.token: dict[int, int] = {}  #: node -> token that ends there
        self.inner = {0}  #: nodes with children
        for i, s in spelled.items():
            node = 0
            for x in s:
                self.inner.add(node)
                node = self.child.setdefault(node * 512 + x, len(self.child) + 1)
            self.token[node] = i
        self.clear()

    def clear(self) -> None:
        self.state_of = {((0, -1, 0),): 0}
        self.places = [((0, -1, 0),)]
        self.arcs: dict[int, int] = {}  #: state * 512 + symbol -> state after * 256 + 128 + tokens more
        self.follows: dict[tuple[int, int], bool] = {}

    def merged(self, tokens: list[int]) -> list[int]:
        """BPE by its definition: the leftmost pair of least rank is merged until there is none."""
        while True:
            ranked = [(self.rank[p], k) for k, p in enumerate(zip(tokens, tokens[1:])) if p in self.rank]
            if not ranked:
                return tokens
            (_, to), k = min(ranked)
            tokens = [*tokens[:k], to, *tokens[k + 2 :]]

    def may_follow(self, last: int, token: int) -> bool:
        if (last, token) not in self.follows:
            pair = [token] if last < 0 else [last, token]
            self.follows[last, token] = self.merged([self.single[x] for t in pair for x in self.spelled[t]]) == pair
        return self.follows[last, token]

    def arc(self, state: int, symbol: int) -> int:
        places, ended = [], None
        for node, last, counted in self.places[state]:
            child = self.child.get(node * 512 + symbol)
            if child is None:
                continue
            if child in self.inner:
                places.append((child, last, counted))
            if child in self.token and self.may_follow(last, self.token[child]):
                if ended is not None:
                    raise ValueError("two tokens end a word's prefix")
                ended = (self.token[child], counted + 1)
        token, more = ended
        key = (*((node, last, counted - more) for node, last, counted in places), (0, token, 0))
        after = self.state_of.setdefault(key, len(self.places))
        if after == len(self.places):
            self.places.append(key)
        found = self.arcs[state * 512 + symbol] = after * 256 + 128 + more
        return found

    def count(self, word: bytes) -> int:
        if len(self.places) > STATES:
            self.clear()
        arcs, state, total = self.arcs, 0, 0
        for x in word[:-1]:
            arc = arcs.get(state * 512 + x) or self.arc(state, x)
            state = arc >> 8
            total += (arc & 255) - 128
        x = word[-1] + 256
        return total + ((arcs.get(state * 512 + x) or self.arc(state, x)) & 255) - 128


class Compiled:
    """Both transducers of a file, and what has been learned about characters and words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model, (split, bytes_) = content["model"], content["pre_tokenizer"]["pretokenizers"]
        names = [n["type"] for n in content["normalizer"]["normalizers"]]
        pattern = split["pattern"]["Regex"].split("|")
        special = content["added_tokens"]
        plain = not any(t[k] for t in special for k in ("single_word", "lstrip", "rstrip", "normalized"))
        known = (names == ["NFC", "Replace", "Lowercase"], pattern[-3:] == _RUNS, split["behavior"] == "Removed" and split["invert"], plain,
                 bytes_["type"] == "ByteLevel" and not bytes_["add_prefix_space"] and not bytes_["use_regex"], model["end_of_word_suffix"])
        if not all(known):
            raise ValueError("not a file of words with marked ends")
        self.special = re.compile("|".join(sorted((re.escape(t["content"]) for t in special), key=len, reverse=True)) or "(?!)")
        self.scanner = Scanner(pattern[:-3])
        self.counter = Counter(model["vocab"], model["merges"], model["end_of_word_suffix"])
        self.class_of = np.full(0x110000, UNKNOWN, np.uint8)
        for c, i in self.scanner.classes.items():
            self.class_of[ord(c)] = i
        self.same = np.zeros(0x110000, np.int8)  #: 1 if Python normalises a code point as the library does, -1 if not
        self.same[:128] = 1
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def classes(self, points: np.ndarray) -> np.ndarray:
        found = self.class_of[points]
        if (found == UNKNOWN).any():
            words = self.library.pre_tokenizer.pre_tokenize_str
            for c in np.unique(points[found == UNKNOWN]).tolist():
                twice = len(words(chr(c) * 2))
                self.class_of[c] = BLANK if not twice else NUMBER if twice == 2 else LETTER if len(words("a" + chr(c))) == 1 else OTHER
            found = self.class_of[points]
        return found

    def normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        points = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not self.same[points].all():
            for c in np.unique(points[self.same[points] == 0]).tolist():
                by_library = self.library.normalizer.normalize_str(chr(c))
                same = by_library in (_normal(chr(c)), " ") and unicodedata.category(chr(c)) != "Cn"
                self.same[c] = 1 if same else -1
        return self.library.normalizer.normalize_str(text) if (self.same[points] < 0).any() else _normal(text)

    def words(self, texts: list[str]) -> tuple[Block, np.ndarray]:
        """Normalised texts, a line feed behind each, with their words; (block, word offset of each text and the end)."""
        normal = [self.normal(t) + "\n" for t in texts]
        joined = "".join(normal)
        raw = np.frombuffer(joined.encode(), np.uint8)
        points = raw if joined.isascii() else np.frombuffer(joined.encode("utf-32-le"), "<u4")
        classes = self.classes(points)
        starts = self.scanner.starts(classes)
        edges = np.append(np.flatnonzero(starts | (classes == BLANK)), len(points))
        first = np.flatnonzero(starts[edges[:-1]])
        begin, end = edges[first], edges[first + 1]
        of = np.searchsorted(begin, np.cumsum([0, *map(len, normal)]))
        if points is not raw:
            upto = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))])
            begin, end = upto[begin], upto[end]
        running = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw) + 1)[0][: len(raw)], out=running[1:])
        return Block(0, raw, np.array([0, len(raw)]), begin, end, of, running), of

    def tokens(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        special = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if "<" in text and (n := len(self.special.findall(text))):
                special[i], texts[i] = n, self.special.sub("\n", text)
        block, of = self.words(texts)
        keys, first, place = np.unique(block.hashes(), return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, keys)
        new = self.keys[np.minimum(at, len(self.keys) - 1)] != keys if len(self.keys) else np.ones(len(keys), bool)
        if len(self.keys) + np.count_nonzero(new) > WORDS:
            self.keys, self.counts, at, new = self.keys[:0], self.counts[:0], at * 0, np.ones(len(keys), bool)
        if new.any():
            raw = block.data.tobytes()
            spans = zip(block.starts[first[new]].tolist(), block.ends[first[new]].tolist())
            found = np.array([self.counter.count(raw[i:j]) for i, j in spans], np.int32)
            self.keys = np.insert(self.keys, at[new], keys[new])
            self.counts = np.insert(self.counts, at[new], found)
        counts = np.concatenate([[0], np.cumsum(self.counts[np.searchsorted(self.keys, keys)][place], dtype=np.int64)])
        return special + np.diff(counts[of])


def _normal(text: str) -> str:
    """NFC in lower case; a capital sigma becomes the same letter everywhere."""
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def compiled(path: str) -> Compiled:
    return Compiled(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and whether they are more than `limit`."""
    ship_package(docs.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).fill_null("")
            for first, last in slices(texts, BLOCK_BYTES):
                part = texts[first:last]
                tokens = compiled(tokenizer).tokens(part.to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": ids[first:last], "n_bytes": pc.binary_length(part).cast(pa.int64()),
                                                  "n_tokens": pa.array(tokens), "over_limit": pa.array(tokens > limit)})
        pa.default_memory_pool().release_unused()

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
