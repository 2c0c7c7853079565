"""Language ID by unigram pieces, summed over all segmentations.

Pieces are those of a fixed public vocabulary, taken as byte strings (its 256 byte pieces
make every text segmentable). A language gives each piece a probability; a word's
probability is the sum over all ways to cut it into pieces, by a forward pass over its
bytes; a text's is the product over its words. A word is taken for a foreign one with
probability FOREIGN, which bounds what a single word can say, so a passage in another
language does not outweigh the rest. Words of more than WORD bytes, as in scripts without
spaces, are scored in parts of whole characters with at most so many bytes, each like a word;
pieces that fit into no part are not used. The score is the posterior of the best language under
equal priors.

Probabilities are learned by expectation maximisation from the words of labelled rows:
Spark counts words per language over about `train_docs` documents of each language (chosen
by a hash of their id; all if there are fewer), and the passes run over those counts on
the driver. That sample is the only thing bounded. Prediction reads whole texts: each
batch's distinct words go through the forward pass together, for all languages at once,
and a worker remembers the words it has seen.

Null text, or one without a letter: `und`, score 0. Texts of equal likelihood in several
languages take the first by name. Without labelled rows all is `und`. Repeated rows get
equal results; extra columns are not returned.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.bytewords import ALNUM, blocks, mix, powers

UNKNOWN = "und"
WORD = 32  #: longer words are scored in parts of so many bytes
LONGEST = WORD + 1  #: bytes of the longest piece used: a part with its leading blank
TOGETHER = 16_384  #: words in one forward pass
CACHE = 400_000  #: words a worker remembers; the table is emptied when full
FOREIGN = 0.05
FLOOR = 1e-7  #: least probability of a byte piece


def _spans(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


@dataclass
class Pieces:
    """Byte strings of a vocabulary, found by hash."""

    keys: np.ndarray  #: sorted hashes
    order: np.ndarray  #: piece of each
    lengths: np.ndarray  #: that pieces have, in bytes

    @staticmethod
    def load(path: str) -> tuple[Pieces, list[bytes]]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {bytes([i]) for i in range(256)}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                piece = model.id_to_piece(i).replace("▁", " ").lower().encode()
                if len(piece) <= LONGEST:
                    texts.add(piece)
        listed = sorted(texts)
        data = np.frombuffer(b"".join(listed), np.uint8)
        lengths = np.array([len(p) for p in listed])
        ends = np.cumsum(lengths)
        keys = span_hash(_spans(data), ends - lengths, lengths)
        order = np.argsort(keys)
        return Pieces(keys[order], order, np.unique(lengths)), listed

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each piece, or -1."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)


def span_hash(running: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    _, down = powers(len(running))
    return mix((running[starts + lengths] - running[starts]) * down[starts] + np.uint64(0) + np.asarray(lengths).astype(np.uint64))


class Words:
    """Words of at most WORD bytes with a leading blank, longest first, and their pieces."""

    def __init__(self, words: list[bytes], pieces: Pieces):
        lengths = np.array([len(w) + 1 for w in words])
        self.order = np.argsort(-lengths, kind="stable")
        data = np.frombuffer(b"".join(b" " + words[i] for i in self.order), np.uint8)
        self.lengths = lengths[self.order]
        self.starts = np.cumsum(self.lengths) - self.lengths
        running = _spans(data)
        self.longest = int(self.lengths[0]) if len(words) else 0
        #: (end, length) -> (words, pieces) for all pieces that end there
        self.at: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.longest + 1)]
        for end in range(1, self.longest + 1):
            active = int(np.searchsorted(-self.lengths, -end, side="right"))
            for n in pieces.lengths[: np.searchsorted(pieces.lengths, end, side="right")].tolist():
                found = pieces.find(span_hash(running, self.starts[:active] + (end - n), n))
                words_at = np.flatnonzero(found >= 0)
                if len(words_at):
                    self.at[end].append((n, words_at.astype(np.int32), found[words_at].astype(np.int32)))

    def forward(self, p: np.ndarray) -> np.ndarray:
        """alpha[end, word, language]: probability of all ways to cut the first `end` bytes."""
        alpha = np.zeros((self.longest + 1, len(self.lengths), p.shape[1]))
        alpha[0] = 1
        for end in range(1, self.longest + 1):
            for n, w, piece in self.at[end]:
                alpha[end, w] += alpha[end - n, w] * p[piece]
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language, in the order given."""
        out = np.empty((len(self.lengths), p.shape[1]))
        out[self.order] = np.log(self.forward(p)[self.lengths, np.arange(len(self.lengths))])
        return out

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language, in words that occur `counts` times."""
        counts = counts[self.order]
        alpha = self.forward(p)
        every = np.arange(len(self.lengths))
        total = alpha[self.lengths, every]
        beta = np.zeros_like(alpha)
        beta[self.lengths, every] = counts / total
        uses = np.zeros_like(p)
        for end in range(self.longest, 0, -1):
            for n, w, piece in self.at[end]:
                step = beta[end, w] * p[piece]
                beta[end - n, w] += step
                for k in range(p.shape[1]):
                    uses[:, k] += np.bincount(piece, alpha[end - n, w, k] * step[:, k], len(p))
        return uses


def passes(words: list[bytes]) -> list[slice]:
    return [slice(i, i + TOGETHER) for i in range(0, len(words), TOGETHER)]


def parts(word: bytes) -> list[bytes]:
    """Parts of at most WORD bytes, cut between characters."""
    if len(word) <= WORD:
        return [word]
    out, at = [], 0
    while at < len(word):
        end = min(at + WORD, len(word))
        while end < len(word) and word[end] & 0xC0 == 0x80 and end > at + WORD - 4:
            end -= 1
        out.append(word[at:end])
        at = end
    return out


@dataclass
class Model:
    langs: list[str]
    vocabulary: str  #: path of the vocabulary
    p: np.ndarray  #: piece x language


def fit(labelled: DataFrame, vocabulary: str, train_docs: int = 400, rounds: int = 3) -> Model:
    """Learn from `text` and `lang`; rows with a null in either are left out."""
    rows = labelled.select("doc_id", "text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = dict(rows.groupBy("lang").count().collect())
    langs = sorted(sizes)
    pieces, listed = Pieces.load(vocabulary)
    if not langs:
        return Model([], vocabulary, np.zeros((len(listed), 0)))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, train_docs / n)).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < share * (1 << 20))
    word = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([0-9a-z\x{80}-\x{10FFFF}]+)"), 1)).alias("word")
    counted = chosen.select("lang", word).groupBy("word").pivot("lang", langs).count().fillna(0).toPandas()
    split = [parts(w.encode()) for w in counted["word"]]
    owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
    listed_words = [w for s in split for w in s]
    counts = counted[langs].to_numpy(float)[owner]
    words = [(Words(listed_words[part], pieces), counts[part]) for part in passes(listed_words)]
    lengths = np.array([len(x) for x in listed])
    floor = np.where(lengths == 1, FLOOR, 0.0)[:, None]
    start = np.exp(-1.5 * lengths)[:, None]
    p = np.repeat(start / start.sum(), len(langs), axis=1) + floor
    for _ in range(rounds):
        uses = sum((w.expected(p, n) for w, n in words), np.zeros_like(p)) + 1e-3
        p = uses / uses.sum(axis=0) + floor
    return Model(langs, vocabulary, p)


class Scorer:
    """Log probabilities of words, remembered by hash."""

    def __init__(self, model: Model):
        self.model = model
        self.pieces, _ = Pieces.load(model.vocabulary)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.logs = np.zeros((0, len(self.model.langs)), np.float32)

    def totals(self, texts: pa.Array) -> np.ndarray:
        """Log probability of each text in each language."""
        out = np.zeros((len(texts), len(self.model.langs)))
        for b in blocks(texts, ALNUM, 2 << 20):
            if len(self.keys) > CACHE:
                self.clear()
            keys, first, of = np.unique(b.hashes(), return_index=True, return_inverse=True)
            missing = np.flatnonzero(~np.isin(keys, self.keys, assume_unique=True))
            if len(missing):
                raw = b.data.tobytes()
                split = [parts(raw[b.starts[i] : b.ends[i]]) for i in first[missing]]
                owner = np.repeat(np.arange(len(split)), [len(s) for s in split])
                fresh = [w for s in split for w in s]
                logs = np.concatenate([Words(fresh[part], self.pieces).likelihood(self.model.p) for part in passes(fresh)])
                summed = np.stack([np.bincount(owner, logs[:, k], len(split)) for k in range(logs.shape[1])], axis=1)
                anyone = np.logaddexp.reduce(summed, axis=1, keepdims=True) - np.log(summed.shape[1])
                summed = np.logaddexp(np.log1p(-FOREIGN) + summed, np.log(FOREIGN) + anyone)
                at = np.searchsorted(self.keys, keys[missing])
                self.keys = np.insert(self.keys, at, keys[missing])
                self.logs = np.insert(self.logs, at, summed, axis=0)
            logs = self.logs[np.searchsorted(self.keys, keys)][of]
            docs = b.word_docs()
            for k in range(out.shape[1]):
                out[b.first : b.first + b.docs, k] = np.bincount(docs, logs[:, k], b.docs)
        return out


_scorers: dict[str, Scorer] = {}


def scorer(token: str, model) -> Scorer:
    """The scorer of a model, one per worker; that of an earlier model is let go."""
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(model.value)
    return _scorers[token]


def predict(docs: DataFrame, model: Model, keep: list[str | Column] = ("doc_id",)) -> DataFrame:
    """The kept columns, lang_pred and score of every document."""
    if not model.langs:
        return docs.select(*keep, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one probability per piece and language
    langs = np.array(model.langs)
    token = uuid.uuid4().hex

    @F.arrow_udf("lang string, score double")
    def best(texts: pa.Array) -> pa.Array:
        logs = scorer(token, shared).totals(texts)
        logs -= logs.max(axis=1, keepdims=True) if len(logs) else 0.0
        posterior = np.exp(logs)
        posterior /= posterior.sum(axis=1, keepdims=True)
        top = posterior.argmax(axis=1)
        return pa.StructArray.from_arrays(
            [pa.array(langs[top].tolist(), pa.string()), pa.array(posterior[np.arange(len(top)), top])], ["lang", "score"])

    has_letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    # The kept columns in one, so that their names cannot clash with these.
    scored = docs.select(F.struct(*keep).alias("kept"), has_letter.alias("has_letter"), best(F.lower("text")).alias("best"))
    return scored.select("kept.*", F.when(F.col("has_letter"), F.col("best.lang")).otherwise(UNKNOWN).alias("lang_pred"),
                         F.when(F.col("has_letter"), F.col("best.score")).otherwise(0.0).alias("score"))
