"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces (forward algorithm); a text's score for a language is the product over its words.
Probabilities are learned by expectation-maximisation (the backward algorithm gives expected piece counts) on the word
counts of a bounded sample of labelled documents: at most about ``docs_per_language`` a language, picked by a hash of the id.

Words are maximal runs of letters, lower-cased, behind a word mark, scored whole however long; what is learned from a run over ``MAX_WORD``
letters is learned from its parts.
Work is done once for each distinct word that a worker meets, for many words at once in numpy.

Defined results: null text or no letter: ``und``, score 0; no labelled rows at all: every text is ``und``; ties go to
the smaller language name; repeated rows are scored alike; other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces, share

WORD = re.compile(r"[^\W\d_]+")
MARK = "▁"
#: Longer words are scored one by one, with forward vectors that are scaled up as they go.
MAX_WORD = 40
#: Distinct words a worker remembers before it starts anew.
REMEMBERED = 250_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
UNKNOWN = 1e-7


def vocabulary(path: str) -> list[str]:
    """The pieces of the public sentencepiece model that lower-cased words can use."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))}
    fit = (p for p in pieces if p == p.lower() and MARK not in p[1:])
    return sorted(p for p in fit if p == MARK or p.removeprefix(MARK).isalpha())


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def _hashed(codes: np.ndarray) -> np.ndarray:
    h = np.zeros(len(codes), np.uint64)
    for j in range(codes.shape[1]):
        h = h * _BASE + codes[:, j] + np.uint64(1)
    return h


class PieceModel:
    """Piece probabilities of each language, and the words scored so far."""

    def __init__(self, pieces: list[str], languages: list[str]) -> None:
        by_length = defaultdict(list)
        for p in pieces:
            by_length[len(p)].append(p)
        keys = np.concatenate([_hashed(_codes(x)) for _, x in sorted(by_length.items())]) if pieces else np.zeros(0, np.uint64)
        self.keys = np.sort(keys)
        self.longest = max(by_length, default=1)
        self.languages = languages
        self.prob = np.full((len(self.keys) + 1, len(languages)), 1.0 / (len(self.keys) + 1))
        self.prob[-1] = UNKNOWN
        self.prior = np.zeros(len(languages))
        self._forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("seen", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.languages)))

    def _pieces(self, codes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Every span (i, j) with the index of its piece for each word and whether there is one; single letters always count."""
        n, last = codes.shape[1], len(self.keys)
        for i in range(n):
            h = np.zeros(len(codes), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = h * _BASE + codes[:, j - 1] + np.uint64(1)
                at = np.searchsorted(self.keys, h)
                at[at == last] = last - 1
                known = self.keys[at] == h if last else np.zeros(len(h), bool)
                if j == i + 1:
                    yield i, j, np.where(known, at, last), np.ones(len(h), bool)
                elif known.any():
                    yield i, j, at, known

    def log_words(self, words: list[str]) -> np.ndarray:
        """log P(word) in each language, summed over segmentations."""
        out = np.zeros((len(words), len(self.languages)))
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            by_length[len(w)].append(k)
        for n, at in by_length.items():
            for lo in range(0, len(at), 8_000):
                part = at[lo : lo + 8_000]
                alpha = np.zeros((n + 2, len(part), len(self.languages)))
                alpha[0] = 1
                for i, j, piece, known in self._pieces(_codes([MARK + words[k] for k in part])):
                    if known.all():
                        alpha[j] += alpha[i] * self.prob[piece]
                    else:
                        hit = np.flatnonzero(known)
                        alpha[j, hit] += alpha[i, hit] * self.prob[piece[hit]]
                out[part] = np.log(np.maximum(alpha[n + 1], 1e-300))
        return out

    def log_long(self, word: str) -> np.ndarray:
        """The same for one word of any length."""
        codes = _codes([MARK + word])[0]
        n, last = len(codes), len(self.keys)
        piece = np.full((min(self.longest, n), n), -1)  # by length and place
        h = np.zeros(n, np.uint64)
        for k in range(len(piece)):
            h = h[: n - k] * _BASE + codes[k:] + np.uint64(1)
            at = np.minimum(np.searchsorted(self.keys, h), max(0, last - 1))
            known = self.keys[at] == h if last else np.zeros(len(h), bool)
            piece[k, : n - k] = np.where(known, at, last if k == 0 else -1)
        alpha, scale = np.zeros((n + 1, len(self.languages))), np.zeros(len(self.languages))
        alpha[0] = 1
        for j in range(1, n + 1):
            lo = max(0, j - len(piece))
            own = piece[np.arange(j - lo - 1, -1, -1), np.arange(lo, j)]
            hit = own >= 0
            alpha[j] = (alpha[lo:j][hit] * self.prob[own[hit]]).sum(axis=0)
            if alpha[j].min() < 1e-100:
                factor = np.maximum(alpha[lo : j + 1].max(axis=0), 1e-300)
                alpha[lo : j + 1] /= factor
                scale += np.log(factor)
        return np.log(np.maximum(alpha[n], 1e-300)) + scale

    def fit(self, counts: list[Counter], rounds: int = 3, smooth: float = 0.05) -> None:
        """Expectation-maximisation from equal probabilities, one language after the other."""
        for lang, words in enumerate(counts):
            by_length = defaultdict(list)
            for w in words:
                by_length[len(w)].append(w)
            p = self.prob[:, lang].copy()
            for _ in range(rounds):
                expected = np.zeros(len(p))
                for n, group in by_length.items():
                    for lo in range(0, len(group), 20_000):
                        part = group[lo : lo + 20_000]
                        weight = np.array([words[w] for w in part], float)
                        spans = list(self._pieces(_codes([MARK + w for w in part])))
                        alpha, beta = np.zeros((n + 2, len(part))), np.zeros((n + 2, len(part)))
                        alpha[0], beta[n + 1] = 1, 1
                        for i, j, piece, known in spans:
                            alpha[j] += np.where(known, alpha[i] * p[piece], 0)
                        for i, j, piece, known in reversed(spans):
                            beta[i] += np.where(known, beta[j] * p[piece], 0)
                        scale = weight / np.maximum(alpha[n + 1], 1e-300)
                        for i, j, piece, known in spans:
                            got = np.where(known, alpha[i] * p[piece] * beta[j] * scale, 0)
                            expected += np.bincount(piece, got, len(p))
                expected[:-1] += smooth
                expected[-1] = 0
                p = expected / expected.sum()
                p[-1] = UNKNOWN
            self.prob[:, lang] = p

    def _learn_words(self, fresh: set[str]) -> None:
        if len(self.seen) + len(fresh) > REMEMBERED:
            self._forget()
        new = sorted(fresh)
        first = len(self.seen)
        if first + len(new) > len(self.rows):
            grown = np.zeros((int(1.3 * (first + len(new))), len(self.languages)))
            grown[:first] = self.rows[:first]
            self.rows = grown
        short = [k for k, w in enumerate(new) if len(w) <= MAX_WORD]
        self.rows[first + np.array(short, int)] = self.log_words([new[k] for k in short])
        for k, w in enumerate(new):
            if len(w) > MAX_WORD:
                self.rows[first + k] = self.log_long(w)
        self.seen.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for lo in range(0, len(texts), 512):
            group = [WORD.findall(t.lower()) if t else [] for t in texts[lo : lo + 512]]
            fresh = set().union(*group).difference(self.seen)
            if fresh:
                fresh |= set().union(*group) if len(self.seen) + len(fresh) > REMEMBERED else set()
                self._learn_words(fresh)
            for words in group:
                if not self.languages or not any(map(_has_letter, words)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                at = np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words))
                total = self.rows[at].sum(axis=0) + self.prior
                best = int(total.argmax())
                langs.append(self.languages[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
        return langs, scores


def _has_letter(word: str) -> bool:
    return any(map(str.isalpha, word))


def train(docs: DataFrame, training: Column, pieces: list[str], docs_per_language: int = 1500, label: str = "lang", text: str = "text", key: str = "doc_id") -> PieceModel:
    """Fit on labelled rows that meet ``training``: all of a language that has at most ``docs_per_language``, else
    about so many of them, picked by a hash of the id."""
    rows = docs.where(training & F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    languages = sorted(sizes)
    model = PieceModel(pieces, languages)
    if not languages:
        return model
    share_of = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, docs_per_language / n))])
    picked = rows.where(F.pmod(F.xxhash64(F.col(key), F.lit("language")), F.lit(1_000_000)) < share_of[F.col(label)] * 1_000_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in WORD.findall(t.lower()):
                    for lo in range(0, len(w), MAX_WORD):
                        found[lang][w[lo : lo + MAX_WORD]] += 1
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counted = picked.select(F.col(label).alias("lang"), F.col(text).alias("text")).mapInArrow(count, "lang string, word string, n long")
    counts: dict[str, Counter] = defaultdict(Counter)
    for r in counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.lang][r.word] += r.n
    model.fit([counts[x] for x in languages])
    total = sum(sizes.values())
    model.prior = np.array([math.log(sizes[x] / total) for x in languages])
    return model


def identify(docs: DataFrame, model: PieceModel, text: str = "text") -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (posterior of that language). Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "score")
    shared = share(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            langs, scores = shared.value.predict(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")
