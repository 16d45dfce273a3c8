"""LM scoring by prediction by partial matching (PPM) over the running bytes of a corpus.

A text is the byte stream of its lower-cased (A-Z) words with one space between them and an end symbol behind. Every symbol is
predicted from the ``ORDER`` bytes before it, over spaces and words alike (before a text's first byte stand start symbols). In a byte-context
trie of the training texts, a symbol counted c times among the n of its context has the probability (2c - 1)/2n, and the escape to the
context without its oldest byte q/2n, for q distinct symbols (method D). Symbols of a longer context are excluded from the shorter one, from n and
q alike; where all of them are excluded the escape costs nothing. Behind the empty context all bytes that never occur are equal.
A text's score is the sum of its symbols' log10 probabilities.

At scale. A symbol with its context is seven bytes, a gram, and one 64-bit key. The counts of the trie's shorter contexts are sums of its
longest ones', so counting grams by a shuffle (added up within tasks first) gives the whole trie: no node is left out, however many there are.
Grams are parted by the bytes just before the symbol: all longer contexts of a gram are in its part, the nodes of the shorter ones
(bounded by the alphabet, and their number checked) are shared. Each distinct gram of all texts, learned from or not, is scored once in its part. A text
meets the scores of its grams, and the base counts of its words, by joins; the most frequent of both, at most ``max_grams`` and ``max_words``, are
broadcast, which bears on speed alone.

Defined results: null is the empty text (one end token); repeated rows are scored each; with nothing to learn from, every
symbol has 1/256 and every token 1/(0 + 0 + 1); an empty table stays empty; long texts are read in slices, whole. Columns other than the key are not returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, settled, share

ORDER = 6
END = b"\n"
#: Distinct words and grams that a task counts before it hands them on, positions sorted at once, and bytes of a long text's slice.
FLUSH, GRAMS, SORTED, SLICE = 1_000_000, 1_500_000, 4_000_000, 1 << 22
#: Grams of the parted trie that a task holds at once, beside those of one part; and the most nodes of short contexts that are shared.
HELD, MOST_SHARED = 500_000, 1_000_000
ROWS = 256


def normal(raw: bytes | None) -> bytes:
    """The symbols of a text but the end."""
    return b" ".join((raw or b"").lower().split())


def slices(raw: bytes | None) -> Iterator[bytes]:
    """A text in pieces that end behind a white space, so that words stay whole."""
    raw = raw or b""
    at = 0
    while len(raw) - at > SLICE:
        end = at + SLICE
        while end < len(raw) and raw[end - 1] not in b" \t\n\x0b\x0c\r":
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def streams(raw: bytes | None) -> Iterator[bytes]:
    """The symbols of a text, each piece behind the ``ORDER`` symbols before it; only the last piece holds the end."""
    before, done = END * ORDER, False
    parts = [*slices(raw)] if raw and len(raw) > SLICE else [raw]
    for i, part in enumerate(parts):
        own = normal(part)
        if own and done:
            own = b" " + own
        done = done or bool(own)
        if i == len(parts) - 1:
            own += END
        whole = before + own
        if len(whole) > ORDER:
            yield whole
        before = whole[-ORDER:]


def grams_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(the gram of each symbol, which piece it is of) of pieces as ``streams`` gives them."""
    buf = np.frombuffer(b"".join(pieces), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    key = buf[ORDER:].copy()
    for d in range(1, ORDER + 1):
        key |= buf[ORDER - d : len(buf) - d] << np.uint64(8 * d)
    own = np.ones(len(buf), bool)
    first = np.cumsum(sizes) - sizes
    own[(first[:, None] + np.arange(ORDER)).ravel()] = False
    return key[own[ORDER:]], np.repeat(np.arange(len(pieces)), sizes - ORDER)


# ---- counting ----


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word binary, n long) over all texts; the end token is the word ``\\n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for raw in batch.column(0).to_pylist():
                for part in slices(raw):
                    seen.update(part.lower().split())
                    if len(seen) > FLUSH:
                        yield emit()
            seen[END] += batch.num_rows
        yield emit()

    return docs.select(F.col(text).cast("binary").alias("t")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def added_up(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Counts of sorted distinct keys, from lists of keys with counts."""
    keys = np.concatenate([p[0] for p in parts])
    if not len(keys):
        return parts[0]
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(np.concatenate([p[k] for p in parts])[by], first) for k in (1, 2))


def count_grams(docs: DataFrame, learn: Column, text: str = "text") -> DataFrame:
    """(gram long, n long, met long) of all texts: how often it is in texts to learn from, and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[tuple[np.ndarray, ...]] = []
        waiting: list[list[bytes]] = [[], []]  # not to learn from, to learn from
        size = [0, 0]

        def count(which: int) -> None:
            keys, n = np.unique(grams_of(waiting[which])[0], return_counts=True) if waiting[which] else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            counted.append((keys, n * which, n))
            waiting[which], size[which] = [], 0

        def emit() -> pa.RecordBatch:
            keys, n, met = added_up(counted)
            counted.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(met.astype(np.int64))], ["gram", "n", "met"])

        for batch in batches:
            for raw, which in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for piece in streams(raw):
                    waiting[which].append(piece)
                    size[which] += len(piece)
                    if size[which] >= SORTED:
                        count(which)
                        if sum(len(c[0]) for c in counted) > 2 * GRAMS:
                            counted[:] = [added_up(counted)]
                            if len(counted[0][0]) > GRAMS:
                                yield emit()
        count(0)
        count(1)
        yield emit()

    learned = F.coalesce(learn, F.lit(False)).cast("int").alias("l")
    return docs.select(F.col(text).cast("binary").alias("t"), learned).mapInArrow(run, "gram long, n long, met long").groupBy("gram").agg(F.sum("n").alias("n"), F.sum("met").alias("met"))


# ---- the trie ----


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 8 * (order + 1)) - 1)


class Level:
    """The trie's nodes of one order: contexts with their symbols and counts."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, order: int) -> None:
        self.order = order
        self.key, inverse = np.unique(keys & _mask(order), return_inverse=True)
        self.n = np.bincount(inverse, n, len(self.key))
        self.context, self.of, self.kinds = np.unique(self.key >> np.uint64(8), return_inverse=True, return_counts=True)
        self.total = np.bincount(self.of, self.n, len(self.context))
        self.excluded = np.zeros(len(self.context))

    def over(self, shorter: Level) -> Level:
        """Work out what this order's symbols take from the shorter contexts."""
        at = np.searchsorted(shorter.key, self.key & _mask(shorter.order))
        self.excluded = np.bincount(self.of, shorter.n[at], len(self.context))
        return self


def levels(keys: np.ndarray, n: np.ndarray, orders: range, below: list[Level]) -> list[Level]:
    """Nodes of the orders, from the counts of their longest contexts, behind those of the shorter orders."""
    out, met = list(below), n > 0
    for order in orders:
        level = Level(keys[met], n[met], order)
        out.append(level.over(out[-1]) if out else level)
    return out


def log10_grams(grams: np.ndarray, trie: list[Level]) -> np.ndarray:
    """log10 of the probability of each gram's symbol in its context."""
    out, todo = np.zeros(len(grams)), np.arange(len(grams))
    came = np.full(len(grams), -1)  # the context of the next longer order, where there was one
    for level in reversed(trie):
        if not len(level.key) or not len(todo):
            continue
        key = grams[todo] & _mask(level.order)
        context = np.minimum(np.searchsorted(level.context, key >> np.uint64(8)), len(level.context) - 1)
        known = level.context[context] == key >> np.uint64(8)
        own, key, context = todo[known], key[known], context[known]
        before = came[own]
        longer = before >= 0
        total, kinds = level.total[context], level.kinds[context].astype(float)
        if longer.any():
            above = trie[level.order + 1]
            total[longer] -= above.excluded[before[longer]]
            kinds[longer] -= above.kinds[before[longer]]
        node = np.minimum(np.searchsorted(level.key, key), len(level.key) - 1)
        hit = level.key[node] == key
        out[own[hit]] += np.log10((level.n[node[hit]] - 0.5) / total[hit])
        escapes = ~hit & (kinds > 0)
        out[own[escapes]] += np.log10(kinds[escapes] / 2 / total[escapes])
        came[own] = context
        open_ = np.ones(len(todo), bool)
        open_[np.flatnonzero(known)[hit]] = False
        todo = todo[open_]
    unseen = 256 - (len(trie[0].key) if trie else 0)
    out[todo] -= np.log10(max(1, unseen))
    return out


def score_grams(grams: DataFrame) -> DataFrame:
    """(gram, met, log_p): the log10 probability of each gram's symbol, by the counts n of all of them."""
    key = F.col("gram")
    for split in (3, 2):  # bytes of a part's contexts
        short = grams.where("n > 0").groupBy(key.bitwiseAND(F.lit((1 << 8 * split) - 1)).alias("gram")).agg(F.sum("n").alias("n"))
        if split == 2 or short.count() <= MOST_SHARED:  # split 2: at most 65,536
            break
    low = short.toArrow()
    shared = share(grams.sparkSession, (low.column("gram").to_numpy().view(np.uint64), low.column("n").to_numpy()))
    part = F.shiftright(key, 8).bitwiseAND(F.lit((1 << 8 * split) - 1)).cast("int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        below = levels(*shared.value, range(split), [])
        held: list[pa.RecordBatch] = []
        size = 0

        def scored(table: pa.Table) -> pa.RecordBatch:
            keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy()
            log_p = log10_grams(keys, levels(keys, n, range(split, ORDER + 1), below))
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), table.column("met").combine_chunks(), pa.array(log_p)], ["gram", "met", "log_p"])

        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                table = pa.Table.from_batches(held)
                group = table.column(0).to_numpy()
                last = int(np.searchsorted(group, group[-1]))  # the last part may go on
                if last:
                    yield scored(table.slice(0, last))
                held = table.slice(last).combine_chunks().to_batches()
                size = len(group) - last
        if held:
            yield scored(pa.Table.from_batches(held))

    ordered = grams.select(part.alias("part"), "gram", "n", "met").repartition("part").sortWithinPartitions("part")
    return ordered.mapInArrow(run, "gram long, met long, log_p double")


# ---- scoring ----


def largest(counted: DataFrame, most: int, n: str = "n") -> Column:
    """The condition on n that keeps the largest counts, at most ``most`` rows of them: from a histogram of at most some
    hundred bins, one for each count up to 128, then eight for each doubling."""
    bin_of = F.when(F.col(n) <= 128, F.col(n).cast("double")).otherwise(F.floor(F.log2(n) * 8) + 1000.0)
    kept, limit = 0, None
    for r in counted.groupBy(bin_of.alias("b")).agg(F.count("*").alias("rows"), F.min(n).alias("low")).orderBy(F.desc("low")).collect():
        kept += r.rows
        if kept > most:
            break
        limit = r.low
    return F.lit(False) if limit is None else F.col(n) >= limit


class Places(dict):
    """Numbers of known words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


class Table:
    """Grams' values, found by one look into a table of hashes; those crowded out (rarer ones) by a search."""

    BITS = 22

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        """``keys``: rare before frequent."""
        slot = np.full(1 << self.BITS, -1, np.int32)
        slot[self._place(keys)] = np.arange(len(keys), dtype=np.int32)
        held = np.maximum(slot, 0)
        self.key = np.where(slot >= 0, keys[held], np.uint64(0xFF << 56)) if len(keys) else np.full(1 << self.BITS, 0xFF << 56, np.uint64)
        self.value = values[held].astype(np.float64) if len(keys) else np.zeros(1 << self.BITS)
        rest = np.ones(len(keys), bool)
        rest[slot[slot >= 0]] = False
        by = np.argsort(keys[rest])
        self.rest, self.rest_value = keys[rest][by], values[rest][by]

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, 0 where there is none; whether there is one)."""
        at = self._place(keys)
        known = self.key[at] == keys
        out = np.where(known, self.value[at], 0.0)
        missed = np.flatnonzero(~known)
        if len(self.rest) and len(missed):
            own = keys[missed]
            place = np.minimum(np.searchsorted(self.rest, own), len(self.rest) - 1)
            hit = self.rest[place] == own
            out[missed[hit]] = self.rest_value[place[hit]]
            known[missed[hit]] = True
        return out, known


def score(docs: DataFrame, learn: Column, max_words: int = 300_000, max_grams: int = 1_500_000, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, learned, n_tokens, n_known, train_tokens, base_score, score), a row for each row of ``docs``; rows that meet ``learn`` are learned from."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    words = settled(count_words(docs.where(learn), text))
    total = words.agg(F.sum("n").alias("tokens"), F.count("*").alias("types")).first()
    tokens, types = int(total.tokens or 0), int(total.types)
    grams = settled(count_grams(docs, learn, text))
    scored = settled(score_grams(grams))
    forget(spark, grams)
    base = lambda n: F.log10((n + 1) / F.lit(float(tokens + types + 1)))

    frequent_word, frequent_gram = largest(words, max_words), largest(scored, max_grams, "met")
    top = words.where(frequent_word).select("word", base(F.col("n")).alias("base")).toArrow()
    common = scored.where(frequent_gram).select("gram", "log_p", "met").toArrow()
    by = np.argsort(common.column("met").to_numpy(), kind="stable")
    shared = share(spark, (top.column("word").to_pylist(), top.column("base").to_numpy(), common.column("gram").to_numpy().view(np.uint64)[by], common.column("log_p").to_numpy()[by]))
    schema = f"row long, `{key}` {kind}, learned boolean, n_tokens long, n_known long, base double, model double, word binary, gram long, k long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, base, grams, log_p = shared.value
        row, table, index = TaskContext.get().partitionId() << 40, Table(grams, log_p), Places(zip(words, range(len(words)), strict=True))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                raws, n = part.column(2).to_pylist(), part.num_rows
                n_tokens, n_known, base_sum, model = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
                rare_words: Counter[tuple[int, bytes]] = Counter()
                rare_grams: list[tuple[np.ndarray, np.ndarray]] = []

                def of_words(tokens: list[bytes], doc: np.ndarray) -> None:
                    at = np.fromiter(map(index.__getitem__, tokens), np.int64, len(tokens))
                    known = at >= 0
                    n_tokens[:] += np.bincount(doc, minlength=n)
                    n_known[:] += np.bincount(doc[known], minlength=n)
                    base_sum[:] += np.bincount(doc[known], base[at[known]], n)
                    for i in np.flatnonzero(~known).tolist():
                        rare_words[int(doc[i]), tokens[i]] += 1

                def of_pieces(pieces: list[bytes], doc: np.ndarray) -> None:
                    own, which = grams_of(pieces)
                    value, known = table.get(own)
                    which = doc[which]
                    model[:] += np.bincount(which, value, n)
                    if not known.all():
                        rare_grams.append(np.unique(which[~known].astype(np.uint64) << np.uint64(56) | own[~known], return_counts=True))

                tokens: list[bytes] = []
                pieces: list[bytes] = []
                token_doc: list[int] = []
                piece_doc: list[int] = []
                size, counts = 0, []
                for i, raw in enumerate(raws):
                    for piece in slices(raw):
                        more = piece.lower().split()
                        tokens += more
                        token_doc.append(i)
                        counts.append(len(more))
                        if len(tokens) > 1_000_000:
                            of_words(tokens, np.repeat(token_doc, counts))
                            tokens, token_doc, counts = [], [], []
                    tokens.append(END)
                    token_doc.append(i)
                    counts.append(1)
                    for piece in streams(raw):
                        pieces.append(piece)
                        piece_doc.append(i)
                        size += len(piece)
                        if size > SORTED:
                            of_pieces(pieces, np.array(piece_doc))
                            pieces, piece_doc, size = [], [], 0
                of_words(tokens, np.repeat(token_doc, counts))
                if pieces:
                    of_pieces(pieces, np.array(piece_doc))
                rows = np.arange(row, row + n)
                word_of, word_k = [*rare_words], [*rare_words.values()]
                keys = np.concatenate([k for k, _ in rare_grams]) if rare_grams else np.zeros(0, np.uint64)
                gram_k = np.concatenate([c for _, c in rare_grams]) if rare_grams else np.zeros(0, np.int64)
                m, g = len(word_of), len(keys)
                none = lambda t, count: pa.nulls(count, t)
                both = lambda values, t: pa.concat_arrays([pa.array(values, t), none(t, m + g)])
                gram_row = row + (keys >> np.uint64(56)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([rows, np.array([row + d for d, _ in word_of], np.int64), gram_row])),
                        pa.concat_arrays([part.column(0), none(part.column(0).type, m + g)]),
                        pa.concat_arrays([part.column(1), none(pa.bool_(), m + g)]),
                        both(n_tokens, pa.int64()),
                        both(n_known, pa.int64()),
                        both(base_sum, pa.float64()),
                        both(model, pa.float64()),
                        pa.concat_arrays([none(pa.binary(), n), pa.array([w for _, w in word_of], pa.binary()), none(pa.binary(), g)]),
                        pa.concat_arrays([none(pa.int64(), n + m), pa.array((keys & _mask(ORDER)).view(np.int64))]),
                        pa.concat_arrays([none(pa.int64(), n), pa.array(word_k, pa.int64()), pa.array(gram_k.astype(np.int64))]),
                    ],
                    names=["row", key, "learned", "n_tokens", "n_known", "base", "model", "word", "gram", "k"],
                )
                row += n

    learned = F.coalesce(learn, F.lit(False)).alias("learned")
    # Settled, so that rows keep their numbers if a task has to run again.
    parts = settled(docs.select(F.col(key), learned, F.col(text).cast("binary").alias("t")).mapInArrow(run, schema))
    zero, whole = F.lit(0.0), F.lit(0).cast("long")
    heads = parts.where("k is null").select("row", key, "learned", "n_tokens", "n_known", "base", "model")
    none = (F.lit(None).cast(kind).alias(key), F.lit(None).cast("boolean").alias("learned"), whole.alias("n_tokens"))
    rare_words = parts.where("word is not null").join(words.where(~F.coalesce(frequent_word, F.lit(False))), "word", "left")
    of_words = rare_words.select("row", *none, F.when(F.col("n").isNotNull(), F.col("k")).otherwise(whole).alias("n_known"), (F.col("k") * base(F.coalesce("n", whole))).alias("base"), zero.alias("model"))
    rare_grams = parts.where("gram is not null").select("row", "gram", "k").join(scored.where(~F.coalesce(frequent_gram, F.lit(False))).select("gram", "log_p"), "gram")
    of_grams = rare_grams.select("row", *none, whole.alias("n_known"), zero.alias("base"), (F.col("k") * F.col("log_p")).alias("model"))
    summed = heads.unionByName(of_words).unionByName(of_grams).groupBy("row").agg(
        F.max(key).alias(key), F.max("learned").alias("learned"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("model").alias("score")
    )
    return summed.select(key, "learned", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
