"""Personal data by bootstrapped contextual extraction.

Seeds. Four kinds of entity are found exactly: email, ip, card (Luhn), phone. These base spans always stay. A fifth kind, secret, has
seeds of its own: hexadecimal keys of 32 to 64 digits that are assigned to a name in quotes. Such a key may as well be a checksum, so it is evidence alone: a span of
kind secret is what stands in the slot of a trusted pattern, be it a seed or of any other shape, and a key in a place like no other is none.

Patterns. The lexical patterns of an entity are the words around it: the word before, the two words before, the word before with the
word after. Words are lower-cased, digits become 0, punctuation at their ends goes; what is nothing but punctuation is passed over.

Bootstrapping. The graph has an edge from a pattern of a kind to each identifier (a seed, or a word with a digit, an at sign or underscore)
that stands in its slot, anywhere in the corpus. Spark scores it in rounds. A pattern's reliability is the reliability of all that stands
in its slot, smoothed: every word in the slot counts, so that a second scan counts how often the patterns' contexts are met at all. An
identifier's reliability for a kind is one for a seed, else the noisy-or of the kind's patterns it stands in, over its whole corpus. Identifiers that
come to be trusted (``confident``) are seeds of the next round: their other contexts become patterns, which find identifiers of any shape.
Instances are told apart by kind and surface. After the last round each identifier in the slot of a trusted pattern, backed by at
least ``min_seeds`` different trusted identifiers, is added as a span of the pattern's kind, unless it meets a base span.

At scale. Only contexts that ``min_seeds`` different trusted identifiers share can be patterns. Each round looks for such contexts by a join of edges with what is trusted, and counts the new ones' slots in one scan
of the texts (in blocks of at most ``block`` contexts, each broadcast); a round without new ones scans nothing. The rounds are joins and
aggregations by pattern and by instance over edges with counts, so a common context costs one row for each different identifier.

Defined results: null is the empty text; repeated rows are searched each; an empty table stays empty; other columns pass through, but for
``base`` and ``spans``, which are replaced; texts and words are taken whole, however long.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, forget, free_names, settled, share

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits does: all starts within a run fare alike.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?i)(?<=[=:]\x20[\"'])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?=[\"'])|(?<=[=:][\"'])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,64}(?=[\"'])")
_DIGIT = re.compile("[0-9]")
#: An identifier of any shape: groups of digits, or what of a word holds a digit, an at sign or an underscore.
_IDENTIFIER = re.compile(
    r"(?P<groups>(?<![\w@.+-])[+(]?[0-9](?:[0-9()./-]|\x20(?=[0-9(]))*[0-9](?![\w@]))|(?<![^\s\"'<>()\[\]{},;|])[^\s\"'<>()\[\]{},;|0-9@_]*+[0-9@_][^\s\"'<>()\[\]{},;|]*+"
)
_TRIM = "\"'()[]{}<>,;:.!?*#$%&|=-"
#: Longer words are told apart by their hash; words whose form is remembered by a worker; texts taken at once.
LONGEST, REMEMBERED, ROWS = 40, 200_000, 500


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches: from each @ back over its local part, then its host."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        host = _HOST.match(text, at + 1) if a < at else None
        if host:
            floor = host.end()
            out.append((a, floor))
        at = text.find("@", max(at + 1, floor))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The exact entities of a text by kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = emails(text)
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split("."))]
    out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d)]
    if "+" in text:
        out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_digits(m.group())) <= 15]
    return out


def identifiers(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str | None, int, int]]:
    """(kind, or null if it is none's seed; start; end) of all seeds and of all identifiers that meet no base span."""
    out = [(k, a, b) for k in KINDS for a, b in base[k]]
    if not out and not ("@" in text or "_" in text or _DIGIT.search(text)):
        return []
    taken, at = sorted((a, b) for _, a, b in out), 0
    secrets = {m.span() for m in _SECRET.finditer(text)} if "=" in text or ":" in text else set()
    reach = 0
    for m in _IDENTIFIER.finditer(text):
        a, b = m.span()
        if not m["groups"]:
            while a < b and text[a] in _TRIM:
                a += 1
            while a < b and text[b - 1] in _TRIM:
                b -= 1
        while at < len(taken) and taken[at][0] < b:
            reach = max(reach, taken[at][1])
            at += 1
        if a < b and reach <= a:
            out.append(("secret" if (a, b) in secrets else None, a, b))
    return out


def plain(word: str) -> str:
    """The form of a word in a pattern; empty if there is nothing but punctuation."""
    s = re.sub("[0-9]", "0", word.lower().strip(_TRIM))
    return s if len(s) <= LONGEST else xxhash.xxh3_128_hexdigest(s)


def _around(text: str, start: int, end: int, form: Memory) -> tuple[list[str], str]:
    """The last two words before a span and the first behind it, whole, in plain form."""
    size = 60
    while True:
        lo = max(0, start - size)
        words = [w for w in map(form.__getitem__, text[lo:start].split()[1 if lo and not text[lo].isspace() and not text[lo - 1].isspace() else 0 :]) if w]
        if len(words) >= 2 or not lo:
            break
        size *= 4
    size = 40
    while True:
        hi = min(len(text), end + size)
        pieces = text[end:hi].split()
        if hi < len(text) and pieces and not text[hi - 1].isspace() and not text[hi].isspace():
            pieces.pop()
        after = next((w for w in map(form.__getitem__, pieces) if w), "")
        if after or hi == len(text):
            return words[-2:], after
        size *= 4


def contexts(before: list[str], after: str) -> list[str]:
    """The patterns of a place, without a kind."""
    if not before:
        return []
    out = [f"1|{before[-1]}"]
    if len(before) == 2:
        out.append(f"2|{before[0]} {before[1]}")
    if after:
        out.append(f"3|{before[-1]} _ {after}")
    return out


def _scan(at: int, names_of: list[str]):  # noqa: ANN202
    found_type = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surface", pa.string()), ("contexts", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, form = TaskContext.get().partitionId() << 40, Memory(plain, REMEMBERED)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                all_base, all_found = [], []
                for text in part.column(at).to_pylist():
                    base = base_spans(text) if text else {}
                    found = identifiers(text, base) if text else []
                    all_base.append([{"kind": k, "start": a, "end": b} for k in base for a, b in base[k]])
                    all_found.append([{"kind": k, "start": a, "end": b, "surface": text[a:b].lower(), "contexts": contexts(*_around(text, a, b, form))} for k, a, b in found])
                n = part.num_rows
                rest = [c for i, c in enumerate(part.columns) if i != at]
                names = [c for i, c in enumerate(part.schema.names) if i != at]
                base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*rest, pa.array(range(row, row + n), pa.int64()), pa.array(all_base, base_type), pa.array(all_found, pa.list_(found_type))], names=[*names, *names_of])
                row += n

    return run


def met(docs: DataFrame, text: str, wanted: list[str]) -> DataFrame:
    """(context, slots): how many words, of any shape, stand in the slots of the wanted contexts in all texts."""
    shared = share(docs.sparkSession, frozenset(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, form = shared.value, Memory(plain, REMEMBERED)
        last = frozenset(c[2:].split(" ")[-1] if c[0] == "2" else c[2:].split(" ")[0] for c in known)
        slots = dict.fromkeys(known, 0)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = [w for w in map(form.__getitem__, (text or "").split()) if w]
                for i, w in enumerate(words[:-1]):
                    if w in last:
                        for c in contexts(words[max(0, i - 1) : i + 1], words[i + 2] if i + 2 < len(words) else ""):
                            if c in slots:
                                slots[c] += 1
        kept = {c: n for c, n in slots.items() if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["context", "slots"])

    return docs.select(F.col(text).cast("string").alias("t")).mapInArrow(run, "context string, slots long").groupBy("context").agg(F.sum("slots").alias("slots"))


def reliable(edges: DataFrame, count: Callable[[DataFrame], DataFrame], rounds: int, confident: float, min_seeds: int, smooth: float) -> DataFrame:
    """The patterns (kind, context, reliability) that may add spans, from edges (context, surface, n, kind: of a seed or null). ``count`` gives (context, slots) for a table of contexts."""
    spark = edges.sparkSession
    seeds = settled(edges.where("kind is not null").select("kind", "surface").distinct().withColumn("r", F.lit(1.0)))
    trusted, good, sizes = seeds, None, None
    plain_edges = edges.groupBy("context", "surface").agg(F.sum("n").alias("n"))
    for _ in range(rounds):
        # Patterns come from all that is trusted so far; what else stands in their slots is scored by them.
        sure = trusted.where(F.col("r") >= confident)
        backed = settled(plain_edges.join(sure, "surface").groupBy("kind", "context").agg(F.count("*").alias("backing")).where(F.col("backing") >= min_seeds).select("kind", "context"))
        new = backed.select("context").distinct()
        new = settled(new if sizes is None else new.join(sizes, "context", "left_anti"))
        if not new.isEmpty():
            # Identifiers of several words are more than their slot's words.
            own = plain_edges.join(new, "context", "left_semi").groupBy("context").agg(F.sum("n").alias("own")).join(count(new), "context", "left")
            more = settled(own.select("context", F.greatest("own", F.coalesce("slots", F.lit(0))).alias("slots")))
            sizes = more if sizes is None else settled(sizes.unionByName(more))
        elif sizes is None:
            return spark.createDataFrame([], "kind string, context string, reliability double")
        weighed = plain_edges.join(backed, "context").join(trusted, ["kind", "surface"]).groupBy("kind", "context").agg(F.sum(F.col("n") * F.col("r")).alias("held"))
        if good is not None:
            forget(spark, good)
        good = settled(weighed.join(sizes, "context").select("kind", "context", (F.col("held") / (F.col("slots") + smooth)).alias("reliability")))
        missed = F.exp(F.sum(F.log1p(-F.least("reliability", F.lit(0.999)))))
        heard = plain_edges.join(good, "context").groupBy("kind", "surface").agg((1 - missed).alias("r"))
        trusted = settled(heard.unionByName(seeds).groupBy("kind", "surface").agg(F.max("r").alias("r")))
        for done in (backed, new):
            forget(spark, done)
    return good.where(F.col("reliability") >= confident)


def find_pii(docs: DataFrame, text: str = "text", rounds: int = 3, confident: float = 0.8, min_seeds: int = 5, smooth: float = 1.0, block: int = 200_000) -> DataFrame:
    """All columns of ``docs`` but the text, plus base (the exact entities) and spans (with those that patterns found): arrays of
    struct<kind, start, end> in order of kind, then start; offsets are code points, ends exclusive."""
    spark = docs.sparkSession
    docs = docs.drop("base", "spans")
    c_row, c_found, c_more = free_names(docs, "row", "found", "more")
    at = docs.columns.index(text)
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != text]
    item = "struct<kind:string,start:int,end:int,surface:string,contexts:array<string>>"
    span_type = "array<struct<kind:string,start:int,end:int>>"
    scanned = settled(docs.mapInArrow(_scan(at, [c_row, "base", c_found]), ", ".join([*rest, f"`{c_row}` long, base {span_type}, `{c_found}` array<{item}>"])))
    each = scanned.select(F.col(c_row).alias("row"), F.explode(c_found).alias("x")).select("row", "x.*")
    occurrences = each.select(F.explode("contexts").alias("context"), "surface", "kind")
    all_edges = settled(occurrences.groupBy("context", "surface").agg(F.count("*").alias("n"), F.max("kind").alias("kind")))
    shared_by = all_edges.groupBy("context").agg(F.count("*").alias("several")).where(F.col("several") >= min_seeds).select("context")
    edges = settled(all_edges.join(shared_by, "context"))

    def count(wanted: DataFrame) -> DataFrame:
        blocks, slots = -(-wanted.count() // block), []
        for b in range(blocks):
            own = [r[0] for r in wanted.where(F.pmod(F.xxhash64("context"), F.lit(blocks)) == b).toLocalIterator()]
            slots.append(settled(met(docs, text, own)))
        return reduce(DataFrame.unionByName, slots)

    good = settled(reliable(edges, count, rounds, confident, min_seeds, smooth).select(F.col("kind").alias("by"), "context"))
    span = F.struct(F.col("by").alias("kind"), "start", "end")
    # What may be added: identifiers that are no base entity.
    slot = each.where("kind is null or kind = 'secret'").select("row", "start", "end", F.explode("contexts").alias("context")).join(good, "context")
    # One kind for a span: the first as listed.
    first = F.min_by("by", rank_of(F.col("by")))
    added = slot.groupBy("row", "start", "end").agg(first.alias("by")).groupBy(F.col("row").alias(c_row)).agg(F.collect_list(span).alias(c_more))
    joined = scanned.join(added, c_row, "left")
    placed = F.transform(F.concat("base", F.coalesce(c_more, F.array().cast(span_type))), lambda x: F.struct(rank_of(x["kind"]).alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))
    bare = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    for done in (all_edges, edges):
        forget(spark, done)
    return joined.withColumn("spans", F.transform(F.array_sort(placed), bare)).drop(c_row, c_found, c_more)


def rank_of(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, ALL_KINDS)), kind)


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
