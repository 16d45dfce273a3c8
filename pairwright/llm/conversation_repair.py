"""Conversation structure repair: the cheapest edits that bring a conversation's turns to the form ``(system? (user assistant)+)?``.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3; the only way for blank and repeated turns), Insert an empty user or assistant turn (2);
a truncated turn that is not deleted costs 1 more. Of the cheapest ways the one whose initials are least in ASCII is taken.

Method: cost layers as in Wu and Manber's search with errors. Layer c holds for each turn the bitset of grammar states from which the end can be reached at
cost c; it follows from layers c, c-1, c-2 and c-3 by shifting bitsets, as every edit leads from a state to one state. The first layer that holds the start
state at the first turn gives the cost, and a walk along the bits, least initial first, gives the audit.

Plan: turns are range-partitioned and sorted by (conversation, turn) and numbered; 64 consecutive turns of a conversation are a block. No task holds more than a
block, however long a conversation is:

1. A turn is a repetition if it is not the first of its (conversation, role, text): an aggregation whose results meet the turns by turn number.
2. Each block's layers, one lane of bits for each state behind it, give its cost from every state to every state, in parallel.
3. One backward pass over blocks (64 turns to a row, streamed, a vector of four costs in hand) gives what the end costs behind each block.
4. The layers of each block, begun from that vector, are walked from each state, in parallel; one forward pass over blocks picks the walk.
5. Audits meet turns by block, in parallel; a digest of a conversation reads its repaired turns as a stream.

Grammar states: 0 nothing yet (accepting), 1 system, 2 user, 3 assistant (accepting). Roles count by their first letter, s, u or a; others have to be changed or deleted.

Defined results: turns of one number (nulls first) come by role, then by MD5 of the text; a null role or text is one space; a null conversation id is a
conversation of its own; an empty table gives empty results; only named columns are read, so extra ones can't clash. Long texts are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Memory, settled

BLOCK_BITS = 6
FAR = 1 << 40
BLANKS = " \t\n\x0b\x0c\r"
OK, TRUNCATED, DELETE = 0, 1, 2
#: What an inserted or changed turn is in each state, and where it leads.
NEXT_ROLE, NEXT = ("user", "user", "assistant", "user"), (2, 2, 3, 2)
#: What a kept turn of initial s, u, a or another leads to from each state, -1 where the grammar has no such turn.
KEEP = ((1, -1, -1, -1), (2, 2, -1, 2), (-1, -1, 3, -1), (-1, -1, -1, -1))
#: Cost of the end behind the last turn from each state: insertions that complete an exchange.
END = (0, 4, 2, 0)


def _shifts(to: tuple[int, ...], lanes: int) -> list[tuple[int, int]]:
    return [(q * lanes, to[q] * lanes) for q in range(4) if to[q] >= 0]


def layers(codes: bytes, seeds: list[tuple[int, int]], lanes: int) -> list[list[int]]:
    """For each cost the bitsets before each turn and behind the last. Codes are 4 * fault + initial; seeds are (cost, bits behind the last turn)."""
    n, mask = len(codes), (1 << lanes) - 1
    change = _shifts(NEXT, lanes)
    keeps = [_shifts(k, lanes) for k in KEEP]

    def shift(bits: int, by: list[tuple[int, int]]) -> int:
        out = 0
        for q, to in by:
            out |= (bits >> to & mask) << q
        return out

    most = 3 * n + max(c for c, _ in seeds) + 6
    found: list[list[int]] = []
    seen = [0] * (n + 1)
    none = [0] * (n + 1)
    for c in range(most + 1):
        one, two, three = (found[c - k] if c >= k else none for k in (1, 2, 3))
        now = [0] * (n + 1)
        now[n] = seen_end = sum(bits for cost, bits in seeds if cost == c)
        seen[n] |= seen_end
        for i in range(n - 1, -1, -1):
            fault, initial = divmod(codes[i], 4)
            bits = three[i + 1]
            if fault == OK:
                bits |= shift(now[i + 1], keeps[initial]) | shift(two[i + 1], change)
            elif fault == TRUNCATED:
                bits |= shift(one[i + 1], keeps[initial]) | shift(three[i + 1], change)
            bits |= shift(two[i], change)
            now[i] = bits & ~seen[i]
            seen[i] |= now[i]
        found.append(now)
    return found


def block_costs(codes: bytes) -> list[int]:
    """Least cost of the block's turns from state p before it to state q behind it, at 4 * p + q."""
    cost = [FAR] * 16
    for c, layer in enumerate(layers(codes, [(0, 0b1000_0100_0010_0001)], 4)):
        for at in range(16):
            if layer[0] >> at & 1 and cost[at] == FAR:
                cost[at] = c
    return cost


def block_walks(codes: bytes, behind: list[int], starts: range, last: bool) -> list[tuple[int, str] | None]:
    """For each of ``starts`` the state behind the block and the least audit, if what follows the block costs ``behind`` from each state."""
    least = min(behind)
    seeds = [(behind[q] - least, 1 << q) for q in range(4) if behind[q] < FAR]
    found = layers(codes, seeds, 1)
    has = lambda c, i, q: 0 <= c and q >= 0 and found[c][i] >> q & 1
    out: list[tuple[int, str] | None] = []
    for start in starts:
        c = next((c for c, layer in enumerate(found) if layer[0] >> start & 1), None)
        if c is None:
            out.append(None)
            continue
        i, q, audit = 0, start, []
        while i < len(codes):
            fault, initial = divmod(codes[i], 4)
            more = fault == TRUNCATED
            if has(c - 3, i + 1, q):
                step, c, i = "D", c - 3, i + 1
            elif has(c - 2, i, NEXT[q]):
                step, c, q = "I", c - 2, NEXT[q]
            elif has(c - more, i + 1, KEEP[initial][q]):
                step, c, i, q = "K", c - more, i + 1, KEEP[initial][q]
            else:
                step, c, i, q = "R", c - 2 - more, i + 1, NEXT[q]
            audit.append(step)
        while last and q in (1, 2):
            audit.append("I")
            q = NEXT[q]
        out.append((q, "".join(audit)))
    return out


class Repair(NamedTuple):
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; a row for each conversation with turns.
    reports: DataFrame
    #: conv_id, block, step, edit, role, text: the repaired turns, in order of block and step.
    turns: DataFrame


def _trimmed(text: str) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def _of(names: list[str], kind: pa.DataType, batch_rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*batch_rows, strict=True)) if batch_rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *types], strict=True)], names=names)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    costs = Memory(block_costs, 50_000)
    for batch in batches:
        rows = []
        for c, block, entries in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            entries.sort(key=lambda e: (e["pos"], e["code"]))
            # -1 is the mark of a first occurrence; it stands before its turn.
            codes, counts, first = bytearray(), [0, 0, 0], False
            for e in entries:
                if e["code"] < 0:
                    first = True
                    continue
                initial, blank, cut = e["code"] & 3, e["code"] & 4, e["code"] & 8
                fault = 0 if blank else 1 if not first else 2 if cut else None
                if fault is not None:
                    counts[fault] += 1
                codes.append(4 * (OK if fault is None else TRUNCATED if fault == 2 else DELETE) + initial)
                first = False
            illegal = sum((a % 4, b % 4) not in ((0, 1), (1, 2), (2, 1)) for a, b in zip(codes, codes[1:], strict=False))
            rows.append((c, block, bytes(codes), costs[bytes(codes)], *counts, illegal))
        yield _of(["c", "block", "codes", "costs", "blank", "duplicate", "truncated", "illegal"], batch.schema.field(0).type, rows, [pa.int64(), pa.binary(), pa.list_(pa.int64()), *[pa.int64()] * 4])


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by conversation, the last first: adds what the end costs behind each, and whether it is the first or the last of its conversation."""
    held, state = None, None  # the block that waits to hear whether another stands before it; (conversation, costs, initial) of it
    names = ["c", "block", "codes", "behind", "first", "last", "cost", "blank", "duplicate", "truncated", "illegal"]
    types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.bool_(), pa.bool_(), *[pa.int64()] * 5]
    kind = None
    for batch in batches:
        kind, rows = batch.schema.field(0).type, []
        for c, block, codes, costs, blank, duplicate, truncated, illegal in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            new = state is None or state[0] != c
            behind = list(END) if new else state[1]
            here = [min(FAR, *(costs[4 * p + q] + behind[q] for q in range(4))) for p in range(4)]
            if held is not None:
                rows.append((*held[:4], new, *held[5:]))
            if not new:
                illegal += (codes[-1] % 4, state[2]) not in ((0, 1), (1, 2), (2, 1))
            held = (c, block, codes, behind, None, new, here[0], blank, duplicate, truncated, illegal)
            state = (c, here, codes[0] % 4)
        yield _of(names, kind, rows, types)
    if held is not None:
        yield _of(names, kind, [(*held[:4], True, *held[5:])], types)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Memory(lambda key: block_walks(key[0], list(key[1]), range(1 if key[2] else 4), key[3]), 50_000)
    for batch in batches:
        rows = []
        for c, block, codes, behind, first, last, cost, *counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            walks = known[(codes, tuple(behind), first, last)]
            rows.append((c, block, [-1 if w is None else w[0] for w in walks], ["" if w is None else w[1] for w in walks], cost if first else 0, *counts))
        yield _of(["c", "block", "leads", "audits", "cost", "blank", "duplicate", "truncated", "illegal"], batch.schema.field(0).type, rows, [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 5])


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks by conversation in order: the walk from the state that the one before has led to."""
    seen, state = None, 0
    for batch in batches:
        rows = []
        for c, block, leads, audits, *counts in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if seen is None or seen[0] != c:
                seen, state = (c,), 0
            rows.append((c, block, state, audits[state], *counts))
            state = leads[state]
        yield _of(["c", "block", "state", "audit", "cost", "blank", "duplicate", "truncated", "illegal"], batch.schema.field(0).type, rows, [pa.int64(), pa.int32(), pa.string(), *[pa.int64()] * 5])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's audit (pos null) and behind it its turns: the repaired turns."""
    steps, at, state, key = "", 0, 0, None
    for batch in batches:
        rows = []
        for c, block, _, role, text, audit, enters in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if audit is not None:
                steps, at, state, key = audit, 0, enters, (c, block)
            else:
                edit = steps[at]
                if edit == "K":
                    state = KEEP["sua".find(role[:1]) if role[:1] else 3][state]
                    rows.append((c, block, at, "K", role, text))
                elif edit == "R":
                    rows.append((c, block, at, "R", NEXT_ROLE[state], text))
                    state = NEXT[state]
                at += 1
            while at < len(steps) and steps[at] == "I":
                rows.append((*key, at, "I", NEXT_ROLE[state], ""))
                state = NEXT[state]
                at += 1
        yield _of(["c", "block", "step", "edit", "role", "text"], batch.schema.field(0).type, rows, [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string()])


def repair(turns: DataFrame) -> Repair:
    """The reports and repaired turns of ``turns`` (conv_id, turn, role, text)."""
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").alias("c"), F.col("turn").alias("turn"), space("role").alias("role"), space("text").alias("text"))
    rows = rows.withColumn("sum", F.unhex(F.md5("text"))).withColumn("deal", F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    order = ["c", "turn", "role", "sum", "deal"]
    # Equal turns are dealt to several tasks: which of them comes first makes no difference.
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("sum", "deal").withColumn("pos", F.monotonically_increasing_id())
    rows = settled(rows.withColumn("block", F.shiftright("pos", BLOCK_BITS)))
    kind = rows.schema["c"].dataType.simpleString()

    body = _trimmed("text")
    initial = sum(F.when(F.substring("role", 1, 1) == x, i).otherwise(0) for i, x in enumerate("sua")) + F.when(F.substring("role", 1, 1).isin("s", "u", "a"), 0).otherwise(3)
    code = initial + F.when(body == "", 4).otherwise(0) + F.when(~F.substring(body, -1, 1).isin(".", "!", "?"), 8).otherwise(0)
    firsts = rows.groupBy("c", "role", "text").agg(F.min("pos").alias("pos"))
    entries = rows.select("c", "block", "pos", code.cast("int").alias("code")).unionByName(firsts.select("c", F.shiftright("pos", BLOCK_BITS).alias("block"), "pos", F.lit(-1).alias("code")))
    blocks = entries.groupBy("c", "block").agg(F.collect_list(F.struct("pos", "code")).alias("entries"))
    counts = "blank long, duplicate long, truncated long, illegal long"
    measured = blocks.mapInArrow(_measure, f"c {kind}, block long, codes binary, costs array<long>, {counts}")
    ended = measured.repartition("c").sortWithinPartitions("c", F.desc("block")).mapInArrow(_backward, f"c {kind}, block long, codes binary, behind array<long>, first boolean, last boolean, cost long, {counts}")
    walked = ended.repartition("c", "block").mapInArrow(_walk, f"c {kind}, block long, leads array<long>, audits array<string>, cost long, {counts}")
    plan = settled(walked.repartition("c").sortWithinPartitions("c", "block").mapInArrow(_forward, f"c {kind}, block long, state int, audit string, cost long, {counts}"))

    sums = [F.sum(x).alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    gaps = rows.groupBy("c").agg((F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))).cast("long").alias("gaps"))
    reports = plan.groupBy("c").agg(*sums, audit.alias("audit")).alias("r").join(gaps.alias("g"), F.col("r.c").eqNullSafe(F.col("g.c")))
    reports = reports.select(F.col("r.c").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    both = rows.select("c", "block", "pos", "role", "text", F.lit(None).cast("string").alias("audit"), F.lit(None).cast("int").alias("state"))
    both = both.unionByName(plan.select("c", "block", F.lit(None).cast("long").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), "audit", "state"))
    mended = both.repartition("c", "block").sortWithinPartitions("c", "block", "pos").mapInArrow(_apply, f"c {kind}, block long, step int, edit string, role string, text string")
    return Repair(reports, mended.withColumnRenamed("c", "conv_id"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, sha, kind = None, None, None
    for batch in batches:
        kind, rows = batch.schema.field(0).type, []
        for c, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key is None or key[0] != c:
                if key is not None:
                    rows.append((key[0], sha.hexdigest()))
                key, sha = (c,), hashlib.sha256()
                lead = ""
            else:
                lead = "\n"
            sha.update(f"{lead}{role}:{text}".encode())
        yield _of(["c", "sha256"], kind, rows, [pa.string()])
    if key is not None:
        yield _of(["c", "sha256"], kind, [(key[0], sha.hexdigest())], [pa.string()])


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, sha256) of the ``role:text`` lines of each conversation of repaired turns. SHA-256 has to read a conversation in order: a stream, not a group in memory."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.repartition("conv_id").sortWithinPartitions("conv_id", "block", "step").select("conv_id", "role", "text")
    return rows.mapInArrow(_digest, f"c {kind}, sha256 string").withColumnRenamed("c", "conv_id")


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of ``conv_id:turn`` mod 20: 0 a turn lost, 1 its text lost, 2 its stops lost, 3 the turn twice, 4 its role made user."""
    space = lambda x: F.coalesce(F.col(x).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), F.pmod(F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")), F.lit(20)).alias("by"))
    text = F.when(F.col("by") == 1, "").when(F.col("by") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("by") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("by") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("by <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")
