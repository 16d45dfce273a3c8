"""Exact dedup, conversation repair and peak concurrency against brute force, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import datetime as dt
import hashlib
import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pairwright.llm import concurrency, conversation_repair, exact_dedup, queries, tree_scan

# ---- exact dedup ----

DOCS = "doc_id long, text string, hash string, key string, number long, body string, row int, keep_id long, stays int"


def docs_of(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(*r, "x", "x", 1, "x", 1, 1, 1) for r in rows], DOCS)


@pytest.mark.parametrize("hot", [10_000, 1, 3])
@pytest.mark.parametrize("bits", [128, 4])
@pytest.mark.parametrize("largest", [True, False])
def test_exact_dedup(spark, hot, bits, largest):  # noqa: ANN001
    """Also with a hash of 4 bits, under which most groups hold different texts."""
    dice = random.Random(hot)
    texts = [None, "", " ", "a", "A", "é", "é", "x" * 300_000, "x" * 299_999 + "y", *map(str, range(30))]
    rows = [(i, dice.choice(texts)) for i in range(150)] + [(i, "hot") for i in range(200, 290)]
    rows += [(289, "hot"), (289, "hot"), (None, "hot"), (None, "alone"), (None, "alone"), (None, None), (7, "moved"), (7, "moved")]
    dice.shuffle(rows)
    hash_of = (lambda b: F.substring(F.md5(b), 1, 1).cast("binary")) if bits == 4 else exact_dedup.content_hash
    got = exact_dedup.exact_dedup(docs_of(spark, rows), keep_largest=largest, hash_of=hash_of, hot_groups=hot).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    sha = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    want = sorted((str(i), str((max if largest else min)((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), t or "") for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, sha[r.text_sha256]) for r in got) == want
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_of_nothing(spark):  # noqa: ANN001
    assert exact_dedup.exact_dedup(docs_of(spark, [])).collect() == []


# ---- conversations ----

TURNS = "conv_id long, turn long, role string, text string, c string, block string, pos int, sum int, deal int"


def faults_by_hand(turns):  # noqa: ANN001, ANN201
    """(initial, fault) of turns in order."""
    seen, out = set(), []
    for role, text in turns:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault))
    return out


def repaired_by_hand(turns):  # noqa: ANN001, ANN201
    """Dijkstra over (cost, audit, next turn, state, repaired turns): the first final node is the cheapest and least."""
    grammar = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    marks = faults_by_hand(turns)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(turns) and state in ("", "a"):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        for role in ("user", "assistant"):
            if (state, role[0]) in grammar:
                heapq.heappush(heap, (cost + 2, audit + "I", i, role[0], (*out, (role, ""))))
        if i < len(turns):
            (initial, fault), (role, text) = marks[i], turns[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if (state, initial) in grammar:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, initial, (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in grammar:
                        heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, new[0], (*out, (new, text))))
    raise AssertionError


def in_order(rows):  # noqa: ANN001, ANN201
    rows = [(t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows]
    return sorted(rows, key=lambda y: (y[0] is not None, y[0] or 0, y[1].encode(), hashlib.md5(y[2].encode()).digest()))


def check_repair(spark, convs):  # noqa: ANN001
    rows = [(c, *r, "x", "x", 1, 1, 1) for c, turns in convs.items() for r in turns]
    found = conversation_repair.repair(spark.createDataFrame(rows, TURNS).repartition(5))
    reports = {r.conv_id: r for r in found.reports.collect()}
    turns = defaultdict(list)
    for r in found.turns.orderBy("conv_id", "block", "step").collect():
        turns[r.conv_id].append((r.role, r.text))
    sums = {r.conv_id: r.sha256 for r in conversation_repair.digests(found.turns).collect()}
    assert set(reports) == set(convs)
    for c, given in convs.items():
        ordered = in_order(given)
        bare = [(r, x) for _, r, x in ordered]
        marks, r = faults_by_hand(bare), reports[c]
        cost, audit, out = repaired_by_hand(bare)
        numbers = [t for t, _, _ in ordered if t is not None]
        assert r.gaps == (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0)
        assert [r.blank, r.duplicate, r.truncated] == [sum(f == k for _, f in marks) for k in ("blank", "duplicate", "truncated")]
        assert r.illegal == sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:], strict=False))
        assert (r.cost, r.audit, turns[c]) == (cost, audit, out), c
        if out:
            assert sums[c] == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        else:
            assert c not in sums


def random_turns(dice, n):  # noqa: ANN001, ANN201
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User", "u"]
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why? \n", "."]
    return [(dice.choice([None, *range(n)]), dice.choice(roles[: dice.choice([2, 5, 10])]), dice.choice(texts + [f"t{i}." for i in range(n)])) for _ in range(n)]


def test_repair_against_dijkstra(spark):  # noqa: ANN001
    """Short conversations of every kind of fault, and long ones over many blocks and partitions."""
    dice = random.Random(5)
    convs = {i: random_turns(dice, 1 + i % 9) for i in range(120)}
    convs |= {1000 + i: random_turns(dice, n) for i, n in enumerate((63, 64, 65, 200, 500))}
    convs[2000] = [(i, "user", f"question {i}.") for i in range(300)]  # one run of users
    convs[2001] = [(i, "user" if i % 2 == 0 else "assistant", f"fine {i}.") for i in range(400)]
    convs[2002] = [(1, "user", "same.")] * 150
    convs[2003] = [(1, "system", "s."), (2, "user", "long " * 50_000), (3, "assistant", "ok.")]
    convs[None] = [(1, "assistant", "a."), (2, "user", "b.")]
    check_repair(spark, convs)


def test_repair_of_nothing(spark):  # noqa: ANN001
    found = conversation_repair.repair(spark.createDataFrame([], TURNS))
    assert found.reports.collect() == found.turns.collect() == conversation_repair.digests(found.turns).collect() == []


def test_layers_by_their_definition():
    """Costs of a block from state to state, and walks of blocks, equal those of the whole."""
    dice = random.Random(3)
    for _ in range(200):
        codes = bytes(4 * dice.choice([0, 0, 1, 2]) + dice.randrange(4) for _ in range(dice.randrange(1, 9)))
        cut = dice.randrange(len(codes) + 1)
        a, b, whole = (conversation_repair.block_costs(x) if x else [0 if p == q else conversation_repair.FAR for p in range(4) for q in range(4)] for x in (codes[:cut], codes[cut:], codes))
        # Insertions between the parts belong to the second, so the product is the whole's.
        if cut < len(codes):
            assert whole == [min(min(a[4 * p + r] + b[4 * r + q] for r in range(4)), conversation_repair.FAR) for p in range(4) for q in range(4)]


def test_op12_registered_rows(spark, tmp_path):  # noqa: ANN001
    """Conversations that lose all their turns, and null ids, through the registered query."""
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} {t}.") for c in range(100, 160) for t in range(1 + c % 3)] + [(None, 0, "user", "x."), (None, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert set(got) == {*range(100, 160), None}
    left = {c: [] for c in got}
    for r in conversation_repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect():
        left[r.conv_id].append((r.turn, r.role, r.text))
    assert any(not x for x in left.values())
    for c, turns in left.items():
        cost, audit, out = repaired_by_hand([(r, x) for _, r, x in in_order(turns)])
        text = "\n".join(f"{a}:{b}" for a, b in out)
        assert (got[c].cost, got[c].audit, got[c].repaired_sha256) == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


# ---- concurrency ----


def test_tree_scan(spark):  # noqa: ANN001
    """An operation that does not commute, over numbers with gaps and several levels."""
    dice = random.Random(1)
    at = sorted(dice.sample(range(300_000), 700))
    blocks = spark.createDataFrame([(a, (f"{i},",)) for i, a in enumerate(at)], "at long, own struct<s:string>").repartition(7)
    got = {r.at: r.before for r in tree_scan.tree_scan(blocks, lambda a, b: F.struct(F.concat(a["s"], b["s"]).alias("s"))).collect()}
    assert [got[a].s if got[a] else "" for a in at] == ["".join(f"{j}," for j in range(i)) for i in range(len(at))]
    assert tree_scan.tree_scan(blocks.limit(0), lambda a, b: b).collect() == []


def peaks_by_hand(sales, lines, clients):  # noqa: ANN001, ANN201
    s = lambda x: (x - dt.datetime(1970, 1, 1)) // dt.timedelta(seconds=60) * 60
    nation, last, change = {}, {}, defaultdict(lambda: [0, 0])
    for c, n in clients:
        if c is not None and n is not None:
            nation[c] = min(n, nation.get(c, n))
    for i, at in lines:
        if i is not None and at is not None:
            last[i] = max(at, last.get(i, at))
    for i, c, total, at in sales:
        if at is None:
            continue
        start, end = s(at), s(last[i]) + 7 * 86400 if i in last else None
        cents = math.floor(100 * total + 0.5) if total is not None and math.isfinite(total) else 0
        if end is not None and end <= start:
            continue
        for n in (nation.get(c, -1), -2):
            for t, d in ((start, 1), (end, -1)):
                if t is not None:
                    change[n, t][0] += d
                    change[n, t][1] += d * cents
    moments = sorted((n, t, *d) for (n, t), d in change.items() if d != [0, 0])
    out, by = [], defaultdict(list)
    for n, t, dn, dc in moments:
        k, c, high = by[n][-1][2:5] if by[n] else (0, 0, None)
        by[n].append((n, t, k + dn, c + dc, max(k + dn, high) if high is not None else k + dn))
    for n, rows in by.items():
        for j, r in enumerate(rows):
            out.append((n, r[1], rows[j + 1][1] if j + 1 < len(rows) else None, r[2], r[3], r[4], r[2] == rows[-1][4]))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [1_000, 1, 20])
def test_peaks(spark, hot):  # noqa: ANN001
    """Times from before 1970 to far ahead (so that blocks are many levels apart), hot keys, nulls, repeated rows, totals that are no numbers."""
    dice = random.Random(hot)
    day = lambda spread: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=dice.uniform(0, spread * 86400))
    clients = [(c, dice.choice([None, 0, 1, 5, 24])) for c in range(30)] + [(None, 3), (29, 7)]
    sales = [(i, dice.choice([None, 7, 7, *range(35)]), dice.choice([None, float("nan"), float("inf"), 0.0, dice.uniform(-5, 500)]), dice.choice([None, *[day(9)] * 9])) for i in range(400)]
    sales += [(1000, 3, 5.0, dt.datetime(1969, 12, 31, 23, 59, 30)), (1001, 3, 1e17, dt.datetime(2290, 1, 1)), (None, 3, 2.0, day(1)), (5, 3, 1.0, day(1)), (5, 3, 1.0, day(1))]
    sales += [(2000 + i, 7, 1.0, day(0.5)) for i in range(200)]
    lines = [(dice.choice([None, 7, 7, *range(600)]), dice.choice([None, day(12), day(12) - dt.timedelta(days=8)])) for _ in range(900)] + [(1000, dt.datetime(1969, 12, 25)), (2001, dt.datetime(2023, 12, 20))]
    made = (
        spark.createDataFrame([(*r, "x", 1) for r in sales], "sale_id long, client_id long, total double, sold_at timestamp_ntz, nation_id string, n int"),
        spark.createDataFrame([(*r, 1) for r in lines], "sale_id long, shipped_at timestamp_ntz, end_s int"),
        spark.createDataFrame([(*r, "x") for r in clients], "client_id long, nation_id int, at string"),
    )
    got = concurrency.peak_concurrency(*made, hot_keys=hot).collect()
    # 1e17 in cents does not fit a long.
    want = peaks_by_hand([(i, c, None if t == 1e17 else t, at) for i, c, t, at in sales], lines, clients)
    assert sorted(map(tuple, got), key=str) == want
    assert concurrency.peak_concurrency(made[0].limit(0), *made[1:]).collect() == []
    assert concurrency.peak_concurrency(made[0], made[1].limit(0), made[2].limit(0), hot_keys=hot).where("to_s is null").count() == 2
