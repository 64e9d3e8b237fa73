"""Conversation repair against a plain dynamic program over each conversation, and against every
possible edit of small ones."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from terrace.llm import conversations as cv
from terrace.llm import queries as registered

FOLDER = "/root/testdata/sf0.01"
LEGAL = re.compile(r"(s?(ua)+)?\Z")


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """(cost, audit, lines) of a conversation: the least (cost, audit) for each string's state, turn by turn."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    name = {"u": "user", "a": "assistant"}

    def inserted(ways):
        for _ in range(3):
            for state, (cost, audit, lines) in list(ways.items()):
                for role in name:
                    if role in after[state]:
                        new = (cost + 5, audit + "I", (*lines, name[role] + ":"))
                        ways[role] = min(ways.get(role, new), new)
        return ways

    ways = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, brute_faults(rows), strict=True):
        new = {}
        for state, (cost, audit, lines) in ways.items():
            options = [(state, (cost + 2, audit + "D", lines))]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                options += [(role[:1], (cost + more, audit + "K", (*lines, f"{role}:{text}")))] if role[:1] in after[state] else []
                options += [(r, (cost + 1 + more, audit + "R", (*lines, f"{name[r]}:{text}"))) for r in name if r in after[state]]
            for to, way in options:
                new[to] = min(new.get(to, way), way)
        ways = inserted(new)
    return min(ways[s] for s in ("", "a") if s in ways)


def brute(rows):
    """The whole row of a conversation: rows (turn, role, text) in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, (cost, audit, lines) = brute_faults(rows), brute_repair(rows)
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute_damage(rows):
    out = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        shown = [" " if x is None else x for x in (conv, turn, role, text)]
        lot, (role, text) = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20, shown[2:]
        kept = out[conv]
        if lot:
            text = {1: "", 2: re.sub("[.!?]", "", text)}.get(lot, text)
            kept += [(turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def told(repaired):
    """{conv_id: the query's row} of a repair."""
    hashed = {r.conv_id: r.repaired_sha256 for r in cv.digests(repaired.chunks).collect()}
    rows = repaired.summary.collect()
    assert len(rows) == len(hashed) == len({r.conv_id for r in rows})
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, hashed[r.conv_id]) for r in rows}


def test_dynamic_program_against_every_edit():
    """All audits of up to two insertions at each place, spelt out, on every small conversation."""
    rows = {"s": (0, "system", "Hi."), "u": (0, "user", "Yes."), "a": (0, "assistant", "No."), "t": (0, "user", "cut"), "b": (0, "user", " "), "x": (0, "tool", "Out.")}
    for kinds in itertools.chain.from_iterable(itertools.product(rows, repeat=n) for n in range(3)):
        some = [(0, rows[k][1], rows[k][2].replace(".", f" {i}.") if k != "t" else f"cut {i}") for i, k in enumerate(kinds)]
        faults, best = brute_faults(some), None
        for ins in itertools.product(("", "u", "a", "ua", "au"), repeat=len(some) + 1):
            for ops in itertools.product("KuaD", repeat=len(some)):
                cost, audit, initials = 5 * len(ins[0]), "I" * len(ins[0]), ins[0]
                for (_, role, _), fault, op, more in zip(some, faults, ops, ins[1:], strict=True):
                    if op != "D" and fault in ("blank", "duplicate"):
                        break
                    cost += {"K": 0, "D": 2}.get(op, 1) + (5 if fault == "truncated" and op != "D" else 0) + 5 * len(more)
                    audit += (op if op in "KD" else "R") + "I" * len(more)
                    initials += ("" if op == "D" else role[0] if op == "K" else op) + more
                else:
                    if LEGAL.match(initials):
                        best = min(best or (cost, audit), (cost, audit))
        assert best == brute_repair(some)[:2]
        spans = [cv._span_of(0, r[:1], f) for (_, r, _), f in zip(some, faults, strict=True)]
        assert cv.cheapest(cv.joined_spans(spans).matrix) == best


def test_products_are_associative():
    draw = random.Random(3)
    for _ in range(200):
        m = [cv.turn_matrix(draw.choice("suax"), draw.random() < 0.2, draw.random() < 0.2) for _ in range(7)]
        left = m[0]
        for x in m[1:]:
            left = cv.product(left, x)
        right = m[-1]
        for x in m[-2::-1]:
            right = cv.product(x, right)
        assert left == right == cv.product(cv.product(cv.product(m[0], m[1]), cv.product(m[2], m[3])), cv.product(m[4], cv.product(m[5], m[6])))


def made(spark):
    draw = random.Random(5)
    texts = ["Yes.", "No!", "cut", "", " \t\n", "So?", "Long " * 40 + ".", "漢字。", "é.", "a.\n"]
    roles = ["system", "user", "assistant", "tool", "", "User", None]
    rows = [(c, draw.choice([None, *range(9)]), draw.choice(roles), draw.choice([*texts, None])) for c in range(60) for _ in range(draw.randrange(9))]
    rows += [(None, i, "user", "Same text.") for i in range(5)]
    # One conversation of a third of all rows, many of one text, over many chunks.
    rows += [(7, i % 800, draw.choice(roles[:3]), draw.choice([f"Text {i}.", "Same text.", "cut", "Once more?"])) for i in range(1200)]
    rows += [(900, 0, "user", "word " * 300_000 + "."), (900, 1, "assistant", "Yes."), (901, None, None, None)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), rows


def test_edges_against_brute_force(spark):
    df, rows = made(spark)
    got = told(cv.repair(df.withColumns({c: F.lit("x") for c in ("part", "chunk", "audit", "kind", "copies", "head")}).repartition(7)))
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    assert got == {c: brute(some) for c, some in by.items()}


def test_partition_borders_do_not_matter(spark):
    """Chunks of three turns over many partitions: spans meet in a tree of several levels."""
    df, rows = made(spark)
    kept = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled"]
    before = {k: spark.conf.get(k) for k in kept}
    try:
        spark.conf.set(kept[0], "23")
        spark.conf.set(kept[1], "false")
        repaired = cv.repair(df, chunk_turns=3, fan=2)
        assert repaired.chunks.select("part").distinct().count() > 8
        got = told(repaired)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, " " if r is None else r, " " if x is None else x))
    assert got == {c: brute(some) for c, some in by.items()}


def test_repaired_turns_are_legal(spark):
    df, _ = made(spark)
    lines = collections.defaultdict(list)
    for r in cv.repair(df).turns().orderBy("part", "chunk", "at").collect():
        lines[r.conv_id].append(r)
    for some in lines.values():
        assert LEGAL.match("".join(r.role[0] for r in some)) and all(r.text == "" for r in some if r.edit == "I")


def test_empty_table(spark):
    repaired = cv.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    assert told(repaired) == {}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")
def test_op11(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{FOLDER}/conversations.parquet'").fetchall()
    expected = {c: brute(some) for c, some in brute_damage(rows).items()}
    got = registered.queries()["op11_conversation_repair"](spark, FOLDER)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == expected and len(expected) == len({r[0] for r in rows})
