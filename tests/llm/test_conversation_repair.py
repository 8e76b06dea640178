"""Conversation repair: equal to a search over all edits, blocks, long conversations, edge cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lathe.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, conv int, n int"
SOUND = re.compile("(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 7, 7) for r in rows], SCHEMA)


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, role, text)] * (2 if fault == 3 else 1)
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        rest = text.strip(SPACES)
        out.append("b" if not rest else "d" if (role, text) in seen else "t" if rest[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def edits(rows, flaws):
    """Cheapest edits: costs of prefixes by the initials' state, audits kept as strings."""
    follow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    to = follow.get((state, role[0]))
                    if to:
                        new = (cost + 3, audit + "I", [*turns, f"{role}:"])
                        best[to] = min(best.get(to, (10**9,)), new, key=lambda b: b[:2])
        return best

    best = inserted({"": (0, "", [])})
    for (_, _, role, text), flaw in zip(rows, flaws, strict=True):
        after = {}
        for state, (cost, audit, turns) in best.items():
            ways = [(state, cost + 4, "D", [])]
            if flaw not in ("b", "d"):
                late = 3 * (flaw == "t")
                ways.append((follow.get((state, role[:1])), cost + late, "K", [f"{role}:{text}"]))
                ways += [(follow.get((state, r[0])), cost + 3 + late, "R", [f"{r}:{text}"]) for r in ("user", "assistant")]
            for to, price, letter, put in ways:
                if to is not None:
                    after[to] = min(after.get(to, (10**9,)), (price, audit + letter, turns + put), key=lambda b: b[:2])
        best = inserted(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda b: b[:2])


def brute(rows, ids):
    out = {}
    for conv in ids:
        own = order([r for r in rows if r[0] == conv])
        flaws = faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        cost, audit, put = edits(own, flaws)
        legal = {"su", "ua", "au"}
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(flaws.count(f) for f in "bdt"),
            sum(a[2][:1] + b[2][:1] not in legal for a, b in itertools.pairwise(own)),
            cost,
            audit,
            hashlib.sha256("\n".join(put).encode()).hexdigest(),
        )
    return out


def answers(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


def made(rng, convs, longest):
    texts = ["Yes.", "No", "Why?", " \t", "", "Go on!\n", "and", "well. ", None]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(rng.randint(1, longest)):
            if rng.random() < 0.6:
                role, text = ("user", "assistant")[turn % 2], f"Turn {turn}" + rng.choice([".", "!", "", " "])
            else:
                role, text = rng.choice(roles), rng.choice(texts)
            rows += [(conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return rows


def test_cheapest_edits_by_trying_all():
    """The state costs against all sequences of edits of short conversations."""
    for initials in itertools.chain.from_iterable(itertools.product("suax", repeat=n) for n in range(4)):
        rows = [(1, i, c, f"{i}.") for i, c in enumerate(initials)]
        found = []

        def tried(i, roles, cost, audit, rows=rows, found=found):
            if cost > 12:
                return
            if i == len(rows) and SOUND.fullmatch(roles):
                found.append((cost, audit))
            if audit.count("I") < 4:
                for r in "ua":
                    tried(i, roles + r, cost + 3, audit + "I")
            if i < len(rows):
                tried(i + 1, roles, cost + 4, audit + "D")
                tried(i + 1, roles + rows[i][2], cost, audit + "K")
                for r in "ua":
                    tried(i + 1, roles + r, cost + 3, audit + "R")

        tried(0, "", 0, "")
        assert min(found) == edits(rows, [""] * len(rows))[:2]


@pytest.mark.parametrize("block", [3, 65_536])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = made(random.Random(4), 150, 14)
    table = frame(spark, rows)
    hurt = cr.damage(table)
    assert sorted(map(repr, (tuple(r) for r in hurt.collect()))) == sorted(map(repr, damaged(rows)))
    assert answers(cr.repair(hurt, every=table)) == brute(damaged(rows), [*range(150), None])


def test_one_giant_conversation(spark, monkeypatch):
    """A conversation across many batches and blocks, with a row repeated a thousand times."""
    monkeypatch.setattr(cr, "BLOCK", 100)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        rng = random.Random(5)
        rows = [(1, t, rng.choice(["user", "assistant", "assistant"]), f"{t}" + rng.choice([".", ""])) for t in range(3000)]
        rows += [(1, 40, "user", "Again.")] * 1000 + [(2, 0, "system", "Only.")]
        assert answers(cr.repair(frame(spark, rows))) == brute(rows, [1, 2])
        turns = {(r.conv_id, r.position): f"{r.role}:{r.text}" for r in cr.repaired(frame(spark, rows)).collect()}
        put = edits(order([r for r in rows if r[0] == 1]), faults(order([r for r in rows if r[0] == 1])))[2]
        assert [turns[1, i + 1] for i in range(len(put))] == put
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_no_rows_left_and_empty(spark):
    table = frame(spark, [(5, 1, "user", "Hi.")])
    got = answers(cr.repair(table.where("false"), every=table))
    assert got == {5: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert cr.repair(table.where("false"), every=table.where("false")).count() == 0
    assert cr.repaired(table.where("false")).count() == 0


def test_far_turns(spark):
    rows = [(1, -(2**63), "user", "a."), (1, 2**63 - 1, "assistant", "b.")]
    assert answers(cr.repair(frame(spark, rows)))[1][0] == 2**63 - 1


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    assert answers(cr.repair(cr.damage(table), every=table)) == brute(damaged(rows), {r[0] for r in rows})
    assert table.select(F.countDistinct("conv_id")).first()[0] == cr.repair(cr.damage(table), every=table).count()
