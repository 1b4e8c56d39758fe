"""Conversation repair against every possible edit, over pieces of any size, and odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import turns as t

TURNS = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def all_repairs(rows):
    """(cost, audit, lines) of every sequence of edits of (role, text, fault) rows with at most two inserted turns in a place."""
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    out = []

    def go(i, cost, audit, lines):
        for ins in inserts:
            c, a, new = cost + 3 * len(ins), audit + "I" * len(ins), lines + [(r, "") for r in ins]
            if i == len(rows):
                out.append((c, a, new))
                continue
            role, text, fault = rows[i]
            go(i + 1, c + 4, a + "D", new)
            if fault not in (t.BLANK, t.DUPLICATE):
                own = 3 * (fault == t.CUT)
                go(i + 1, c + own, a + "K", [*new, (role, text)])
                for other in ("user", "assistant"):
                    go(i + 1, c + 3 + own, a + "R", [*new, (other, text)])

    go(0, 0, "", [])
    return min((c, a, [f"{r}:{x}" for r, x in lines]) for c, a, lines in out if GOOD.fullmatch("".join(r[:1] or "?" for r, _ in lines)))


@pytest.mark.parametrize("seed", range(12))
def test_cheapest_of_all_edits(seed):
    rng = random.Random(seed)
    for n in (0, 1, 2, 3):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", "use"]), f"t{i}", rng.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]
        cost, audit, lines = all_repairs(rows)
        pairs = [(r[:1], f) for r, _, f in rows]
        assert t.ended(t.transfer(pairs, t.NOTHING)) == (cost, audit)
        assert t.repaired(audit, [(r, x) for r, x, _ in rows], t.NOTHING)[0] == lines


def test_audits_of_one_cost_and_role_are_no_prefixes():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(rng.choice("suatx"), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 9))]
        for before in t.STATES:
            audits = [a for _, a in t.transfer(rows, before).values()]
            assert len({a.replace("I", "") and len(a.replace("I", "")) for a in audits}) == 1 and not any(a.endswith("I") for a in audits)
            assert not any(x != y and y.startswith(x) for x, y in itertools.permutations(audits, 2))


def by_hand(rows):
    """RESULT of the contract for rows (conv_id, turn, role, text), in plain Python."""
    ids = {r[0] for r in rows}
    show = lambda x: " " if x is None else str(x)
    out = []
    for conv in ids:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = show(role), show(text)
            d = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
            text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
            after += [(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        faults, seen = [], set()
        for _, role, text in after:
            bare = text.strip(t.WHITE)
            faults.append(t.BLANK if not bare else t.DUPLICATE if (role, text) in seen else t.FINE if bare[-1] in ".!?" else t.CUT)
            seen.add((role, text))
        numbers = [x[0] for x in after if x[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(x[1][:1] + y[1][:1] not in t.LEGAL for x, y in itertools.pairwise(after))
        cost, audit = t.ended(t.transfer([(r[1][:1], f) for r, f in zip(after, faults, strict=True)], t.NOTHING))
        lines, _ = t.repaired(audit, [r[1:] for r in after], t.NOTHING)
        assert GOOD.fullmatch("".join(x[:1] for x in lines))
        out.append((conv, gaps, faults.count(t.BLANK), faults.count(t.DUPLICATE), faults.count(t.CUT), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(seed=1):
    rng = random.Random(seed)
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None, ""]
    say = lambda: rng.choice(["Yes.", "No", "Why? ", "", " \t", None, f"It's {rng.randrange(50)}!", "é日𓀀.", "word " * 2000 + "."])
    rows = [(c, turn, rng.choice(roles), say()) for c in range(60) for turn in range(rng.randrange(1, 9))]
    rows += [(70, x, "user", f"a{i}.") for i, x in enumerate([None, None, 5, 5, 9])] + [(None, 1, "user", "hi."), (None, None, "assistant", "oh.")]
    rows += [(71, 3, "user", "same.")] * 4 + [(72, i * 3, "user" if i % 2 == 0 else "assistant", f"long {i % 190}.") for i in range(900)]
    rows += [(73, k, "user", "gone.") for k in range(400) if zlib.crc32(f"73:{k}".encode()) % 20 == 0]
    return rows


@pytest.mark.parametrize("most", [1, 7, 4096])
def test_conversations_over_several_pieces(spark, most):
    rows = rows_of()
    table = spark.createDataFrame(rows, TURNS).withColumn("audit", F.lit("clashes")).repartition(5)
    got = t.repair(t.damaged(table), most)
    assert got.columns == [x.split()[0] for x in t.RESULT.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == by_hand(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], f"x{i * i % 977}{'.' * (i % 5 > 0)}") for i in range(3000)] + [(2, 0, "user", "a."), (3, 0, "assistant", "b.")]
    table = t.damaged(spark.createDataFrame(rows, TURNS).repartition(8))
    found = t.pieces(table, 500)
    sizes = [r.n for r in found.where("conv_id = 1").selectExpr("size(roles) AS n").collect()]
    assert max(sizes) <= 500 and sum(sizes) == table.where("conv_id = 1 AND NOT gone").count()
    assert sorted((tuple(r) for r in t.repair(table, 500).collect()), key=repr) == by_hand(rows)


def test_query(spark, tmp_path):
    rows = rows_of(2)
    spark.createDataFrame(rows, TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((tuple(r) for r in t.op12_turn_repair(spark, str(tmp_path)).collect()), key=repr) == by_hand(rows)


def test_no_conversations(spark, tmp_path):
    spark.createDataFrame([], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    assert t.op12_turn_repair(spark, str(tmp_path)).collect() == []
