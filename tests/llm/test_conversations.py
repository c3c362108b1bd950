"""Repaired conversations against an enumeration of all edits."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from filingframe.llm import conversations as C
from filingframe.llm.queries import QUERIES

SCHEMA = "conversation long, turn long, role string, content string, place string, summary string"


def sentences(n):
    """Role initials of all good conversations of at most ``n`` turns."""
    return {s + "ua" * k for s in ("", "s") for k in range(n // 2 + 1) if len(s) + 2 * k <= n and (k or not s)}


def cheapest(turns, inserts=3):
    """(cost, audit, initials) by trying every edit of every turn and up to ``inserts`` insertions."""
    best, good = None, sentences(len(turns) + inserts)
    options = []
    for initial, delete_only, unfinished in turns:
        stay = 5 if unfinished else 0
        kept = [(stay, "K", initial)] if initial else []
        options.append([(2, "D", "")] + ([] if delete_only else [*kept, (1 + stay, "R", "u"), (1 + stay, "R", "a")]))
    for chosen in itertools.product(*options):
        for k in range(inserts + 1):
            for slots in itertools.combinations_with_replacement(range(len(turns) + 1), k):
                for given in itertools.product("ua", repeat=k):
                    steps = []
                    for i in range(len(turns) + 1):
                        steps += [(5, "I", g) for s, g in zip(slots, given, strict=True) if s == i]
                        steps += [chosen[i]] if i < len(turns) else []
                    if "".join(s[2] for s in steps) in good:
                        found = sum(s[0] for s in steps), "".join(s[1] for s in steps), "".join(s[2] for s in steps)
                        best = min(best or found, found)
    return best


@pytest.mark.parametrize("seed", range(60))
def test_cheapest_edits(seed):
    rng = random.Random(seed)
    turns = [(rng.choice("suuaax"), rng.random() < 0.15, rng.random() < 0.2) for _ in range(rng.randint(0, 4))]
    repair = C.Repair(C.automaton())
    for t in turns:
        repair.read(*t)
    assert repair.end() == cheapest(turns)[:2]


@pytest.mark.parametrize("seed", range(8))
def test_settling_changes_nothing(seed):
    rng = random.Random(seed)
    whole, parts, total, edits = C.Repair(C.automaton()), C.Repair(C.automaton()), 0, ""
    for i in range(300):
        t = rng.choice("suuaax"), rng.random() < 0.1, rng.random() < 0.2
        whole.read(*t)
        parts.read(*t)
        if i % 7 == 0:
            cost, done = parts.settle()
            total, edits = total + cost, edits + done
    cost, done = parts.end()
    assert whole.end() == (total + cost, edits + done)


def summary(turns):
    """Counts of a conversation by the stated rules, and its rows for the repair."""
    rows = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).digest()))
    seen, faults, steps = set(), [], []
    for _, role, content in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", content)
        fault = "blank" if not words else "duplicate" if (role, content) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, content))
        faults.append(fault)
        steps.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    numbers = [t[0] for t in rows if t[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return [gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal], rows, steps


def repaired(rows, audit, initials):
    out, at, shown = [], 0, iter(initials)
    for edit in audit:
        row = None if edit == "I" else rows[at]
        at += edit != "I"
        if edit == "D":
            continue
        initial = next(shown)
        out.append((edit, row[1] if edit == "K" else {"u": "user", "a": "assistant"}[initial], "" if row is None else row[2]))
    return out


def made(seed, n):
    rng = random.Random(seed)
    words = ["Yes.", "no", " ", "", "Why?", "and so on", "Well!\n", "x", "한국어.", "The end. "]
    return [(rng.choice([None, *range(6)]), rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(words)) for _ in range(n)]


def test_conversations(spark):
    talks = {i: made(i, i % 6) for i in range(60)} | {None: made(99, 5), 1000: [(3, "user", "Yes.")] * 4, 1001: [(None, "user", "a."), (None, "assistant", "b.")]}
    rows = [(c, *t, "p", "s") for c, turns in talks.items() for t in turns]
    found = C.repair_conversations(spark.createDataFrame(rows, SCHEMA).repartition(5))
    digests = {r["conversation"]: r for r in C.digest_conversations(found).collect()}
    turns = {}
    for r in found.where("place is not null").collect():
        turns.setdefault(r["conversation"], {})[r["place"]] = (r["edit"], r["role"], r["content"])
    assert set(digests) == {c for c, t in talks.items() if t}
    assert {r["conversation"]: r["audit"] for r in C.summaries(found).collect()} == {c: d["audit"] for c, d in digests.items()}
    for c, d in digests.items():
        counts, ordered, steps = summary(talks[c])
        cost, audit, initials = cheapest(steps, inserts=2)
        want = repaired(ordered, audit, initials)
        assert [d[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal")] == counts, talks[c]
        assert (d["cost"], d["audit"]) == (cost, audit), talks[c]
        assert [turns.get(c, {})[i] for i in range(len(want))] == want
        assert d["sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in want).encode()).hexdigest()


def test_null_fields_and_empty_table(spark):
    rows = [(1, 0, None, "Hello."), (1, 1, "assistant", None), (1, 2, "assistant", "Good.")]
    found = C.summaries(C.repair_conversations(spark.createDataFrame(rows, "conversation long, turn long, role string, content string"))).collect()
    assert [(r["blank"], r["illegal"], r["cost"], r["audit"]) for r in found] == [(1, 2, 3, "RDK")]
    assert C.digest_conversations(C.repair_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_long_conversation(spark):
    """All turns in one conversation: memory holds its open part only, the result is that of the parts."""
    rows = spark.range(20_000).select(
        F.lit(1).alias("conversation"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        F.when(F.col("id") == 7, "").otherwise(F.concat(F.lit("turn "), F.col("id").cast("string"), F.lit("."))).alias("content"),
    )
    (found,) = C.digest_conversations(C.repair_conversations(rows)).collect()
    assert (found["blank"], found["cost"], len(found["audit"]), found["audit"].count("D")) == (1, 4, 20_000, 2)
    assert found["audit"][6:9] in ("DDK", "KDD")


def test_all_turns_dropped(spark, tmp_path):
    """A conversation of which nothing is left still has a row."""
    import zlib

    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hello."), (None, None, "user", None)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    rows = {r["conv_id"]: r for r in QUERIES["op13_conversations"](spark, str(tmp_path)).collect()}
    assert set(rows) == {gone, None}
    assert tuple(rows[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
