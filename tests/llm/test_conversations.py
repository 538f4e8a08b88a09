import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import conversations
from tidemark.llm.store import written

BLANK = " \t\n\x0b\f\r"
FORMAT = "conv_id long, turn long, role string, text string, extra int"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else blank(role), "" if kind == 1 else blank(text)
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def marked(rows):
    """Rows of one conversation in order, with their first fault."""
    out, seen = [], set()
    for _, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode())):
        end = text.rstrip(BLANK)[-1:]
        out.append((turn, role, text, "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) and what is left, from all sequences of edits, states apart: plain strings are compared."""
    best = {"": (0, "", ())}

    def opened(best):
        found = dict(best)
        for _ in range(2):
            for s, (c, a, kept) in list(found.items()):
                to = "a" if s == "u" else "u"
                found[to] = min(found.get(to, (10**9, "", ())), (c + 2, a + "I", (*kept, ({"u": "user", "a": "assistant"}[to], ""))))
        return found

    for _, role, text, fault in rows:
        new, ready = {}, opened(best)

        def take(s, value, new=new):
            new[s] = min(new.get(s, (10**9, "", ())), value)

        for s, (c, a, kept) in ready.items():
            take(s, (c + 3, a + "D", kept))
            if fault in ("blank", "duplicate"):
                continue
            more = int(fault == "truncated")
            if s == "" and role[:1] == "s":
                take("s", (c + more, a + "K", (*kept, (role, text))))
            to = "a" if s == "u" else "u"
            if role[:1] == to:
                take(to, (c + more, a + "K", (*kept, (role, text))))
            else:
                take(to, (c + 2 + more, a + "R", (*kept, ({"u": "user", "a": "assistant"}[to], text))))
        best = new
    ready = opened(best)
    return min(ready[s] for s in ("", "a") if s in ready)


def brute(conv, rows):
    m = marked(rows)
    turns = [t for t, *_ in m if t is not None]
    kinds = [f for *_, f in m]
    cost, audit, kept = cheapest(m)
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(m, m[1:], strict=False)]
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())


def expected(rows, damaged):
    by = {}
    for r in damaged:
        by.setdefault(r[0], []).append(r)
    return sorted((brute(c, by.get(c, [])) for c in {r[0] for r in rows}), key=str)


def made(seed, n_conversations, longest):
    rng, rows = random.Random(seed), []
    for c in [*range(n_conversations), None]:
        for _ in range(rng.randint(1, longest)):
            turn = rng.choice([None, *range(12 * longest)])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "ué"])
            text = rng.choice(["Yes.", "No!", "why", "", " \t\n", "é?", "end. \n", None, "x" * 3000 + ".", f"t{rng.random()}."])
            rows.append((c, turn, role, text))
        rows += rng.sample(rows, min(2, len(rows)))
    return rows


@pytest.mark.parametrize("seed, n, longest, parts", [(1, 60, 9, "8"), (2, 3, 150, "8"), (3, 400, 3, "3"), (4, 1, 400, "12")])
def test_report_matches_brute_force(spark, seed, n, longest, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables would meet in one task
    try:
        rows = made(seed, n, longest)
        got = conversations.damaged_report(spark.createDataFrame([(*r, 1) for r in rows], FORMAT)).collect()
        assert sorted(map(tuple, got), key=str) == expected(rows, damage(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_table_and_conversation_without_rows(spark):
    empty = spark.createDataFrame([], FORMAT)
    assert conversations.damaged_report(empty).collect() == []
    rows = [(c, t, "user", "Hm.") for c in range(60) for t in [0]]
    got = {r.conv_id: r for r in conversations.damaged_report(spark.createDataFrame([(*r, 1) for r in rows], FORMAT)).collect()}
    gone = {r[0] for r in rows} - {r[0] for r in damage(rows)}
    assert gone and all(tuple(got[c])[1:7] == (0,) * 6 and got[c].audit == "" and got[c].repaired_sha256 == hashlib.sha256().hexdigest() for c in gone)


def test_edits_and_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "assistant", "Hello."), (1, 3, "user", "Bye.")]
    once = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, n long")
    judged = written(conversations.faults(once))
    left = [(r.role, r.text) for r in conversations.repaired(judged).orderBy("part", "place").collect()]
    cost, audit, kept = cheapest(marked(rows))
    assert left == list(kept) and "".join(r.edit * r.times for r in conversations.edits(judged).orderBy("part", "place").collect()) == audit
    assert cost == 2 + 3 + 2


def test_memory_is_the_unresolved_end():
    tree = conversations.Survivors(conversations.START)
    held = out = 0
    for k in range(20_000):
        tree.push((k, "user" if k % 2 == 0 else "assistant", "x.", 1, ""), "ua"[k % 2], "")
        out += sum(1 for _ in tree.settled())
        held = max(held, k + 1 - out)
    assert held <= 4 and len(list(tree.close(tree.end()[1]))) <= 4


def test_long_ties_are_compared_to_the_end():
    rng = random.Random(5)
    for _ in range(200):
        rows = [(k, rng.choice("tsua"), "x", rng.choice(["", "truncated", "blank"])) for k in range(rng.randint(0, 60))]
        tree, letters = conversations.Survivors(conversations.START), []
        for turn, role, text, fault in rows:
            tree.push((turn, role, text, 1, fault), role, fault)
            letters += [n.letters for n in tree.settled()]
        cost, state, last = tree.end()
        letters += [n.letters for n in tree.close(state, last)]
        assert (cost, "".join(letters)) == cheapest(rows)[:2]


def test_one_conversation_with_most_rows_spans_tasks(spark):
    rows = [(7 if k % 3 else k, k, ["user", "assistant"][k % 2], f"t{k % 977}.") for k in range(6000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], FORMAT)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        judged = written(conversations.faults(conversations.damaged(df)))
        found, _, _ = conversations.solved(judged)
        per_task = found.where("kind in ('open', 'edit')").groupBy("part").agg(F.count("*").alias("n"), F.count_if(F.col("conv_id") == 7).alias("hot")).collect()
        assert len([r for r in per_task if r.hot]) >= 3 and max(r.n for r in per_task) < len(rows) / 2
        got = sorted(map(tuple, conversations.report(df, judged).collect()), key=str)
        assert got == expected(rows, damage(rows))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
