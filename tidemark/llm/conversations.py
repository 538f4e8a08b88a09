"""Conversation structure repair: the cheapest edits that give each conversation the roles ``(s?(ua)+)?``.

Rows of a conversation are a line of observations and the last role so far is the state (start, system, user,
assistant). Edits are kept in a tree of backpointers with counts of children: a branch without a survivor goes, and as
soon as all survivors share an ancestor, the edits up to it are emitted, so that a task holds the unresolved end only.
Equal costs are decided by the complete unresolved edits of both survivors, letter by letter; audits of one cost are
never prefixes of each other, and different states never have the same audit. Start and system are given up once they
cost so much more than a user or assistant state that no future can make them equal.

Rows are first counted by (conversation, turn, role, text), so repeated rows are one row with a count, and then dealt by
ranges of that key: a conversation of any size spreads over tasks. A task solves what lies within it. Where a conversation
reaches over its first or last row, it finds the costs between each two states and the order of their audits; these few
rows (two a task) are joined along the conversation, and the open stretches are solved between the states that this gives.

Defined results: a null role or text counts as one space, so a null text is blank; null ids are a conversation of their
own; null turns come first and count in no gap; rows of one turn are in order of role and text; a role is known by its
first character, and one that is no system, user or assistant is illegal, so it is changed or deleted; a conversation
without rows has zeros, an empty audit and the hash of nothing; an empty table gives an empty result; further columns are
not read. The audit and digest of a conversation are single values: report() streams the texts of a conversation that
spans tasks through one task, in order, holding its audit and nothing else; edits() doesn't.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import written

#: States, initials of known roles, costs of edits, and words of roles.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
KEEP, REROLE, INSERT, DELETE = 0, 2, 2, 3
ROLE = {USER: "user", ASSISTANT: "assistant"}
BLANKS = " \t\n\x0b\f\r"
#: States from which a user or an assistant may follow.
BEFORE = {USER: (START, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n) of the rows after damage by the hash of ``conv_id:turn``; n: 2 where one is repeated."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(part("text"), "[.!?]", "")).otherwise(part("text"))
    hurt = rows.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"))
    return hurt.where("kind != 0").select("conv_id", "turn", "role", "text", F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("n"))


def faults(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, text, n) with the first one's ``fault``: blank, duplicate (the role and text
    of an earlier turn), truncated, or empty. Of equal rows the others are blank or duplicates."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("name", F.sha2(F.concat_ws("\x00", "role", "text"), 256))
    order = F.struct(F.col("turn").isNotNull().alias("given"), F.col("turn").alias("turn"))
    last = F.substring(F.rtrim(F.col("text"), F.lit(BLANKS)), -1, 1)
    once = written(once.withColumn("at", order).withColumn("last", last))
    seen = once.where("last != ''").groupBy("conv_id", "name").agg(F.min("at").alias("first"), F.count("*").alias("turns")).where("turns > 1")
    seen = seen.select(F.col("conv_id").alias("_conv"), F.col("name").alias("_name"), "first")
    joined = once.join(seen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("name") == F.col("_name")), "left")
    fault = F.when(F.col("last") == "", "blank").when(F.col("at") > F.col("first"), "duplicate").when(~F.col("last").isin(".", "!", "?"), "truncated").otherwise("")
    return joined.select("conv_id", "turn", "role", "text", "n", fault.alias("fault"))


class Node:
    """What a branch does with one row: insertions, then the row's own letter. ``kids``: branches that go on from here."""

    __slots__ = ("above", "letters", "row", "state", "depth", "kids")

    def __init__(self, above: Node | None, letters: str, row: tuple | None, state: int):
        self.above, self.letters, self.row, self.state, self.kids = above, letters, row, state, []
        self.depth = 0 if above is None else above.depth + 1
        if above is not None:
            above.kids.append(self)


class Survivors:
    """The cheapest branch to each state, from one state on; push() takes rows in order, settled() gives what is decided."""

    def __init__(self, entry: int):
        self.root = Node(None, "", None, entry)
        self.best: dict[int, tuple[int, Node]] = {entry: (0, self.root)}

    @staticmethod
    def unresolved(x: Node, y: Node) -> tuple[list[str], list[str]]:
        """The letters of both branches, row by row, since they part."""
        ends, paths = [x, y], ([], [])
        while ends[0] is not ends[1]:
            k = 0 if ends[0].depth >= ends[1].depth else 1
            paths[k].append(ends[k].letters)
            ends[k] = ends[k].above
        return paths[0][::-1], paths[1][::-1]

    def less(self, x: tuple, y: tuple) -> bool:
        """Whether candidate x = (cost, branch, letters) comes before y: equal costs by all unresolved edits, to the last."""
        if x[0] != y[0]:
            return x[0] < y[0]
        one, other = self.unresolved(x[1], y[1])
        return [*one, x[2]] < [*other, y[2]]

    def take(self, found: dict[int, tuple], state: int, cost: int, branch: Node, letters: str) -> None:
        new = (cost, branch, letters)
        if state not in found or self.less(new, found[state]):
            found[state] = new

    def inserted(self) -> dict[int, tuple]:
        """Each state as it is or reached by insertions: one to the other role, two from the start or a system role."""
        found: dict[int, tuple] = {}
        for state, (cost, branch) in self.best.items():
            self.take(found, state, cost, branch, "")
            to = [USER, ASSISTANT] if state in (START, SYSTEM) else [USER + ASSISTANT - state]
            for n, other in enumerate(to, 1):
                self.take(found, other, cost + n * INSERT, branch, "I" * n)
        return found

    def push(self, row: tuple, initial: str, fault: str) -> None:
        found: dict[int, tuple] = {}
        ready = self.inserted()
        for state, (cost, branch, letters) in ready.items():
            self.take(found, state, cost + DELETE, branch, letters + "D")
        if fault not in ("blank", "duplicate"):
            extra = int(fault == "truncated")
            if initial == "s" and START in ready:
                cost, branch, letters = ready[START]
                self.take(found, SYSTEM, cost + KEEP + extra, branch, letters + "K")
            for to, before in BEFORE.items():
                letter, price = ("K", KEEP) if STATES.get(initial) == to else ("R", REROLE)
                for state in before:
                    if state in ready:
                        cost, branch, letters = ready[state]
                        self.take(found, to, cost + price + extra, branch, letters + letter)
        sure = min((found[s][0] for s in BEFORE if s in found), default=None)
        for state in (START, SYSTEM):  # whatever follows these, the others can follow with an insertion and a deletion more
            if sure is not None and state in found and found[state][0] > sure + INSERT + DELETE:
                del found[state]
        old = [branch for _, branch in self.best.values()]
        self.best = {state: (cost, Node(branch, letters, row, state)) for state, (cost, branch, letters) in found.items()}
        for node in old:  # a branch that nobody goes on from is given up, and so on upwards
            while not node.kids and node is not self.root:
                node.above.kids.remove(node)
                node = node.above

    def settled(self) -> Iterator[Node]:
        """Nodes that all survivors share, in order; they leave memory."""
        while len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.above = None
            yield self.root

    def close(self, state: int, letters: str = "") -> Iterator[Node]:
        """The rest of the branch to this state, and a last node of insertions."""
        node, line = self.best[state][1], []
        while node is not self.root:
            line.append(node)
            node = node.above
        yield from reversed(line)
        if letters:
            yield Node(None, letters, None, ASSISTANT)

    def end(self) -> tuple[int, int, str]:
        """Cost, state and last insertions of the best branch that makes a whole conversation."""
        ready = self.inserted()
        whole = [ready[s] for s in (START, ASSISTANT) if s in ready]
        best = whole[-1] if len(whole) == 1 or self.less(whole[1], whole[0]) else whole[0]
        return best[0], next(s for s, (_, n) in self.best.items() if n is best[1]), best[2]


#: Columns of what tasks find: edits, rows that stay open, links between tasks, whole conversations, and plans of open ends.
_FOUND = {
    "kind": pa.string(), "conv_id": None, "part": pa.int32(), "place": pa.int64(), "edit": pa.string(), "turn": None, "role": pa.string(), "text": pa.string(), "fault": pa.string(), "times": pa.int64(),
    "entry": pa.int32(), "exit": pa.int32(), "costs": pa.list_(pa.int64()), "ranks": pa.list_(pa.int32()), "illegal": pa.int64(), "first": pa.string(), "last": pa.string(), "cost": pa.int64(), "audit": pa.string(), "sha256": pa.string(),
}
_TEXT_ROWS = 500


def _schema(rows: DataFrame) -> str:
    kinds, names = dict(rows.dtypes), {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"{c} {names[t] if t else kinds[c]}" for c, t in _FOUND.items())


class _Out:
    """Rows for the caller, in batches of some hundred."""

    def __init__(self, like: pa.Schema):
        self.schema, self.rows = pa.schema([(c, t or like.field(c).type) for c, t in _FOUND.items()]), []

    def add(self, **values) -> None:
        self.rows.append(values)

    def full(self, least: int = _TEXT_ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.rows) >= least:
            yield pa.RecordBatch.from_pylist(self.rows, schema=self.schema)
            self.rows = []


def _opened(batches) -> tuple[_Out | None, Iterator[pa.RecordBatch]]:
    """Where to put what is found, with the types of the first batch, and all batches."""
    batches = iter(batches)
    head = next(batches, None)
    return (None, batches) if head is None else (_Out(head.schema), itertools.chain([head], batches))


class _Line:
    """Edits of one conversation as they settle: rows for the caller, the audit, and the digest of what is kept."""

    def __init__(self, out: _Out, conv, part: int, state: int = START):
        self.out, self.conv, self.part, self.state, self.place = out, conv, part, state, 0
        self.audit, self.sha, self.any = [], hashlib.sha256(), False

    def _edit(self, edit: str, turn, role: str | None, text: str | None, times: int = 1) -> None:
        self.out.add(kind="edit", conv_id=self.conv, part=self.part, place=self.place, edit=edit, turn=turn, role=role, text=text, times=times)
        self.place += 1
        self.audit.append(edit * times)
        if edit != "D":
            self.sha.update((("\n" if self.any else "") + f"{role}:{text}").encode())
            self.any = True

    def emit(self, node: Node) -> None:
        for letter in node.letters:
            if letter == "I":
                self.state = USER if self.state in (START, SYSTEM, ASSISTANT) else ASSISTANT
                self._edit("I", None, ROLE[self.state], "")
            else:
                turn, role, text, times, _ = node.row
                self.state = node.state
                self._edit(letter, turn, ROLE[self.state] if letter == "R" else role, text)
                if times > 1:
                    self._edit("D", turn, role, text, times - 1)


def _rows(batches, names: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, len(batch), _TEXT_ROWS):
            yield from zip(*(batch.column(n).slice(at, _TEXT_ROWS).to_pylist() for n in names), strict=True)


def _ordered(audits: dict[tuple[int, int], list[str]]) -> list[int | None]:
    """The place of each (entry, exit) in the order of audits, equal ones alike."""
    place = {tuple(a): k for k, a in enumerate(sorted({tuple(a) for a in audits.values()}))}
    return [place[tuple(audits[e, x])] if (e, x) in audits else None for e in range(4) for x in range(4)]


def _solve(batches):
    """What one task of rows in order finds. Its first conversation may have begun before: costs from each state. Any other
    begins here, so its edits are emitted as they settle; only the last one's end stays open."""

    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    out, batches = _opened(batches)
    if out is None:
        return
    names = ("conv_id", "turn", "role", "text", "n", "fault")
    conversations = itertools.groupby(_rows(batches, names), key=lambda r: r[0])
    waiting = None  # the conversation before, which isn't the last if another comes
    for k, (conv, rows) in enumerate(conversations):
        if waiting is not None:
            waiting["finish"](True)
            yield from out.full()
        trees = [Survivors(e) for e in range(4)] if k == 0 else [Survivors(START)]
        line, audits = _Line(out, conv, part), [[] for _ in trees]
        illegal, initial, first, more, at = 0, None, None, 0, 0
        for _, turn, role, text, n, fault in rows:
            now = role[:1]
            illegal += initial is not None and initial + now not in ("su", "ua", "au")
            illegal += n - 1
            first, initial = now if first is None else first, now
            more += DELETE * (n - 1)
            row = (turn, role, text, n, fault)
            for tree in trees:
                tree.push(row if k else None, now, fault)
            if k == 0:
                out.add(kind="open", conv_id=conv, part=part, place=at, turn=turn, role=role, text=text, fault=fault, times=n)
                at += 1
                for tree, audit in zip(trees, audits, strict=True):
                    audit.extend(node.letters for node in tree.settled())
            else:
                for node in trees[0].settled():
                    line.emit(node)
            yield from out.full()

        def finish(ended: bool, k=k, trees=trees, line=line, audits=audits, illegal=illegal, first=first, last=initial, more=more) -> None:
            common = {"conv_id": line.conv, "part": part, "illegal": illegal, "first": first, "last": last}
            if k and ended:
                cost, state, letters = trees[0].end()
                for node in trees[0].close(state, letters):
                    line.emit(node)
                out.add(kind="whole", cost=cost + more, audit="".join(line.audit), sha256=line.sha.hexdigest(), **common)
                return
            costs, paths = [None] * 16, {}
            for entry, (tree, audit) in enumerate(zip(trees, audits, strict=True)):
                for state, (cost, _) in tree.best.items():
                    costs[4 * entry + state] = cost + more
                    paths[entry, state] = [*audit, *(node.letters for node in tree.close(state))]
            out.add(kind="link", place=line.place, entry=trees[0].root.state if k else None, costs=costs, ranks=_ordered(paths), **common)
            if k:
                rest, node = [], next(iter(trees[0].best.values()))[1]
                while node is not trees[0].root:
                    rest.append(node.row)
                    node = node.above
                for turn, role, text, n, fault in reversed(rest):
                    out.add(kind="open", conv_id=line.conv, part=part, place=line.place, turn=turn, role=role, text=text, fault=fault, times=n)
                    line.place += 1

        waiting = {"finish": finish}
        if k == 0:
            finish(False)
            waiting["finish"] = lambda ended: None
    if waiting is not None:
        waiting["finish"](False)
    yield from out.full(1)


def _join(batches):
    """The states between tasks, for each conversation that may span some: its links in order, the cheapest way through
    them, equal ones by the order of their audits; then one plan a link and one whole row."""
    out, batches = _opened(batches)
    if out is None:
        return
    names = ("conv_id", "part", "place", "entry", "costs", "ranks", "illegal", "first", "last")
    for conv, rows in itertools.groupby(_rows(batches, names), key=lambda r: r[0]):
        best, back, links, illegal, before = {START: (0, 0)}, [], list(rows), 0, None
        for _, _, _, _, costs, ranks, wrong, first, last in links:
            illegal += wrong + (before is not None and before + first not in ("su", "ua", "au"))
            before, found = last, {}
            for state, (cost, order) in best.items():
                for x in range(4):
                    if costs[4 * state + x] is not None:
                        found[x] = min(found.get(x, (1 << 62,)), (cost + costs[4 * state + x], (order, ranks[4 * state + x]), state))
            place = {o: k for k, o in enumerate(sorted({o for _, o, _ in found.values()}))}
            best = {x: (cost, place[o]) for x, (cost, o, _) in found.items()}
            back.append({x: state for x, (_, _, state) in found.items()})
        letters = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
        cost, _, state = min((cost + INSERT * len(letters[x]), order, x) for x, (cost, order) in best.items())
        out.add(kind="whole", conv_id=conv, cost=cost, illegal=illegal)
        last = letters[state]
        for (_, part, place, entry, *_), came in zip(reversed(links), reversed(back), strict=True):
            begin = came[state]
            out.add(kind="plan", conv_id=conv, part=part, place=-1, times=place, entry=begin if entry is None else entry, exit=state, edit=last)
            state, last = begin, ""
        yield from out.full()
    yield from out.full(1)


def _solve_open(batches):
    """Edits of open rows between the states of their plan, which comes first."""
    out, batches = _opened(batches)
    if out is None:
        return
    names = ("conv_id", "part", "turn", "role", "text", "times", "fault", "entry", "exit", "edit")
    for (conv, part), rows in itertools.groupby(_rows(batches, names), key=lambda r: r[:2]):
        *_, begin, _, entry, leave, last = next(rows)
        tree, line = Survivors(entry), _Line(out, conv, part, entry)
        line.place = begin
        for _, _, turn, role, text, n, fault, *_ in rows:
            tree.push((turn, role, text, n, fault), role[:1], fault)
            for node in tree.settled():
                line.emit(node)
            yield from out.full()
        for node in tree.close(leave, last):
            line.emit(node)
        yield from out.full()
    yield from out.full(1)


def _digest(batches):
    """The audit and digest of each conversation from its edits in order."""
    out, batches = _opened(batches)
    if out is None:
        return
    names = ("conv_id", "edit", "times", "role", "text")
    for conv, rows in itertools.groupby(_rows(batches, names), key=lambda r: r[0]):
        audit, sha, begun = [], hashlib.sha256(), False
        for _, edit, times, role, text in rows:
            audit.append(edit * times)
            if edit != "D":
                sha.update((("\n" if begun else "") + f"{role}:{text}").encode())
                begun = True
        out.add(kind="whole", conv_id=conv, audit="".join(audit), sha256=sha.hexdigest())
        yield from out.full()
    yield from out.full(1)


def solved(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What tasks find in the rows of faults(), the plans of conversations that may span tasks, and the edits of their open rows; all stored."""
    schema, key = _schema(judged), ["conv_id", "turn", "role", "text"]
    ranges = judged.repartitionByRange(*(F.asc_nulls_first(c) for c in key)).sortWithinPartitions(*(F.asc_nulls_first(c) for c in key))
    found = written(ranges.select("conv_id", "turn", "role", "text", "n", "fault").mapInArrow(_solve, schema))
    plans = written(found.where("kind = 'link'").repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_join, schema))
    open_rows = found.where("kind = 'open'").unionByName(plans.where("kind = 'plan'")).repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "place")
    return found, plans, written(open_rows.mapInArrow(_solve_open, schema))


_EDIT = ["conv_id", "part", "place", "edit", "turn", "role", "text", "times"]


def edits(judged: DataFrame) -> DataFrame:
    """(conv_id, part, place, edit, turn, role, text, times) of rows of faults(): all edits, by part and place in order; K, R (with
    the new role), I (an empty text without a turn), and D as often as ``times`` says."""
    found, _, late = solved(judged)
    return found.where("kind = 'edit'").unionByName(late).select(*_EDIT)


def repaired(judged: DataFrame) -> DataFrame:
    """(conv_id, part, place, turn, role, text) of what is left of the rows of faults(), by part and place in order."""
    return edits(judged).where("edit != 'D'").drop("edit", "times")


def report(conversations: DataFrame, judged: DataFrame) -> DataFrame:
    """For each conversation of the first table: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256
    of its rows in the second, a stored table as faults() gives it."""
    n = F.col("n")
    alike = F.when(F.col("fault") == "blank", 0).when(F.col("fault") == "duplicate", n).otherwise(n - 1)
    counts = {"blank": F.sum(F.when(F.col("fault") == "blank", n).otherwise(0)), "duplicate": F.sum(alike), "truncated": F.count_if(F.col("fault") == "truncated")}
    turns = judged.groupBy("conv_id", "turn").agg(*(c.alias(k) for k, c in counts.items())).groupBy("conv_id")
    counted = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"), *(F.sum(k).alias(k) for k in counts))
    found, plans, late = solved(judged)
    spans = F.broadcast(found.where("kind = 'link'").select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part")))  # two a task at most
    settled = found.where("kind = 'edit'").join(spans, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), "left_semi")
    digests = settled.unionByName(late).repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").mapInArrow(_digest, _schema(judged))
    columns = ["conv_id", "cost", "illegal", "audit", "sha256"]
    whole = found.where("kind = 'whole'").select(*columns).unionByName(plans.where("kind = 'whole'").select(*columns)).unionByName(digests.select(*columns))
    parts = conversations.select("conv_id").distinct().unionByName(counted, allowMissingColumns=True).unionByName(whole, allowMissingColumns=True)
    longs = ["gaps", *counts, "illegal", "cost"]
    out = parts.groupBy("conv_id").agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in longs), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.max("sha256").alias("sha256"))
    return out.withColumn("repaired_sha256", F.coalesce("sha256", F.lit(hashlib.sha256().hexdigest()))).drop("sha256")


def damaged_report(conversations: DataFrame) -> DataFrame:
    """report() of all conversations after damaged()."""
    return report(conversations, written(faults(damaged(conversations))))
