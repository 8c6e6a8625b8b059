"""Faults in the structure of logged conversations, and the cheapest edits that mend it.

The edits of a conversation are paths through a small graph: a node is a place between rows and a state of the role grammar
``(s?(ua)+)?``; keeping, changing, deleting a row and inserting a turn are arcs with small whole costs. Dial's bucket queue settles
the distance of every node to the end; a walk that takes the least letter among the tight arcs then spells the audit.

Rows are sorted by range, so a long conversation is spread over many tasks. A task finishes what lies within its rows. A
conversation that goes on in another task, or over more than a block, is cut into blocks of ``BLOCK`` rows: each gives the
distances between its states, these are added up from the last block to the first, then each block walks with the distances
ahead of it. Only the digest, one for a conversation by definition, is taken row by row in one task, which holds one block at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import discard, materialize

#: Rows and characters at which a block ends.
BLOCK, CHARS = 1_024, 1 << 20

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. The state after a role's initial; what an inserted or changed turn can be.
STATES = range(4)
AFTER = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
NEW = ["user", "user", "assistant", "user"]
NEXT = [AFTER[q][role[0]] for q, role in enumerate(NEW)]
FAR = 1 << 50
#: Distances to the end where no row is left.
END = [0, FAR, FAR, 0]
LEGAL = {"su", "ua", "au"}
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, tie, role, text and copies: the rows after damage, how often each is there; dropped ones 0 times."""
    kind = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", kind.alias("kind"), F.when(kind == 4, "user").otherwise(text_of("role")).alias("role"), text_of("text").alias("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", "role", text.alias("text"), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"))
    tie = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return rows.withColumn("tie", tie)


def marked(rows: DataFrame) -> DataFrame:
    """One row for each conv_id, turn and tie, with its copies and whether none before it has its role and text."""
    live = rows.where("copies > 0").groupBy("conv_id", "tie").agg(F.max(F.col("turn").isNull()).alias("without"), F.min("turn").alias("least"))
    earliest = live.select("conv_id", F.when(~F.col("without"), F.col("least")).alias("turn"), "tie", F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("copies"), F.lit(1).alias("is_first"))
    both = rows.select("conv_id", "turn", "tie", "role", "text", "copies", F.lit(0).alias("is_first")).unionByName(earliest)
    merged = both.groupBy("conv_id", "turn", "tie").agg(F.first("role", True).alias("role"), F.first("text", True).alias("text"), F.sum("copies").alias("copies"), F.max("is_first").alias("is_first"))
    space = r"\x20\x09-\x0D"
    blank = ~F.col("text").rlike(f"[^{space}]")
    # 0: has to go, 1: sound, 2: truncated
    state = F.when(blank | (F.col("is_first") == 0), 0).when(F.col("text").rlike(rf"[.!?][{space}]*\z"), 1).otherwise(2)
    return merged.select("conv_id", "turn", "tie", "role", "text", "copies", blank.alias("blank"), state.alias("state"))


class Block:
    """Rows of one conversation that follow each other."""

    def __init__(self) -> None:
        self.initials: list[str] = []  # of rows that may stay
        self.cut: list[bool] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.gone = [0]  # rows that have to go before each row that may stay, and after the last
        self.rows = self.chars = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.least = self.most = None

    def add(self, turn, role: str, text: str, copies: int, blank: bool, state: int) -> None:
        initial = role[:1]
        self.rows += 1
        self.illegal += (self.last is not None and self.last + initial not in LEGAL) + (copies - 1) * (initial + initial not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        if state == 0:
            self.gone[-1] += copies
        else:
            self.initials.append(initial)
            self.cut.append(state == 2)
            self.roles.append(role)
            self.texts.append(text)
            self.gone.append(copies - 1)
            self.truncated += state == 2
            self.chars += len(text)
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies if state == 0 else copies - 1

    def summary(self) -> str:
        kept = ("initials", "cut", "gone", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "least", "most")
        return json.dumps({k: getattr(self, k) for k in kept}, separators=(",", ":"))

    @classmethod
    def of(cls, summary: str, roles: list[str] | None = None, texts: list[str] | None = None) -> Block:
        block = cls()
        block.__dict__ |= json.loads(summary) | {"roles": roles, "texts": texts}
        return block

    def distances(self, ahead: list[int]) -> list[list[int]]:
        """The cost from every place and state to the end, ``ahead`` holding that from the block's end on; forced deletions left out."""
        n, least = len(self.initials), min(ahead)
        known = [[FAR] * 4 for _ in range(n + 1)]
        buckets: list[list[tuple[int, int]]] = []

        def reach(i: int, q: int, cost: int) -> None:
            if cost < known[i][q]:
                known[i][q] = cost
                while len(buckets) <= cost:
                    buckets.append([])
                buckets[cost].append((i, q))

        for q in STATES:
            if ahead[q] < FAR:
                # the ends differ by three insertions at most, so buckets stay few
                reach(n, q, ahead[q] - least)
        at = 0
        while at < len(buckets):
            for i, q in buckets[at]:  # arcs of no cost add to the bucket that is being read
                if known[i][q] != at:
                    continue
                for p in STATES:
                    if NEXT[p] == q:
                        reach(i, p, at + INSERT)
                if i:
                    more = CUT if self.cut[i - 1] else 0
                    reach(i - 1, q, at + DELETE)
                    for p in STATES:
                        if AFTER[p].get(self.initials[i - 1]) == q:
                            reach(i - 1, p, at + KEEP + more)
                        if NEXT[p] == q:
                            reach(i - 1, p, at + REROLE + more)
            at += 1
        return [[d + least if d < FAR else FAR for d in of_place] for of_place in known]

    def walk(self, q: int, ahead: list[int], last: bool) -> tuple[str, list[str], int]:
        """The least audit along tight arcs from state ``q``, the lines that stay, and the state at the end."""
        known, n, i = self.distances(ahead), len(self.initials), 0
        audit, lines = ["D" * self.gone[0]], []
        while i < n or known[n][q] != ahead[q] or (last and q not in (0, 3)):
            here = known[i][q]
            if i < n:
                more, kept = CUT if self.cut[i] else 0, AFTER[q].get(self.initials[i])
            if i < n and here == known[i + 1][q] + DELETE:
                letter = "D"
            elif here == known[i][NEXT[q]] + INSERT:
                letter = "I"
                lines.append(NEW[q] + ":")
                q = NEXT[q]
            elif kept is not None and here == known[i + 1][kept] + KEEP + more:
                letter = "K"
                if self.texts is not None:
                    lines.append(f"{self.roles[i]}:{self.texts[i]}")
                q = kept
            else:
                letter = "R"
                if self.texts is not None:
                    lines.append(f"{NEW[q]}:{self.texts[i]}")
                q = NEXT[q]
            audit.append(letter)
            if letter != "I":
                i += 1
                audit.append("D" * self.gone[i])
        return "".join(audit), lines, q


def counts_of(blocks: list[Block], distance: int) -> list[int]:
    """gaps, blank, duplicate, truncated, illegal and cost of a conversation."""
    turns, illegal, last, most = 0, 0, None, None
    least = next((b.least for b in blocks if b.least is not None), None)
    for b in blocks:
        illegal += b.illegal + (last is not None and b.first is not None and last + b.first not in LEGAL)
        turns += b.turns - (b.turns > 0 and b.least == most)
        last, most = b.last if b.last is not None else last, b.most if b.most is not None else most
    gaps = 0 if least is None else most - least + 1 - turns
    return [gaps, sum(b.blank for b in blocks), sum(b.duplicate for b in blocks), sum(b.truncated for b in blocks), illegal, distance + DELETE * sum(sum(b.gone) for b in blocks)]


def digest(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "replace")).hexdigest()


def batch(rows: list[tuple], names: list[str], schema: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema)], names)


class Repair:
    """The rows of a sorted partition to finished conversations and, of those that may go on elsewhere, blocks."""

    def __init__(self, key: pa.DataType, size: int, chars: int):
        self.size, self.chars = size, chars
        self.types = [key, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
        self.names = ["conv_id", "part", "seq", "counts", "audit", "sha256", "summary", "matrix", "roles", "texts"]

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, blocks, of, first, seq, part, chars = [], [], None, True, 0, 0, 0

        def close(inner: bool) -> None:
            nonlocal seq
            if inner and len(blocks) == 1:
                known = blocks[0].distances(END)[0][0]
                audit, lines, _ = blocks[0].walk(0, END, True)
                out.append((of[0], part, seq, counts_of(blocks, known), audit, digest(lines), None, None, None, None))
                seq += 1
            else:
                for b in blocks:
                    cut(b)

        def cut(b: Block) -> None:
            nonlocal seq
            columns = [[row[q] for q in STATES] for row in (b.distances([0 if e == q else FAR for q in STATES])[0] for e in STATES)]
            out.append((of[0], part, seq, None, None, None, b.summary(), [columns[e][q] for q in STATES for e in STATES], b.roles, b.texts))
            seq += 1

        for rows in batches:
            for conv, turn, role, text, copies, blank, state, part in zip(*(rows[c].to_pylist() for c in ("conv_id", "turn", "role", "text", "copies", "blank", "state", "part"))):
                if of is None or conv != of[0]:
                    if of is not None:
                        close(not first)
                        first = False
                    of, blocks = (conv,), [Block()]
                elif blocks[-1].rows >= self.size or blocks[-1].chars >= self.chars:
                    # the block before is done; whether the conversation goes on elsewhere no longer matters
                    cut(blocks[-1])
                    blocks, first = [Block()], True
                if copies:
                    blocks[-1].add(turn, role, text, copies, blank, state)
                chars += len(text)
                if len(out) >= 1_000 or chars >= 1 << 24:
                    yield batch(out, self.names, self.types)
                    out, chars = [], 0
        if of is not None:
            close(False)
        yield batch(out, self.names, self.types)


def backward(table: pa.Table) -> pa.Table:
    """The distances from the end of each block on."""
    found, ahead = [], END
    for part, seq, matrix in sorted(zip(*(table[c].to_pylist() for c in ("part", "seq", "matrix"))), reverse=True):
        found.append((part, seq, ahead, int(ahead is END)))
        ahead = [min([FAR, *(matrix[4 * q + e] + ahead[e] for e in STATES)]) for q in STATES]
    return pa.Table.from_batches([batch(found, ["part", "seq", "ahead", "is_last"], [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32()])])


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of each block for each state at its start, and its distance there."""
    for rows in batches:
        found = []
        for conv, part, seq, summary, ahead, last in zip(*(rows[c].to_pylist() for c in ("conv_id", "part", "seq", "summary", "ahead", "is_last"))):
            block = Block.of(summary)
            known = block.distances(ahead)[0]
            found.append((conv, part, seq, summary, [block.walk(q, ahead, bool(last))[2] for q in STATES], known[0]))
        yield batch(found, ["conv_id", "part", "seq", "summary", "ends", "distance"], [rows.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.int64()])


def forward(table: pa.Table) -> pa.Table:
    """The state at the start of each block; the counts of the conversation with the first."""
    found, state, blocks = [], 0, []
    rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "seq", "summary", "ends", "distance"))), key=lambda r: r[:2])
    for part, seq, summary, ends, _ in rows:
        block = Block.of(summary)
        block.gone, block.initials, block.cut = [sum(block.gone)], [], []
        blocks.append(block)
        found.append([part, seq, state, None])
        state = ends[state]
    found[0][3] = counts_of(blocks, rows[0][4])
    return pa.Table.from_batches([batch(found, ["part", "seq", "state", "counts"], [pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())])])


def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired lines of each block."""
    for rows in batches:
        found = []
        for conv, part, seq, summary, roles, texts, ahead, last, state, counts in zip(*(rows[c].to_pylist() for c in ("conv_id", "part", "seq", "summary", "roles", "texts", "ahead", "is_last", "state", "counts"))):
            audit, lines, _ = Block.of(summary, roles, texts).walk(state, ahead, bool(last))
            found.append((conv, part, seq, counts, audit, "\n".join(lines) if lines else None))
        yield batch(found, ["conv_id", "part", "seq", "counts", "audit", "lines"], [rows.schema.field("conv_id").type, pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string()])


def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks, sorted, to one row for each conversation; only the digest's state and the audit are held."""
    of, audit, counts, hashed, any_line = None, [], None, None, False
    names, types = ["conv_id", "counts", "audit", "sha256"], None
    for rows in batches:
        types, found = [rows.schema.field("conv_id").type, pa.list_(pa.int64()), pa.string(), pa.string()], []
        for conv, own, letters, lines in zip(*(rows[c].to_pylist() for c in ("conv_id", "counts", "audit", "lines"))):
            if of is None or conv != of[0]:
                if of is not None:
                    found.append((of[0], counts, "".join(audit), hashed.hexdigest()))
                of, audit, counts, hashed, any_line = (conv,), [], own, hashlib.sha256(), False
            audit.append(letters)
            if lines is not None:
                hashed.update((("\n" if any_line else "") + lines).encode("utf-8", "replace"))
                any_line = True
        yield batch(found, names, types)
    if of is not None:
        yield batch([(of[0], counts, "".join(audit), hashed.hexdigest())], names, types)


def repair(conversations: DataFrame, block: int = BLOCK, chars: int = CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation, after damage.

    Rows of a conversation go by turn, nulls first; rows of equal turns go by a hash of role and text, which puts repeated rows
    side by side, so that all but the first are duplicates. A null role or text is one space (such a text is blank, such a role is
    neither s, u nor a); rows without a conv_id form a conversation. A conversation without rows gives zeros, an empty audit and the
    hash of the empty string. An empty table gives no rows; columns of other names are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key = conversations.schema["conv_id"].dataType
    name, columns = key.simpleString(), [*COUNTS, "audit", "repaired_sha256"]
    order = ["conv_id", "turn", "tie"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = marked(damaged(conversations.select("conv_id", "turn", "role", "text"))).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = f"conv_id {name}, part int, seq long, counts array<long>, audit string, sha256 string, summary string, matrix array<long>, roles array<string>, texts array<string>"
    found = materialize(rows.drop("tie").withColumn("part", F.spark_partition_id()).mapInArrow(Repair(to_arrow_type(key), block, chars), schema), "repair")

    pieces = found.where("summary is not null")
    ahead = materialize(pieces.select("conv_id", "part", "seq", "matrix").groupBy("conv_id").applyInArrow(backward, "part int, seq long, ahead array<long>, is_last int"), "ahead")
    ends = pieces.select("conv_id", "part", "seq", "summary").join(ahead, ["part", "seq"]).mapInArrow(exits, f"conv_id {name}, part int, seq long, summary string, ends array<int>, distance long")
    starts = materialize(ends.groupBy("conv_id").applyInArrow(forward, "part int, seq long, state int, counts array<long>"), "starts")
    lines = pieces.select("conv_id", "part", "seq", "summary", "roles", "texts").join(ahead, ["part", "seq"]).join(starts, ["part", "seq"])
    lines = lines.mapInArrow(walked, f"conv_id {name}, part int, seq long, counts array<long>, audit string, lines string")
    whole = lines.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(ended, f"conv_id {name}, counts array<long>, audit string, sha256 string")
    both = found.where("summary is null").select("conv_id", "counts", "audit", "sha256").unionByName(whole)
    return both.select("conv_id", *(F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)), "audit", F.col("sha256").alias("repaired_sha256")).select("conv_id", *columns)
