"""Conversation structure repair by weighted CYK interval parsing.

Rows of a conversation are the terminals of a repair grammar for role initials ``(s?(ua)+)?``.  Its nonterminals
[p>q] derive what leads from structural state p (start, after system, after user, after assistant) to q; in Chomsky
normal form they are binary, [p>q] -> [p>r] [r>q], or lexical: one row kept, given another role or deleted, with the
inserted turns around it folded in (the insertion closure, which also stands for the empty span).  A cell holds, for each
nonterminal, the least (cost, audit) over its span, audits being the edits' initials.  Charts are filled bottom-up by
span length.  Audits of equal cost over a span are never prefixes of each other (all hold one letter a row, and an
insertion costs), so the least of a span is part of the least of any longer one.

A derivation of [p>q] passes some state at every inner point, so every split of a span gives the same cell.  Therefore
conversations longer than BLOCK rows are parsed in blocks of BLOCK rows, and the blocks' spans joined pairwise by length,
up to BLOCK spans a task and level: no task holds a long conversation's chart.

Rows stand by turn (nulls first), then role and text.  Null role or text is one blank.  A row is blank (no character but
blanks), else duplicate (role and text stand earlier), else truncated (its last character but blanks ends no sentence).
Blank and duplicate rows must go.  Roles count by their first character; an empty one has none.
A null conv_id is a conversation of its own.  Conversations without rows have zeros, an empty audit and text.
The digest of a repaired conversation is one hash over its text, hence made row after row in one task, in constant memory but for the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .turns import ORDER, in_turn_order

#: Costs of a role change, a deletion, an insertion and of leaving a truncated row.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: start, after system, after user, after assistant; moves by role initial; states to end in.
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
#: Roles that can be given or inserted.
GIVEN = {"u": "user", "a": "assistant"}
#: Rows as symbols: the initial's class, as it is, in capitals if truncated, as a digit if the row must go.
KEPT, CUT_OFF, GONE = "suax", "SUAX", "0123"
#: Rows in a block, and the most different spans remembered by a worker.
BLOCK, REMEMBERED = 16, 200_000

Item = tuple[int, str]
Cell = dict[tuple[int, int], Item]


def closure() -> dict[tuple[int, int], int]:
    """Fewest insertions that lead from one state to another, for all that are reachable."""
    steps = {(p, p): 0 for p in STATES}
    for _ in STATES:
        for (p, q), n in list(steps.items()):
            for role in GIVEN:
                if (to := MOVES.get((q, role))) is not None and steps.get((p, to), n + 2) > n + 1:
                    steps[p, to] = n + 1
    return steps


GAPS = closure()
#: All nonterminals, and the binary rules as (left, right) for each; only a row that is kept leads from start to after system.
NONTERMINALS = sorted({*GAPS, *((p, q) for (p, _), q in MOVES.items())})
RULES = {(p, q): [((p, r), (r, q)) for r in STATES if (p, r) in NONTERMINALS and (r, q) in NONTERMINALS] for p, q in NONTERMINALS}
#: What a nonterminal costs that derives nothing over a span.
NONE = (1 << 40, "")


def lexical(symbol: str) -> Cell:
    """The cell of one row: its edits between the insertions on both sides."""
    edits: list[tuple[int, int, int, str]] = [(p, p, DELETE, "D") for p in STATES]
    if symbol not in GONE:
        left = TRUNCATED if symbol in CUT_OFF else 0
        edits += [(p, q, left, "K") for (p, c), q in MOVES.items() if c == symbol.lower()]
        edits += [(p, q, left + REROLE, "R") for (p, c), q in MOVES.items() if c in GIVEN]
    cell: Cell = {}
    for p, q in NONTERMINALS:
        found = []
        for p1, q1, cost, letter in edits:
            if (p, p1) in GAPS and (q1, q) in GAPS:
                before, after = GAPS[p, p1], GAPS[q1, q]
                found.append((cost + INSERT * (before + after), "I" * before + letter + "I" * after))
        cell[p, q] = min(found, default=NONE)
    return cell


def binary(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side."""
    out: Cell = {}
    for target, rules in RULES.items():
        cost = min(left[a][0] + right[b][0] for a, b in rules)
        out[target] = (cost, min(left[a][1] + right[b][1] for a, b in rules if left[a][0] + right[b][0] == cost)) if cost < NONE[0] else NONE
    return out


_known: dict[str, Cell] = {}


def chart(symbols: str) -> Cell:
    """The cell of a whole block: every span from every split, shorter spans first; spans met before are remembered."""
    if len(_known) > REMEMBERED:
        _known.clear()
    for length in range(1, len(symbols) + 1):
        for start in range(len(symbols) - length + 1):
            span = symbols[start : start + length]
            if span in _known:
                continue
            if length == 1:
                _known[span] = lexical(span)
                continue
            cells = [binary(_known[span[:k]], _known[span[k:]]) for k in range(1, length)]
            _known[span] = {n: min(c[n] for c in cells) for n in NONTERMINALS}
    return _known[symbols]


def pairwise(cells: list[Cell]) -> Cell:
    """The cell of spans side by side, joined two by two: lengths double."""
    while len(cells) > 1:
        joined = [binary(a, b) for a, b in zip(cells[::2], cells[1::2], strict=False)]
        cells = joined + cells[len(cells) - len(cells) % 2 :]
    return cells[0]


def write_cell(cell: Cell) -> str:
    return "|".join(f"{cost}{audit}" for cost, audit in (cell[n] for n in NONTERMINALS))


def read_cell(text: str) -> Cell:
    cell = {}
    for n, item in zip(NONTERMINALS, text.split("|"), strict=True):
        audit = item.lstrip("0123456789")
        cell[n] = int(item[: len(item) - len(audit)]), audit
    return cell


def _parse_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells of blocks, and how many neighbours in them (the next block's first row included) have unfit initials."""
    classes = {c: "suax"[i] for row in (KEPT, CUT_OFF, GONE) for i, c in enumerate(row)}
    for batch in batches:
        cells, illegal = [], []
        for symbols in batch.column(2).to_pylist():
            roles = [classes[c] for c in symbols]
            illegal.append(sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False)))
            cells.append(write_cell(chart(symbols[:BLOCK])))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(illegal, pa.int64()), pa.array(cells, pa.string())], ["conv_id", "block", "illegal", "cell"])


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [write_cell(pairwise([read_cell(c) for c in some])) for some in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cells, pa.string())], ["conv_id", "block", "cell"])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        chosen = [min(cell[0, q] for q in FINAL) for cell in map(read_cell, batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in chosen], pa.int64()), pa.array([a for _, a in chosen], pa.string())], ["conv_id", "cost", "audit"])


class Rebuilding:
    """A conversation's rows in order, edited by its audit."""

    def __init__(self, audit: str):
        self.audit, self.at, self.turn = audit, 0, 0
        # A repaired conversation alternates in pairs but for a system turn at its start.
        self.odd = (len(audit) - audit.count("D")) % 2

    def _given(self) -> str:
        return GIVEN["ua"[(self.turn - self.odd) % 2]]

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            yield self._given(), ""
            self.at, self.turn = self.at + 1, self.turn + 1

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            yield (role if edit == "K" else self._given()), text
            self.turn += 1


def _rebuild(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Audits and rows, sorted by conversation, the audit first: digests, or the repaired turns themselves."""
    names = ["conv_id", "n", "role", "text", "sha"]
    out: list[tuple] = []
    conv, now, digest, n = None, None, hashlib.sha256(), 0

    def emit(turns: Iterator[tuple[str, str]]) -> None:
        nonlocal n
        for role, text in turns:
            if whole:
                out.append((conv, n, role, text, None))
            else:
                digest.update((("\n" if n else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            n += 1

    def flush() -> pa.RecordBatch:
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
        out.clear()
        return batch

    def finish() -> None:
        emit(now.inserted())
        if not whole:
            out.append((conv, None, None, None, digest.hexdigest()))

    for batch in batches:
        c = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        for key, kind, role, text, audit in zip(c["conv_id"], c["kind"], c["role"], c["text"], c["audit"], strict=True):
            if kind == 0:
                if now:
                    finish()
                conv, now, digest, n = key, Rebuilding(audit), hashlib.sha256(), 0
            else:
                emit(now.row(role, text))
            if len(out) >= 1000:
                yield flush()
    if now:
        finish()
    yield flush()


def damaged(rows: DataFrame) -> DataFrame:
    """Turns dropped, emptied, bare of full stops, repeated or given the role user, by a checksum of ``conv_id:turn``; nulls become one blank."""
    blank = {c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")}
    mark = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])) % 20
    rows = rows.select("conv_id", "turn", blank["role"].alias("role"), blank["text"].alias("text"), mark.alias("mark")).filter("mark != 0")
    text = F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("mark") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, pos, turn, initial (class), fault (blank, duplicate, truncated or null) of each row."""
    initial = F.substring("role", 1, 1)
    keep = {
        "turn": F.col("turn"),
        "initial": F.when(initial.isin("s", "u", "a"), initial).otherwise("x"),
        "blank": ~F.col("text").rlike(r"[^\x20\x09-\x0D]"),
        "open": ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"),
        "same": F.sha2(F.concat(F.length("role"), F.lit(":"), "role", F.col("text")), 256),
    }
    placed = cut(in_turn_order(rows, keep), "placed")
    # The first of equal rows: one place each, so that the join meets no frequent text.
    first = cut(placed.groupBy("conv_id", "same").agg(F.min("pos").alias("_pos")).select(F.col("conv_id").alias("_conv"), "_pos"), "first")
    marked = placed.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("pos") == F.col("_pos")), "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("_pos").isNull(), "duplicate").when(F.col("open"), "truncated")
    return marked.select("conv_id", "pos", "turn", "initial", fault.alias("fault"))


def _audits(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, illegal) a block, and (conv_id, cost, audit) a conversation."""
    place = F.instr(F.lit(KEPT), F.col("initial"))
    symbols = F.when(F.col("fault") == "truncated", F.lit(CUT_OFF)).when(F.col("fault").isNotNull(), F.lit(GONE)).otherwise(F.lit(KEPT))
    block = F.floor(F.col("pos") / BLOCK).cast("long")
    # A block's first row is also shown to the block before it.
    blocks = F.when((F.col("pos") % BLOCK == 0) & (F.col("pos") > 0), F.array(block, block - 1)).otherwise(F.array(block))
    spread = marked.select("conv_id", F.explode(blocks).alias("block"), "pos", symbols.substr(place, F.lit(1)).alias("symbol"))
    listed = spread.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list(F.struct("pos", "symbol"))).alias("rows"))
    lines = listed.select("conv_id", "block", F.array_join(F.col("rows.symbol"), "").alias("symbols"))
    parsed = cut(lines.mapInArrow(_parse_blocks, "conv_id long, block long, illegal long, cell string"), "cells")
    cells, last = parsed.select("conv_id", "block", "cell"), parsed.agg(F.max("block")).first()[0] or 0
    while last:
        last //= BLOCK
        over = cells.groupBy("conv_id", F.floor(F.col("block") / BLOCK).cast("long").alias("block"))
        spans = over.agg(F.array_sort(F.collect_list(F.struct("block", "cell"))).alias("spans")).select("conv_id", "block", F.col("spans.cell").alias("cells"))
        cells = cut(spans.mapInArrow(_join_blocks, "conv_id long, block long, cell string"), "cells")
    return parsed.select("conv_id", "illegal"), cut(cells.select("conv_id", "cell").mapInArrow(_choose, "conv_id long, cost long, audit string"), "audits")


def _rebuilt(rows: DataFrame, audits: DataFrame, whole: bool) -> DataFrame:
    null = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("audit", "string"))}
    turns = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long"), "role", "text", null["audit"].alias("audit"))
    both = audits.select("conv_id", F.lit(0).alias("kind"), *[null[c].alias(c) for c in ORDER], "audit").union(turns)
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *[F.col(c).asc_nulls_first() for c in ORDER])
    return dealt.select("conv_id", "kind", "role", "text", "audit").mapInArrow(lambda b: _rebuild(b, whole), "conv_id long, n long, role string, text string, sha string")


def _own(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return rows.select(rows[conv].cast("long").alias("conv_id"), rows[turn].cast("long").alias("turn"), rows[role].alias("role"), rows[text].alias("text"))


def _filled(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text")})


def repaired_turns(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n (from 0), role, text of the repaired conversations."""
    ship(rows.sparkSession)
    rows = _filled(_own(rows, conv, turn, role, text))
    return _rebuilt(rows, _audits(faults(rows))[1], True).select("conv_id", "n", "role", "text")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", damage: bool = False) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of ``rows``.

    With ``damage``, rows are damaged first; conversations that lose all rows stay."""
    ship(rows.sparkSession)
    given = _own(rows, conv, turn, role, text)
    rows = damaged(given) if damage else _filled(given)
    marked = cut(faults(rows), "faults")
    illegal, audits = _audits(marked)
    turns = marked.groupBy("conv_id", "turn").count().groupBy("conv_id")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    counts = marked.groupBy("conv_id").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    digests = _rebuilt(rows, audits, False).select("conv_id", F.col("sha").alias("repaired_sha256"))
    parts = [given.select("conv_id").distinct(), gaps, counts, illegal, audits, digests]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in numbers]
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    return united.groupBy("conv_id").agg(*sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))


