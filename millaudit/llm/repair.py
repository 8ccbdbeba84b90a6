"""Conversation structure repair by dynamic programming over a grammar.

Every row of a conversation becomes one symbol: what its role begins with and which fault it has. Re-Pair finds the pairs of symbols that follow one
another most often over all conversations and names them, again and again, so that a sequence becomes a few names. What a name's rows can cost from
any state of the wanted pattern to any other is one min-plus matrix, whose entries carry the cheapest edits as a rope; a name's matrix is the product of
its two parts, worked out once and shared by all conversations. Long conversations are cut into blocks whose matrices are worked out apart and joined
in order. The texts themselves are read once, in order, when the edits are known.

Edits and their letters: Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert an empty text 2. The state says which letter follows in which
role, so the edits' letters tell the repaired roles.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from millaudit.llm.common import written

#: Bytes that are no text, in a pattern's and a trim's spelling.
WHITE = " \t\n\x0b\f\r"
FIRST_LAST_TEXT = ".!?"
#: States: nothing yet, after system, after user, after a whole pair; where the pattern may end.
START, SYSTEM, USER, PAIR = range(4)
ENDS = (START, PAIR)
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
TRUNCATED = 1
#: The state that a kept role leads to, by state and role's initial.
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
#: The state that a given user or assistant leads to; just one of them fits in each state.
GIVEN = {START: USER, SYSTEM: USER, USER: PAIR, PAIR: USER}
LEGAL = {"su", "ua", "au"}
#: Symbols: a row that must go; role initials otherwise, upper-case if truncated, o for any other role.
GONE, ROLES, OTHER = "x", "sua", "o"
SYMBOLS = GONE + ROLES + OTHER + (ROLES + OTHER).upper()
#: Rows of a block; rounds of Re-Pair and pairs named in one; results remembered by a task.
BLOCK, REPAIR_ROUNDS, NAMED, REMEMBERED = 512, 6, 8, 50_000

Rope = tuple  # (length, left, right), or a plain string as a leaf
Entry = tuple  # (cost, rope)
Matrix = list  # 4 x 4 entries or None, row by row
Grammar = list  # (pair, name) in the order they were named


def _length(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope[0]


def joined(a, b):
    """Two ropes one behind the other, in constant time."""
    if not _length(a):
        return b
    return (_length(a) + _length(b), a, b) if _length(b) else a


def spelled(rope) -> str:
    out, todo = [], [rope]
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
        else:
            todo += (r[2], r[1])
    return "".join(out)


def before(a, b) -> bool:
    """Is rope a less than rope b, as strings? Shared parts in the same place are passed over whole."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if isinstance(p, str) and isinstance(q, str):
            n = min(len(p), len(q))
            if p[:n] != q[:n]:
                return p[:n] < q[:n]
            if len(p) > n:
                x.append(p[n:])
            if len(q) > n:
                y.append(q[n:])
        elif _length(p) >= _length(q) and not isinstance(p, str):
            x += (p[2], p[1])
            y.append(q)
        elif not isinstance(q, str):
            x.append(p)
            y += (q[2], q[1])
        else:
            x += (p[2], p[1])
            y.append(q)
    return bool(y) and any(map(_length, y)) and not any(map(_length, x))


def cheaper(a: Entry | None, b: Entry | None) -> Entry | None:
    """The entry of less cost; of equal ones that whose letters are less."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product of matrices of any number of rows by four columns."""
    out = []
    for i in range(0, len(a), 4):
        for j in range(4):
            best = None
            for k in range(4):
                p, q = a[i + k], b[4 * k + j]
                if p is not None and q is not None:
                    best = cheaper(best, (p[0] + q[0], joined(p[1], q[1])))
            out.append(best)
    return out


def _inserted() -> Matrix:
    out: Matrix = [None] * 16
    for i in range(4):
        state, entry = i, (0, "")
        while out[4 * i + state] is None:
            out[4 * i + state] = entry
            state, entry = GIVEN[state], (entry[0] + INSERT[1], entry[1] + INSERT[0])
    return out


#: What inserting alone can do; a symbol's matrix holds the inserts in front of it, so that letters of equal cost never end one inside the other.
INSERTED = _inserted()


def symbol_matrix(symbol: str) -> Matrix:
    edits: Matrix = [None] * 16
    extra = TRUNCATED if symbol.isupper() else 0
    for state in range(4):
        ways = [(DELETE[1], DELETE[0], state)]
        if symbol != GONE:
            ways.append((REROLE[1] + extra, REROLE[0], GIVEN[state]))
            if (state, symbol.lower()) in NEXT:
                ways.append((KEEP[1] + extra, KEEP[0], NEXT[state, symbol.lower()]))
        for cost, letter, to in ways:
            edits[4 * state + to] = cheaper(edits[4 * state + to], (cost, letter))
    return product(INSERTED, edits)


def last_inserts(vector: Matrix) -> Entry:
    """The cheapest way to end where the pattern may, from what it costs to be in each state."""
    best = None
    for to in ENDS:
        best = cheaper(best, product(vector, INSERTED)[to])
    return best


def compressed(sequence: str, grammar: Grammar) -> str:
    for pair, name in grammar:
        sequence = sequence.replace(pair, name)
    return sequence


def matrices(grammar: Grammar) -> dict[str, Matrix]:
    """One matrix for each symbol and each name, bottom-up."""
    out = {s: symbol_matrix(s) for s in SYMBOLS}
    for pair, name in grammar:
        out[name] = product(out[pair[0]], out[pair[1]])
    return out


def over(vector: Matrix, sequence: str, grammar: Grammar, known: dict[str, Matrix]) -> Matrix:
    for name in compressed(sequence, grammar):
        vector = product(vector, known[name])
    return vector


#: Cost and letters of being at the start, and of being in any state that one is in.
FROM_START: Matrix = [(0, ""), None, None, None]
FROM_ANY: Matrix = [(0, "") if i == j else None for i in range(4) for j in range(4)]


def fitted_grammar(sequences: DataFrame, rounds: int = REPAIR_ROUNDS, named: int = NAMED) -> Grammar:
    """Re-Pair over the column ``symbols``: in each round up to ``named`` of the most frequent pairs that share no symbol get names.

    How many names there are decides how short sequences become, never what a repair is. Pairs of at most ``rounds`` times ``named`` names and nine
    symbols reach the driver.
    """
    distinct = written(sequences.groupBy("symbols").agg(F.count("*").alias("n")), "repair-sequences")
    grammar: Grammar = []
    for _ in range(rounds):
        so_far = list(grammar)

        def run(batches, so_far=so_far):
            for batch in batches:
                found: Counter = Counter()
                for sequence, n in zip(batch.column("symbols").to_pylist(), batch.column("n").to_pylist()):
                    sequence = compressed(sequence, so_far)
                    for pair in set(map(str.__add__, sequence, sequence[1:])):
                        found[pair] += n * sequence.count(pair)
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["pair", "n"])

        pairs = distinct.mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1").collect()
        taken: set[str] = set()
        for pair, _ in sorted(pairs, key=lambda r: (-r.n, r.pair)):
            if len(grammar) - len(so_far) < named and not taken & set(pair):
                taken |= set(pair)
                grammar.append((pair, chr(0x4E00 + len(grammar))))
        if len(grammar) == len(so_far):
            break
    return grammar


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0 if a row is dropped) after the damage that the crc32 of ``conv_id:turn`` tells; nulls are one space, but in conv_id and turn themselves."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, FIRST_LAST_TEXT, "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _identity(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role), F.lit(":"), role, text), 256))


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without their texts: what a repair is decided by."""
    trimmed = F.rtrim("text", F.lit(WHITE))
    return rows.select(
        "conv_id", "turn", _identity(F.col("role"), F.col("text")).alias("said"), F.substring("role", 1, 1).alias("initial"), (trimmed == "").alias("blank"),
        (~F.substring(trimmed, -1, 1).isin(*FIRST_LAST_TEXT)).alias("cut"), "copies",
    )


def _said_before(narrow: DataFrame) -> DataFrame:
    """Rows with ``again``: the same was said at an earlier turn. Only what was said twice is joined."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = (
        narrow.where("copies > 0").groupBy("conv_id", "said").agg(F.min(turn).alias("first"), F.max(turn).alias("last")).where(~F.col("first").eqNullSafe(F.col("last")))
        .select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first")
    )
    both = narrow.join(firsts, narrow["said"].eqNullSafe(firsts["_said"]) & narrow["conv_id"].eqNullSafe(firsts["_conv"]), "left")
    return both.select(*narrow.columns, F.coalesce(F.col("first") < turn, F.lit(False)).alias("again"))


class _Block:
    """Neighbouring rows of one conversation: their symbols and what is counted in them."""

    def __init__(self, conv_id, part: int, whole: bool):
        self.conv_id, self.part, self.whole = conv_id, part, whole
        self.symbols: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = None
        self.low = self.high = self.said = None

    def add(self, turn, said, initial: str, blank: bool, cut: bool, again: bool) -> None:
        repeated = again or (said, turn) == self.said
        self.said = said, turn
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank or repeated:
            self.blank += blank
            self.duplicate += not blank
            self.symbols.append(GONE)
            return
        self.truncated += cut
        symbol = initial if initial and initial in ROLES else OTHER
        self.symbols.append(symbol.upper() if cut else symbol)

    def row(self) -> tuple:
        return (
            self.conv_id, self.part, self.whole, "".join(self.symbols), self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high,
            self.first, self.last,
        )


COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint"
BLOCKS = f"part bigint, whole boolean, symbols string, {COUNTS}, first string, last string"


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _emitted(rows: Iterator[tuple], schema: pa.Schema, size: int = 2_000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _mapped(rows: DataFrame, made: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of a partition, in their order, made from its rows; both sides go by in batches."""
    fields = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in StructType.fromDDL(schema)])
    return rows.mapInArrow(lambda batches: _emitted(made(_rows(batches)), fields), schema)


def _arrow(kind: str) -> pa.DataType:
    if kind.startswith("array"):
        return pa.list_(_arrow(kind[6:-1]))
    return {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}[kind]


def blocks(rows: DataFrame) -> DataFrame:
    """The rows in order, dealt by ranges so that a long conversation is many tasks' work, as blocks of symbols.

    A block that is surely its whole conversation says so: another conversation stands on both sides of it in its range.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    order = ["conv_id", "turn", "said"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "said", "initial", "blank", "cut", "again", "copies")

    def made(found):
        part = TaskContext.get().partitionId() << 40
        block, alone = None, False  # alone: the block's conversation begins in this range, behind another one
        for conv_id, turn, said, initial, blank, cut, again, copies in found:
            if block is None or conv_id != block.conv_id or len(block.symbols) >= BLOCK:
                changed = block is not None and conv_id != block.conv_id
                if block is not None:
                    block.whole = alone and changed
                    yield block.row()
                held = None if block is None or changed else block
                alone = changed
                block = _Block(conv_id, part, False)
                if held is not None:
                    block.said = held.said  # equal rows stand side by side, also across blocks
                part += 1
            for _ in range(copies):
                block.add(turn, said, initial, blank, cut, again)
        if block is not None:
            yield block.row()

    return _mapped(dealt, made, f"conv_id {kind}, {BLOCKS}")


def repairs(found: DataFrame) -> DataFrame:
    """Per conversation its counts, the cost of its repair and the letters of its edits, from written blocks."""
    kind = found.schema["conv_id"].dataType.simpleString()
    grammar = fitted_grammar(found)
    handed = found.sparkSession.sparkContext.broadcast(grammar)  # at most rounds times named pairs
    whole = found.where("whole").select("conv_id", "symbols", *[f.name for f in StructType.fromDDL(COUNTS)])
    result = f"conv_id {kind}, {COUNTS}, cost bigint, audit string"

    def at_once(rows):
        known, seen = matrices(handed.value), {}
        for conv_id, symbols, *counts in rows:
            if symbols not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                cost, rope = last_inserts(over(FROM_START, symbols, handed.value, known))
                seen[symbols] = cost, spelled(rope)
            yield conv_id, *counts, *seen[symbols]

    def apart(rows):
        known = matrices(handed.value)
        for conv_id, part, _, symbols, *rest in rows:
            matrix = over(FROM_ANY, symbols, handed.value, known)
            yield conv_id, part, *rest, [None if e is None else e[0] for e in matrix], [None if e is None else spelled(e[1]) for e in matrix]

    def together(rows):
        now, vector, counts = None, None, None

        def done():
            cost, rope = last_inserts(vector)
            return now[0], *counts[:7], cost, spelled(rope)

        for conv_id, _, blank, duplicate, truncated, illegal, turns, low, high, first, last, costs, letters in rows:
            if now is None or conv_id != now[0]:
                if now is not None:
                    yield done()
                now, vector, counts = (conv_id,), FROM_START, [0, 0, 0, 0, 0, None, None, None]
            vector = product(vector, [None if c is None else (c, r) for c, r in zip(costs, letters)])
            if first is not None:
                illegal += counts[7] is not None and counts[7] + first not in LEGAL
                counts[7] = last
            if low is not None:
                turns -= low == counts[6]
                counts[5], counts[6] = low if counts[5] is None else counts[5], high
            counts[:5] = [a + b for a, b in zip(counts[:5], (blank, duplicate, truncated, illegal, turns))]
        if now is not None:
            yield done()

    rest = found.where("not whole")
    parts = _mapped(rest, apart, f"conv_id {kind}, part bigint, {COUNTS}, first string, last string, costs array<bigint>, letters array<string>")
    in_order = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return _mapped(whole, at_once, result).unionAll(_mapped(in_order, together, result))


class _Editor:
    """Carries out the edits of one conversation, row by row."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _given(self) -> str:
        self.state = GIVEN[self.state]
        return "user" if self.state == USER else "assistant"

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == INSERT[0]:
            self.at += 1
            yield INSERT[0], self._given(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """(letter, role, text) of the rows that come out at this row: inserted ones, then itself if it stays."""
        yield from self.inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == KEEP[0]:
            self.state = NEXT[self.state, role[:1]]
            yield letter, role, text
        elif letter == REROLE[0]:
            yield letter, self._given(), text


def _with_texts(rows: DataFrame, told: DataFrame) -> DataFrame:
    """Every conversation's repair, followed by its rows in order."""
    texts = rows.where("copies > 0").withColumn("said", _identity(F.col("role"), F.col("text"))).withColumn("is_row", F.lit(True))
    both = told.withColumn("is_row", F.lit(False)).unionByName(texts, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "said")


def repair_reports(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, copies) the counts of its faults, the cost and letters of its edits."""
    found = written(blocks(_said_before(_narrow(rows))), "repair-blocks")
    return repairs(found)


def repaired_rows(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text) of the repaired conversations; deleted rows are not there."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def made(found):
        now, editor, position = None, None, 0
        for conv_id, is_row, audit, role, text, copies in found:
            if not is_row:
                if editor is not None:
                    for edit in editor.inserted():
                        yield now, position, *edit
                        position += 1
                now, editor, position = conv_id, _Editor(audit), 0
                continue
            for _ in range(copies):
                for edit in editor.row(role, text):
                    yield conv_id, position, *edit
                    position += 1
        if editor is not None:
            for edit in editor.inserted():
                yield now, position, *edit
                position += 1

    picked = _with_texts(rows, told.select("conv_id", "audit")).select("conv_id", "is_row", "audit", "role", "text", "copies")
    return _mapped(picked, made, f"conv_id {kind}, position bigint, edit string, role string, text string")


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation gaps, blank, duplicate, truncated, illegal, cost, audit and the digest of its repaired rows.

    ``rows`` are (conv_id, turn, role, text, copies), as ``damaged`` gives them; roles and texts are not null. Rows without copies only name their conversation,
    which then comes out with zeros, no edit and the digest of nothing. Rows go by turn, nulls first, equal turns by the identity of role and text; a null
    conv_id is a conversation like others; repeated rows are duplicates; other columns are left out. A conversation's digest is one hash over
    its whole text, so its texts pass one task, in order and never held together; all else is dealt by blocks.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    told = written(repair_reports(rows), "repair-reports")
    names = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def made(found):
        report = editor = digest = None

        def done():
            for edit in editor.inserted():
                add(edit)
            return *report, digest[0].hexdigest()

        def add(edit):
            digest[0].update((("\n" if digest[1] else "") + f"{edit[1]}:{edit[2]}").encode("utf-8", "surrogatepass"))
            digest[1] = True

        for conv_id, is_row, audit, gaps, *counts, role, text, copies in found:
            if not is_row:
                if report is not None:
                    yield done()
                report, editor, digest = (conv_id, gaps, *counts, audit), _Editor(audit), [hashlib.sha256(), False]
                continue
            for _ in range(copies):
                for edit in editor.row(role, text):
                    add(edit)
        if report is not None:
            yield done()

    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).alias("gaps")
    picked = _with_texts(rows, told.select("conv_id", "audit", gaps, *names)).select("conv_id", "is_row", "audit", "gaps", *names, "role", "text", "copies")
    return _mapped(picked, made, f"conv_id {kind}, gaps bigint, " + "".join(f"{c} bigint, " for c in names) + "audit string, repaired_sha256 string")
