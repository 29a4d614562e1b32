"""Repair of conversations: the cheapest edits that bring turns into a legal order, by dynamic programming over a grammar.

A row of a conversation is a symbol: the initial of its role and what is wrong with it. What can be done
with a row, and the turns that may be put in before it, is a min-plus matrix over the states of the legal
order ``(s?(ua)+)?``: the cheapest cost and the edits that lead from one state to another. Edits are kept
as ropes, so that long ones share their parts. Costs follow from the edits of the same rows, so of two
equally cheap strings of edits neither begins with the other, and the least of both is the same whatever
comes before or after them: matrices can be multiplied in any grouping.

Conversations say much the same things in the same order. Each task turns the symbols of many conversations
into a grammar (Re-Pair: frequent neighbours become a new symbol, until no pair occurs twice), forms one
matrix for each rule from those of its two halves, bottom-up, and reads every conversation's result from
the few symbols it is left with. Rules and matrices are shared by all conversations of a task, across
blocks of them too.

Rows are dealt by conversation and come sorted, since a conversation's text is hashed in order. A task
holds one byte for each row of a block of conversations; their texts go to a temporary file of the task
where they are more than a few megabytes. Rows that repeat earlier ones are found by an aggregate over
(conversation, hash of role and text), not by holding a conversation's rows.

Defined cases: a null role or text is one space, and null ids are one conversation; rows come by turn,
null turns first, rows of one turn by role and text; an empty role, or one of another initial, fits no
place and must be given another role or go; conversations without rows have no edits and an empty text;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from callgauge.llm.registry import query, table

BLANKS = " \t\n\x0b\x0c\r"
STOPS = (".", "!", "?")
#: States of the legal order: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
FINAL = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL_PAIRS = ("su", "ua", "au")
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED_COST = 1
#: Symbols: 0 must go; the others say the role's initial and whether the text is cut off.
GO, ROLES = 0, "sua?"
SYMBOLS = 1 + 2 * len(ROLES)
#: Rows of a block of conversations, bytes of it held in memory, and rules after which a grammar is begun anew.
BLOCK_ROWS = 1 << 16
HELD_BYTES = 1 << 23
MOST_RULES = 1 << 15
#: Edits up to this length are plain strings.
LEAF = 64


def symbol(role: str, truncated: bool) -> int:
    return 1 + 2 * (ROLES.index(role[0]) if role and role[0] in "sua" else 3) + truncated


class Rope:
    """Two strings of edits, one after the other."""

    __slots__ = ("left", "right", "length")

    def __init__(self, left, right, length):
        self.left, self.right, self.length = left, right, length


def size(rope) -> int:
    return len(rope) if isinstance(rope, str) else rope.length


def concat(left, right):
    if not size(left) or not size(right):
        return left if size(left) else right
    length = size(left) + size(right)
    return left + right if length <= LEAF else Rope(left, right, length)


def leaves(rope) -> Iterator[str]:
    stack = [rope]
    while stack:
        top = stack.pop()
        if isinstance(top, str):
            yield top
        else:
            stack += (top.right, top.left)


def less(a, b) -> bool:
    """Whether ``a`` comes before ``b``, neither beginning with the other; parts that both share are skipped."""
    x, y = [a], [b]
    while x and y:
        p, q = x.pop(), y.pop()
        if p is q:
            continue
        if isinstance(p, str) and isinstance(q, str):
            n = min(len(p), len(q))
            if p[:n] != q[:n]:
                return p[:n] < q[:n]
            if p[n:]:
                x.append(p[n:])
            if q[n:]:
                y.append(q[n:])
        elif isinstance(q, str) or (not isinstance(p, str) and p.length >= q.length):
            x += (p.right, p.left)
            y.append(q)
        else:
            x.append(p)
            y += (q.right, q.left)
    return False


def better(a: tuple | None, b: tuple | None) -> tuple | None:
    """The cheaper of two (cost, edits), the least edits if equal; None is impossible."""
    if a is None or b is None:
        return b if a is None else a
    return b if b[0] < a[0] or (b[0] == a[0] and less(b[1], a[1])) else a


def times(a: list, b: list) -> list:
    """Min-plus product of two matrices of (cost, edits)."""
    out = []
    for row in a:
        line = []
        for to in range(4):
            best = None
            for middle, head in enumerate(row):
                tail = b[middle][to]
                # a dearer way is left before its edits are joined
                if head is not None and tail is not None and (best is None or head[0] + tail[0] <= best[0]):
                    best = better(best, (head[0] + tail[0], concat(head[1], tail[1])))
            line.append(best)
        out.append(line)
    return out


def insertions() -> list:
    """What turns put in at one place lead to: at most two are ever of use."""
    out = [[(0, "") if p == q else None for q in range(4)] for p in range(4)]
    for p in range(4):
        at, edits = p, ""
        for _ in range(2):
            at, edits = (ASSISTANT if at == USER else USER), edits + "I"
            out[p][at] = better(out[p][at], (len(edits) * COST["I"], edits))
    return out


def row_matrix(code: int) -> list:
    """Insertions before a row of symbol ``code``, then what can be done with it."""
    edit = [[None] * 4 for _ in range(4)]
    for p in range(4):
        edit[p][p] = (COST["D"], "D")
        if code == GO:
            continue
        role, extra = ROLES[(code - 1) // 2], (code - 1) % 2 * TRUNCATED_COST
        ways = [("K", role)] + [("R", r) for r in "ua"]
        for name, r in ways:
            to = STEP.get((p, r))
            if to is not None:
                edit[p][to] = better(edit[p][to], (COST[name] + extra, name))
    return times(insertions(), edit)


class Grammar:
    """Re-Pair rules over row symbols, with the matrix of each."""

    def __init__(self):
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices = [row_matrix(code) for code in range(SYMBOLS)]

    def rule(self, left: int, right: int) -> int:
        """Symbol for the pair; its matrix is formed once, from those of its halves."""
        found = self.rules.get((left, right))
        if found is None:
            found = self.rules[left, right] = len(self.matrices)
            self.matrices.append(times(self.matrices[left], self.matrices[right]))
        return found

    def compress(self, sequences: list[bytes], counts: list[int]) -> list[list[int]]:
        """The symbols that are left of each of ``sequences``, which occur ``counts`` times.

        In each round the most frequent pairs that have no symbol in common are replaced together, which is
        the same as one after the other.
        """
        flat = np.concatenate([np.zeros(0, np.int64), *(np.append(np.frombuffer(s, np.uint8).astype(np.int64), -1) for s in sequences)])
        weight = np.repeat(np.array(counts, np.int64), [len(s) + 1 for s in sequences])
        while len(flat) > 1:
            a, b = flat[:-1], flat[1:]
            at = np.arange(len(a))
            # of a run of one symbol every other pair counts
            begins = np.maximum.accumulate(np.where(np.append(True, a[1:] != a[:-1]), at, 0))
            valid = np.flatnonzero((a >= 0) & (b >= 0) & ((a != b) | ((at - begins) % 2 == 0)))
            width = len(self.matrices)
            pairs, which = np.unique(a[valid] * width + b[valid], return_inverse=True)
            n = np.bincount(which, weight[valid], len(pairs))
            chosen, used = np.full(len(pairs), -1, np.int64), set()
            for k in np.lexsort((pairs, -n)).tolist():
                if n[k] < 2:
                    break
                ends = divmod(int(pairs[k]), width)
                if used.isdisjoint(ends):
                    used.update(ends)
                    chosen[k] = self.rule(*ends)
            if not used:
                break
            taken = chosen[which] >= 0
            places = valid[taken]
            flat[places] = chosen[which][taken]
            rest = np.ones(len(flat), bool)
            rest[places + 1] = False
            flat, weight = flat[rest], weight[rest]
        return [part[:-1].tolist() for part in np.split(flat, np.flatnonzero(flat < 0) + 1)[:-1]]

    def solve(self, symbols: list[int]) -> tuple[int, str]:
        """Cheapest cost and edits; neighbours are multiplied first, so that halves are of like length."""
        matrices = [self.matrices[s] for s in symbols]
        while len(matrices) > 1:
            matrices = [times(*matrices[i:i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
        whole = times(matrices[0], insertions()) if matrices else insertions()
        best = None
        for state in FINAL:
            best = better(best, whole[START][state])
        return best[0], "".join(leaves(best[1]))


class Conversation:
    """Counts and symbols of one conversation; its texts are in the block's file."""

    def __init__(self, key):
        self.key = key
        self.symbols = bytearray()
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.last = None
        self.turns = [None, None, 0]

    def add(self, turn, role: str, text: str, later: bool) -> bool:
        """Take in the next row; whether its text may be needed."""
        if self.last is not None:
            self.illegal += self.last[1][:1] + role[:1] not in LEGAL_PAIRS
        if turn is not None and (self.last is None or turn != self.last[0]):
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        end = text.rstrip(BLANKS)
        blank, again = not end, later or self.last == (turn, role, text)
        truncated = not blank and not again and not end.endswith(STOPS)
        self.blank += blank
        self.duplicate += not blank and again
        self.truncated += truncated
        self.symbols.append(GO if blank or again else symbol(role, truncated))
        self.last = (turn, role, text)
        return self.symbols[-1] != GO

    def gaps(self) -> int:
        low, high, n = self.turns
        return high - low + 1 - n if n else 0


class Block:
    """Some conversations, with the texts of the rows that may stay in a file that lasts as long as the block."""

    def __init__(self):
        self.conversations: list[Conversation] = []
        self.rows = 0
        self.file = tempfile.SpooledTemporaryFile(HELD_BYTES)

    def add(self, key, fresh: bool, gone: bool, turn, role: str, text: str, later: bool) -> None:
        if fresh:
            self.conversations.append(Conversation(key))
        if gone:
            return
        self.rows += 1
        if self.conversations[-1].add(turn, role, text, later):
            r, t = role.encode(), text.encode()
            self.file.write(struct.pack("<QQ", len(r), len(t)) + r + t)

    def solved(self, grammar: Grammar) -> Iterator[tuple[Conversation, int, str, Iterator[tuple[bytes, bytes]]]]:
        """Each conversation with cost, edits and the repaired (role, text), which are to be read before the next one."""
        counts: dict[bytes, int] = {}
        for c in self.conversations:
            counts[bytes(c.symbols)] = counts.get(bytes(c.symbols), 0) + 1
        found = dict(zip(counts, map(grammar.solve, grammar.compress(list(counts), list(counts.values())))))
        self.file.seek(0)
        for c in self.conversations:
            cost, edits = found[bytes(c.symbols)]
            yield c, cost, edits, self.repaired(c, edits)
        self.file.close()

    def read(self) -> tuple[bytes, bytes]:
        r, t = struct.unpack("<QQ", self.file.read(16))
        return self.file.read(r), self.file.read(t)

    def repaired(self, c: Conversation, edits: str) -> Iterator[tuple[bytes, bytes]]:
        state, rows = START, iter(c.symbols)
        for edit in edits:
            row = None
            if edit != "I" and next(rows) != GO:
                row = self.read()
            if edit == "D":
                continue
            if edit == "K":
                role, text = row
            else:
                role, text = b"assistant" if state == USER else b"user", row[1] if row else b""
            state = STEP[state, role[:1].decode()]
            yield role, text


def edited(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """Blocks of sorted rows, solved; conversations are not cut."""
    grammar, block, here, began = Grammar(), Block(), None, False
    for batch in batches:
        for key, gone, turn, role, text, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "gone", "turn", "role", "text", "later"))):
            fresh = not began or key != here
            if fresh and block.rows >= BLOCK_ROWS:
                yield from block.solved(grammar)
                block, grammar = Block(), grammar if len(grammar.rules) <= MOST_RULES else Grammar()
            here, began = key, True
            block.add(key, fresh, gone, turn, role, text, later)
    yield from block.solved(grammar)


def row_hash() -> Column:
    return F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))


def ordered_rows(conversations: DataFrame) -> DataFrame:
    """Rows of ``conversations`` (conv_id, turn, role, text and, if rows were lost, ``gone``), each conversation in order in one partition.

    ``later`` marks rows whose role and text an earlier turn had. A row that is ``gone`` only names its conversation.
    """
    gone = F.col("gone") if "gone" in conversations.columns else F.lit(False)
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, gone.alias("gone"))
    moment = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = rows.filter("NOT gone").groupBy(F.col("conv_id").alias("__conv"), row_hash().alias("__hash")).agg(F.min(moment).alias("__first"), F.max(moment).alias("last"))
    seen = seen.filter("__first < last").drop("last")
    rows = rows.withColumn("hash", row_hash())
    rows = rows.join(seen, rows["conv_id"].eqNullSafe(seen["__conv"]) & (rows["hash"] == seen["__hash"]), "left")
    later = F.coalesce(moment > F.col("__first"), F.lit(False))
    rows = rows.select("conv_id", "turn", "role", "text", "gone", later.alias("later"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair(conversations: DataFrame) -> DataFrame:
    """Repaired turns (conv_id, position, role, text), positions from 0; conversations without any have no row."""
    kind = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def work(batches):
        def batch(rows):
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], arrow), *(pa.array(c, t) for c, t in zip(columns[1:], (pa.int64(), pa.string(), pa.string())))],
                                              ["conv_id", "position", "role", "text"])

        held, n = [], 0
        for c, _, _, lines in edited(batches):
            for position, (role, text) in enumerate(lines):
                held.append((c.key, position, role.decode(), text.decode()))
                n += len(text)
                if len(held) >= 1000 or n > HELD_BYTES:
                    yield batch(held)
                    held, n = [], 0
        if held:
            yield batch(held)

    return ordered_rows(conversations).mapInArrow(work, f"conv_id {kind.simpleString()}, position long, role string, text string")


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(conversations: DataFrame) -> DataFrame:
    """For every conversation what was wrong, the edits, their cost, and the hash of the repaired ``role:text`` lines."""
    kind = conversations.schema["conv_id"].dataType
    arrow = to_arrow_type(kind)

    def work(batches):
        def batch(rows):
            columns = list(zip(*rows))
            types = [arrow, *[pa.int64()] * len(REPORT), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", *REPORT, "audit", "repaired_sha256"])

        held, n = [], 0
        for c, cost, edits, lines in edited(batches):
            digest, first = hashlib.sha256(), True
            for role, text in lines:
                digest.update(b"" if first else b"\n")
                digest.update(role + b":")
                digest.update(text)
                first = False
            held.append((c.key, c.gaps(), c.blank, c.duplicate, c.truncated, c.illegal, cost, edits, digest.hexdigest()))
            n += len(edits)
            if len(held) >= 1000 or n > HELD_BYTES:
                yield batch(held)
                held, n = [], 0
        if held:
            yield batch(held)

    fields = ", ".join([f"conv_id {kind.simpleString()}", *(f"{c} long" for c in REPORT), "audit string", "repaired_sha256 string"])
    return ordered_rows(conversations).mapInArrow(work, fields)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut off, repeated or given the user's role by a hash of conversation and turn; dropped ones are marked ``gone``."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(name) % 20).alias("__hit"))
    text = F.when(F.col("__hit") == 1, "").when(F.col("__hit") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    role = F.when(F.col("__hit") == 4, "user").otherwise(F.col("role"))
    times_ = F.when(F.col("__hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("__hit") == 0).alias("gone"), F.explode(times_).alias("__n")).drop("__n")


def oracle() -> str:
    """The same in SQL: rows one after the other in a recursive query, with the best way to each state."""
    never = 10**9

    def way(frm: str, edits: str, cost: str, *lines: str) -> str:
        text = "".join(f" || chr(10) || {line}" for line in lines)
        return f"{{'c': {frm}.c + {cost}, 'a': {frm}.a || '{edits}', 't': {frm}.t{text}}}"

    def best(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def unless(cond: str, w: str) -> str:
        return f"CASE WHEN {cond} THEN {w} END"

    user, assistant = "'user:'", "'assistant:'"
    closed = [
        "s0", "s1", best("s2", *(way(s, "I", "2", user) for s in ("s0", "s1", "s3"))),
        best("s3", way("s2", "I", "2", assistant), *(way(s, "II", "4", user, assistant) for s in ("s0", "s1"))),
    ]

    def keep(frm: str, initial: str) -> str:
        return unless(f"NOT gone AND left(role, 1) = '{initial}'", way(frm, "K", "cut", "role || ':' || text"))

    def rerole(frm: str, role: str) -> str:
        return unless("NOT gone", way(frm, "R", "2 + cut", f"{role} || text"))

    drop = [way(f"i{k}", "D", "3") for k in range(4)]
    stepped = [
        drop[0], best(drop[1], keep("i0", "s")), best(drop[2], *(w for i in ("i0", "i1", "i3") for w in (keep(i, "u"), rerole(i, user)))),
        best(drop[3], keep("i2", "a"), rerole("i2", assistant)),
    ]
    start = ", ".join(f"{{'c': {0 if k == START else never}::INTEGER, 'a': ''::VARCHAR, 't': ''::VARCHAR}} AS s{k}" for k in range(4))
    end = best("s0", "s3", way("s2", "I", "2", assistant), *(way(s, "II", "4", user, assistant) for s in ("s0", "s1")))
    return rf"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS h FROM conversations, crc),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS again FROM hit WHERE h <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS n FROM damaged),
faults AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again_said,
  NOT regexp_matches(text, '[.!?][ 	-]*\z') AS open_end, left(lag(role) OVER (PARTITION BY conv_id ORDER BY n), 1) || left(role, 1) AS pair FROM placed),
rows_ AS (SELECT conv_id, n, turn, role, text, blank, NOT blank AND again_said AS duplicate, blank OR again_said AS gone, NOT blank AND NOT again_said AND open_end AS truncated,
  (NOT blank AND NOT again_said AND open_end)::INTEGER AS cut, coalesce(pair NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
convs AS (SELECT DISTINCT conv_id FROM conversations),
totals AS (SELECT c.conv_id, count(n) AS rows_after, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
  count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM convs c LEFT JOIN rows_ r ON c.conv_id IS NOT DISTINCT FROM r.conv_id GROUP BY c.conv_id),
dp AS (SELECT conv_id, 0 AS n, {start} FROM convs UNION ALL
  SELECT conv_id, n, {", ".join(f"{w} AS s{k}" for k, w in enumerate(stepped))} FROM (
    SELECT d.conv_id, d.n + 1 AS n, r.role, r.text, r.gone, r.cut, {", ".join(f"{w} AS i{k}" for k, w in enumerate(closed))}
    FROM dp d JOIN rows_ r ON d.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = d.n + 1)),
ends AS (SELECT d.conv_id, {end} AS e FROM dp d JOIN totals t ON d.conv_id IS NOT DISTINCT FROM t.conv_id AND d.n = t.rows_after)
SELECT t.conv_id, gaps::BIGINT AS gaps, blank, duplicate, truncated, illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(substr(e.t, 2)) AS repaired_sha256
FROM totals t JOIN ends ON t.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


@query("op12_conversation_repair", oracle())
def op12_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation after some rows were damaged."""
    return report(damage(table(spark, sf_dir, "conversations")))
