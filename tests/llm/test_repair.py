"""Conversation repair: matrices over the grammar against a search of all edits, and rows at the edges."""

import hashlib
import itertools
import random
import re

import pytest

from callgauge.llm import repair

LEGAL = re.compile(r"(s?(ua)+)?")
CONV = "conv_id bigint, turn bigint, role string, text string"


def cheapest(rows):
    """(cost, edits, lines) of the cheapest repair of ``rows`` (role, text, required, truncated), by trying all edits with few insertions."""
    best = None
    for edits in itertools.product(*[["D"] if r[2] else ["D", "K", "Ru", "Ra"] for r in rows]):
        # up to two insertions at each place are ever of use
        for puts in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for put, edit, row in itertools.zip_longest(puts, edits, rows):
                cost += 2 * len(put)
                audit += "I" * len(put)
                lines += [({"u": "user", "a": "assistant"}[p], "") for p in put]
                if edit:
                    audit += edit[0]
                    cost += {"D": 3, "K": 0, "R": 2}[edit[0]] + (row[3] and edit != "D")
                    lines += [] if edit == "D" else [(row[0] if edit == "K" else {"Ru": "user", "Ra": "assistant"}[edit], row[1])]
            if (best is None or (cost, audit) < best[:2]) and all(role for role, _ in lines) and LEGAL.fullmatch("".join(role[0] for role, _ in lines)):
                best = (cost, audit, lines)
    return best


def plain_report(rows):
    """Report of one conversation's sorted rows (turn, role, text), by definition."""
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, lines = cheapest([(role, text, f in ("blank", "duplicate"), f == "truncated") for (_, role, text), f in zip(rows, faults)])
    text = "\n".join(f"{role}:{text}" for role, text in lines)
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()), lines


def one_after_the_other(codes):
    """Cheapest cost and edits with plain strings, row by row."""
    best = {repair.START: (0, "")}

    def grow(ways, matrix):
        out = {}
        for p, (cost, edits) in ways.items():
            for q, entry in enumerate(matrix[p]):
                if entry:
                    way = (cost + entry[0], edits + "".join(repair.leaves(entry[1])))
                    out[q] = min(out.get(q, way), way)
        return out

    for code in codes:
        best = grow(best, repair.row_matrix(code))
    best = grow(best, repair.insertions())
    return min(best[q] for q in repair.FINAL if q in best)


@pytest.mark.parametrize("seed", range(3))
def test_grammar_agrees_with_rows_one_by_one(seed):
    rng = random.Random(seed)
    phrases = [bytes(rng.randrange(repair.SYMBOLS) for _ in range(rng.randint(1, 30))) for _ in range(12)]
    sequences = [b"", bytes([3]) * 301, bytes(rng.randrange(repair.SYMBOLS) for _ in range(2000))]
    sequences += [b"".join(rng.choices(phrases, k=rng.randint(1, 20))) for _ in range(60)]
    grammar = repair.Grammar()
    left = grammar.compress(sequences, [rng.randint(1, 5) for _ in sequences])
    halves = {number: pair for pair, number in grammar.rules.items()}

    def spell(s):
        return [s] if s < repair.SYMBOLS else [x for half in halves[s] for x in spell(half)]

    assert [[x for s in symbols for x in spell(s)] for symbols in left] == [list(s) for s in sequences]
    # no pair is left twice, and rules are shared
    pairs = [p for symbols in left for p in zip(symbols, symbols[1:])]
    assert sum(map(len, left)) < sum(map(len, sequences)) / 2 and len(set(p for p in pairs if p[0] != p[1])) == len([p for p in pairs if p[0] != p[1]])
    for sequence, symbols in zip(sequences, left):
        assert grammar.solve(symbols) == one_after_the_other(sequence)


def test_ropes_compare_like_strings():
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choices("DK", k=rng.randint(150, 400)))
        other = text[:-60] + ("D" if text[-60] == "K" else "K") + text[-59:]

        def rope(t):
            if len(t) <= repair.LEAF:
                return t
            cut = rng.randint(1, len(t) - 1)
            return repair.concat(rope(t[:cut]), rope(t[cut:]))

        a, b = rope(text), rope(other)
        assert "".join(repair.leaves(a)) == text and repair.less(a, b) == (text < other) and repair.less(b, a) == (other < text) and not repair.less(a, a)


def conversations(seed, n):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.randint(0, 3)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "u2", None])
            text = rng.choice(["Yes.", "No?  ", "cut off", "", " \n", None, "Wow!\u0085", "A\nline."])
            rows.append((conv if rng.random() < 0.9 else None, rng.choice([turn, turn, turn + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("block", [repair.BLOCK_ROWS, 3])
def test_report_and_repaired_rows(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK_ROWS", block)
    rows = [r for r in conversations(7, 40) if r[0] is not None]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 AS later", "2 AS cost", "'x' AS hash")
    want, lines = {}, []
    for conv in {r[0] for r in rows}:
        mine = sorted(((t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        want[conv], repaired = plain_report(mine)
        lines += [(conv, i, role, text) for i, (role, text) in enumerate(repaired)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.report(df).collect()}
    assert got == want
    assert sorted(tuple(r) for r in repair.repair(df).collect()) == sorted(lines)


def test_edges(spark):
    none = hashlib.sha256(b"").hexdigest()
    rows = [(None, 1, "user", "Hi."), (None, 2, "assistant", "Yes."), (1, None, "user", "Hi."), (1, None, "assistant", "Yes."), (2, 5, "user", "x" * 100_000 + "."), (2, 5, "user", "x" * 100_000 + "."), (2, 9, "assistant", "So.")]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "false AS gone").unionByName(spark.createDataFrame([(3, 1, "user", "Hi.")], CONV).selectExpr("*", "true AS gone"))
    got = {r.conv_id: r for r in repair.report(df).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert (got[None].audit, got[None].gaps, got[1].gaps, got[2].gaps) == ("KK", 0, 0, 3)
    assert (got[1].audit, got[1].cost, got[1].illegal) == ("IKKI", 4, 0)
    assert (got[2].duplicate, got[2].audit, got[2].cost) == (1, "KDK", 3)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", none)
    assert repair.report(df.filter("false")).count() == 0 and repair.repair(df.filter("false")).count() == 0
    assert dict(repair.damage(df.drop("gone")).dtypes) == dict(conv_id="bigint", turn="bigint", role="string", text="string", gone="boolean")
    words = repair.report(spark.createDataFrame([("a", 1, "user", "Hi."), ("b", 1, "system", "Be good.")], CONV.replace("conv_id bigint", "conv_id string")))
    assert {(r.conv_id, r.audit) for r in words.collect()} == {("a", "KI"), ("b", "D")}


def test_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "HELD_BYTES", 1000)
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"Turn {i}{'.' if i % 7 else ''}") for i in range(6000) if i % 11]
    got = repair.report(spark.createDataFrame(rows, CONV)).collect()[0]
    codes = [repair.symbol(role, not text.endswith(".")) for _, _, role, text in rows]
    assert (got.cost, got.audit) == one_after_the_other(codes) and got.gaps == 5999 - len(rows)
