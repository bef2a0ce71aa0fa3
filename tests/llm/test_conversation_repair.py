"""Repair plans against a search over all edits, and whole tables against a row-by-row version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quillmark.llm import conversation_repair as R

KIND = "conv_id long, turn long, role string, text string, cost string, audit int"
NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(name.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(rows):
    """rows: (role, text, fault). Cost, audit and repaired lines by dynamic programming over (row, state)."""
    # inserts make a graph with positive steps: relax until nothing changes
    table = {}
    for i in range(len(rows), -1, -1):
        level = {}
        for state in NEXT:
            options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
            if i < len(rows):
                role, text, fault = rows[i]
                extra = 3 if fault == "truncated" else 0
                want = NEXT[state]
                full = {"u": "user", "a": "assistant"}[want]
                steps = [("D", 4, state, ())]
                if fault not in ("blank", "duplicate"):
                    steps.append(("R", 3 + extra, want, (f"{full}:{text}",)))
                    if role[:1] == want or (role[:1] == "s" and state == ""):
                        steps.append(("K", extra, role[:1], (f"{role}:{text}",)))
                for edit, cost, to, line in steps:
                    c, audit, lines = table[i + 1][to]
                    options.append((c + cost, edit + audit, line + lines))
            level[state] = min(options, default=(10**9, "", ()))
        changed = True
        while changed:
            changed = False
            for state, want in NEXT.items():
                c, audit, lines = level[want]
                full = {"u": "user", "a": "assistant"}[want]
                if (c + 3, "I" + audit) < level[state][:2]:
                    level[state] = (c + 3, "I" + audit, (f"{full}:", *lines))
                    changed = True
        table[i] = level
    return table[0][""]


def brute(original):
    rows, out = hurt(original), {}
    for conv in {r[0] for r in original}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (
            r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        turns = {r[0] for r in own} - {None}
        seen, judged = set(), []
        for _, role, text in own:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not words else "duplicate" if (role, text) in seen
                     else "truncated" if words[-1] not in ".!?" else None)
            seen.add((role, text))
            judged.append((role, text, fault))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines = cheapest(judged)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(j[2] == f for j in judged) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why? ", "é! ", "Fine.\r\n", None, "x" * 5000 + "."]
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "umpire"]
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice([1, 2, 3, 5, 8, 30])):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            text = rng.choice(texts) if rng.random() < 0.4 else f"Turn {rng.randrange(99)}{rng.choice('.!?,')}"
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), role, text))
        if rng.random() < 0.2:
            rows += rows[-2:]  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 3), (3, 1)])
def test_matches_brute_force(spark, seed, block):
    rows = conversations(seed)
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], KIND).repartition(5)
    out = R.repair(R.damage(table), table, block)
    assert out.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv


def test_edits_are_cheapest_by_trying_all():
    """Every way to edit a few rows, against the automaton's nodes."""
    rng = random.Random(9)
    for _ in range(60):
        letters = "".join(rng.choice("dsuaxSUAX") for _ in range(rng.randrange(4)))
        node = R.END
        for letter in reversed(letters):
            node = R.before(node, letter)
        found = []
        for edits in itertools.chain.from_iterable(itertools.product("DIKR", repeat=n) for n in range(len(letters) + 4)):
            if len(edits) - edits.count("I") != len(letters):
                continue
            state, cost, left = "", 0, iter(letters)
            for e in edits:
                if e == "I":
                    state, cost = NEXT[state], cost + 3
                    continue
                row = next(left)
                kind, extra = row.lower(), 3 * (row != row.lower())
                if e == "D":
                    cost += 4
                elif kind == "d" or (e == "K" and kind != NEXT[state] and not (kind == "s" and state == "")):
                    cost += 10**6
                else:
                    state, cost = (kind if e == "K" else NEXT[state]), cost + extra + 3 * (e == "R")
            if state in ("", "a"):
                found.append((cost, "".join(edits)))
        assert min(found) == node[0][:2], letters


def test_one_long_conversation_in_many_blocks(spark):
    rows = [(7, i, ("user", "assistant")[i % 2 if i % 97 else 0], f"Text {i % 450}.") for i in range(900)]
    table = spark.createDataFrame([(*r, "", 0) for r in rows], KIND)
    out = {r[0]: tuple(r)[1:] for r in R.repair(R.damage(table), table, 64).collect()}
    assert out == brute(rows)
    blocks = R.signatures(R.judged(R.damage(table)), 64)
    assert blocks.count() > 10 and blocks.selectExpr("max(length(tail))").first()[0] == 64


def test_nodes_are_shared_between_conversations(monkeypatch):
    import pyarrow as pa

    made = []
    plain = R.before
    monkeypatch.setattr(R, "before", lambda node, letter: made.append(letter) or plain(node, letter))
    tails = sorted({"aua"[:k] + "u" * j for k in range(4) for j in range(6)})
    batch = pa.RecordBatch.from_arrays([pa.array(["end"] * len(tails)), pa.array(tails)], ["border", "tail"])
    out = [r for b in R.solve(iter([batch])) for r in b.to_pylist()]
    assert len(out) == len(tails) and len(made) == len({t[:k] for t in tails for k in range(1, len(t) + 1)})


def test_empty_table(spark):
    empty = spark.createDataFrame([], KIND)
    assert R.repair(R.damage(empty), empty).count() == 0
