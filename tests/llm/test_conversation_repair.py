"""The repair against a walk over all edits in plain Python, over long and odd conversations, and its defined cases."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from emberlake.llm import conversation_repair as repair

SCHEMA = "conv_id long, turn long, role string, text string, fault string, `key` int"


def damaged(rows):
    for conv, turn, role, text in rows:
        what = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if what:
            role = "user" if what == 4 else role
            text = "" if what == 1 else "".join(c for c in text if c not in ".!?") if what == 2 else text
            yield from [(conv, turn, role, text)] * (2 if what == 3 else 1)


def expected(rows):
    """Least (cost, audit) over all ways through the rows, with the repaired lines; one string of roles at a time."""
    groups = {conv: [] for conv, *_ in rows}
    for r in damaged(rows):
        groups[r[0]].append(r[1:])
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, *_ in own if t is not None]
        count, seen, faults = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in own:
            bare = text.strip(repair.SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            if fault:
                count[fault] += 1
        # states by the roles so far: "" none, s, u, a; values: least (cost, audit, lines)
        ways = {"": (0, "", ())}

        def step(state, role):
            return role if (state, role) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")} else None

        def inserted(ways):
            for _ in range(3):
                for state, (cost, audit, lines) in list(ways.items()):
                    for new in ("user", "assistant"):
                        to = step(state, new[0])
                        if to:
                            ways[to] = min(ways.get(to, (1 << 40,)), (cost + 5, audit + "I", (*lines, new + ":")))
            return ways

        for (_, role, text), fault in zip(own, faults):
            new = {}
            extra = 5 if fault == "truncated" else 0
            for state, (cost, audit, lines) in inserted(ways).items():
                choices = [(state, 2, "D", lines)]
                if fault not in ("blank", "duplicate"):
                    choices.append((step(state, role[:1]), extra, "K", (*lines, f"{role}:{text}")))
                    choices += [(step(state, r[0]), 1 + extra, "R", (*lines, f"{r}:{text}")) for r in ("user", "assistant")]
                for to, more, letter, out in choices:
                    if to is not None:
                        new[to] = min(new.get(to, (1 << 40,)), (cost + more, audit + letter, out))
            ways = new
        cost, audit, lines = min(v for k, v in inserted(ways).items() if k in ("", "a"))
        roles = [r[:1] for _, r, _ in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        yield (conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def run(spark, tmp_path, rows, parts=7):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    (df.repartition(parts) if parts else df).write.parquet(f"{tmp_path}/conversations.parquet")
    return repair.op11_conversation_repair(spark, str(tmp_path))


def check(spark, tmp_path, rows):
    got = {tuple(r) for r in run(spark, tmp_path, rows).collect()}
    assert got == set(expected(rows)) and len(got) == len({r[0] for r in rows})


def test_long_and_odd_conversations(spark, tmp_path):
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "umpire"]
    texts = ["Well.", "No end", "", " \t\x0b", None, "What? ", "Same.", "Same.", "a\nb!", ".", "\xa0"]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for c in range(60) for _ in range(rng.randrange(9))]
    rows += [(None, t, roles[t % 2], f"Line {t}") for t in range(5)]
    # long ones: over one block, and over blocks of blocks
    for conv, n in ((1000, repair.SPAN), (1001, repair.SPAN + 1), (1002, 700), (1003, repair.SPAN * repair.FAN_IN + 300)):
        rows += [(conv, t * 2, rng.choice(roles[:5]) if rng.random() < 0.2 else roles[t % 2], f"Part {t}." if rng.random() < 0.9 else "Part") for t in range(n)]
    rows += [(1004, None, "user", "Copy.")] * 400  # one group of copies
    check(spark, tmp_path, rows)


def test_all_dropped_and_empty(spark, tmp_path):
    gone = [(c, 0, "user", "Hi.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = run(spark, tmp_path / "gone", gone).collect()
    assert len(got) == len(gone) > 3
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert run(spark, tmp_path / "empty", [], 0).count() == 0


@pytest.mark.parametrize("codes", ["e", "ei", "iiii", "mmm", "eieaia", "hlhl"])
def test_every_split_gives_the_same_cells(codes):
    whole = repair.parse(codes)
    for k in range(1, len(codes)):
        assert repair.combine([repair.parse(codes[:k]), repair.parse(codes[k:])]) == whole


def test_repaired_rows_follow_the_order(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "assistant", "Cut"), (2, 0, "assistant", "Yes.")]
    found, fixed = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in found.collect()} == {1: (3, "KRD"), 2: (2, "D")}
    assert [(r["role"], r["text"], r["edit"]) for r in fixed.orderBy("key", "place").collect()] == [("user", "Hi.", "K"), ("assistant", "There.", "R")]
