import hashlib
import random
import re

from millrace.llm.repair import BLOCK, CUT_OFF, GONE, KEPT, chart, lexical, pairwise, repair, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_audit(rows):
    """Least (cost, audit) over a row after the other, by the letters given so far and the role to come."""
    moves = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = {"": (0, "")}

    def offer(to, state, item):
        if state not in to or item < to[state]:
            to[state] = item

    def insertions(states):
        for _ in range(4):
            for state, (cost, audit) in list(states.items()):
                for role, to in moves[state].items():
                    if role != "s":
                        offer(states, to, (cost + 2, audit + "I"))
        return states

    for initial, fault in rows:
        after = {}
        for state, (cost, audit) in insertions(best).items():
            offer(after, state, (cost + 3, audit + "D"))
            if fault in (None, "truncated"):
                late = int(fault == "truncated")
                if initial in moves[state]:
                    offer(after, moves[state][initial], (cost + late, audit + "K"))
                for role, to in moves[state].items():
                    if role != "s":
                        offer(after, to, (cost + late + 2, audit + "R"))
        best = after
    return min(v for k, v in insertions(best).items() if k in ("", "a"))


def plain(rows):
    """The contract for one conversation's rows, already damaged."""
    rows = sorted(((t is not None, t or 0, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows))
    seen, marked = set(), []
    for _, _, r, x in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", x)
        fault = "blank" if not last else "duplicate" if (r, x) in seen else None if last[-1] in ".!?" else "truncated"
        seen.add((r, x))
        marked.append((r[:1], fault))
    turns = [t for known, t, _, _ in rows if known]
    cost, audit = plain_audit(marked)
    out, at = [], 0
    left = iter(rows)
    total = len(audit) - audit.count("D")
    for letter in audit:
        row = next(left) if letter != "I" else None
        if letter == "D":
            continue
        out.append(f"{row[2] if letter == 'K' else ['user', 'assistant'][(at - total % 2) % 2]}:{row[3] if row else ''}")
        at += 1
    pairs = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:], strict=False))
    count = lambda f: sum(x == f for _, x in marked)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, count("blank"), count("duplicate"), count("truncated"), pairs, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_every_split_gives_the_cell():
    rng = random.Random(3)
    for n in range(1, 40):
        word = "".join(rng.choice(KEPT + KEPT + CUT_OFF + GONE) for _ in range(n))
        cells = pairwise([lexical(c) for c in word])
        if n <= BLOCK:
            assert chart(word) == cells
        fault = {**dict.fromkeys(KEPT), **dict.fromkeys(CUT_OFF, "truncated"), **dict.fromkeys(GONE, "blank")}
        rows = [("suax"[(KEPT.find(c) + 1 or CUT_OFF.find(c) + 1 or GONE.find(c) + 1) - 1], fault[c]) for c in word]
        assert min(cells[0, 0], cells[0, 3]) == plain_audit(rows)


def test_against_plain_reading(spark):
    rng = random.Random(11)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", None, "", "User"]
    texts = ["A.", "b", " \t", "", None, "Ende! ", "Was?\n", "é.", "x. y"]
    rows = []
    for conv in [*range(40), -7]:
        for _ in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
    for conv, n in ((100, 17), (101, 300)):  # several blocks, several levels
        rows += [(conv, t // 2 * 3, rng.choice(roles[:6]), rng.choice([f"t{t}.", "b", "same."])) for t in range(n)]
    rows += [(None, 0, "user", "a."), (None, 0, "user", "a.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "'x' AS block", "2 AS cell")
    got = {r[0]: tuple(r[1:]) for r in repair(df).collect()}
    want = {}
    for conv in {r[0] for r in rows}:
        want[conv] = plain([r[1:] for r in rows if r[0] == conv])
    assert got == want
    whole = repaired_turns(df).collect()
    for conv in want:
        turns = sorted((r.n, f"{r.role}:{r.text}") for r in whole if r.conv_id == conv)
        assert hashlib.sha256("\n".join(t for _, t in turns).encode()).hexdigest() == want[conv][-1]


def test_empty_table_and_conversations_that_lose_all(spark):
    assert repair(spark.createDataFrame([], SCHEMA)).collect() == []
    import zlib

    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    (row,) = repair(spark.createDataFrame([(gone, 0, "user", "x.")], SCHEMA), damage=True).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    null = spark.createDataFrame([(1, None, None, None)], SCHEMA)
    assert tuple(repair(null).first())[1:7] == (0, 1, 0, 0, 0, 3)
