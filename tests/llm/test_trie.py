import hashlib
import random
import zlib

from millrace.llm.trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    whole = {}
    for c, v in convs.items():
        h, first = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c > 0 else -1)
        whole[c] = tuple((r, x) for *_, r, x in sorted(convs.get(first, []))[:h] + sorted(v)[h:])
    members, children = {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    out = []
    for s, m in members.items():
        under = [w for w in members if w[: len(s)] == s]
        saved = sum((len(members[w]) - 1) * len(w[-1][1].encode()) for w in under if w)
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == s)
        parent = min(members[s[:-1]]) if s else None
        out.append((min(m), len(s), parent, len(m), len(children.get(s, [])), sum(w not in children for w in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_against_plain_trie(spark):
    rng = random.Random(7)
    rows = []
    for conv in [*range(60), -3, -8]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((conv, rng.choice([turn, turn, None]), rng.choice(["user", None, "a"]), rng.choice(["é", "", None, "long text", "x"])))
    rows += [(c, t, "user", f"hi {t}") for c in range(200, 320) for t in range(2)]  # many alike
    rows += [(500, t, "user", f"t{t % 3}") for t in range(400)]  # one long
    rows += [(7, 0, "user", "x")] * 3 + [(None, 0, "user", "x")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS l0", "2 AS least", "3 AS bytes")
    assert sorted(repr(tuple(r)) for r in prefix_trie(df).collect()) == plain(rows)


def test_pieces_of_one_list(spark, monkeypatch):
    from millrace.llm import trie

    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(c, 0, "user", "same") for c in range(5, 500, 5)]
    got = [tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(map(repr, got)) == plain(rows)


def test_empty_and_turnless(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    lone = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(lone, 0, "user", "x")]  # its family's first conversation is absent, and its own turn falls to the head
    assert [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]
