import hashlib
import random
import zlib

from roadglass.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    convs = {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}
    members, ends = {}, {}
    for c, own in convs.items():
        p, h = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100)), zlib.crc32(str(c).encode()) % 6
        path = tuple(convs.get(p, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    out = set()
    for node, own in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        sha = hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children), len(leaves), saved, sha))
    return out


def run(spark, rows, parts=3):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as c", "2 as D", "'x' as key", "3 as pos")
    out = trie.conversation_trie(df.repartition(parts))
    assert out.columns[:8] == COLUMNS
    rows = out.collect()
    # Positions are 1 to the number of nodes, and a subtree is an interval that holds its children's.
    assert sorted(r["position"] for r in rows) == list(range(1, len(rows) + 1))
    assert all(r["position"] <= r["subtree_end"] for r in rows)
    top = [r for r in rows if r["depth"] == 0]
    assert not rows or [(r["position"], r["subtree_end"]) for r in top] == [(1, len(rows))]
    got = [tuple(r[c] for c in COLUMNS) for r in rows]
    assert len(got) == len(set(got))
    return set(got)


def test_as_brute_force(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rng = random.Random(5)
    texts = ["", "a", "b", "né", "🎉🎉", None]
    rows = [(c, t, rng.choice(["user", "bot", None]), rng.choice(texts)) for c in [*range(0, 260), -7, -100, 1000, 2**60] for t in range(rng.randint(1, 7))]
    rows += [(5, None, "user", "null first"), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (None, 0, "user", "no id")]
    rows += [(300 + i, t, "user", f"same {t}") for i in range(60) for t in range(8)]  # copies
    rows += [(701, 0, "user", "its parent is absent")] + [(700 + i, 0, "user", "x") for i in range(2, 20)]  # some turnless
    assert run(spark, rows) == brute(rows)


def test_long_conversation_and_a_caterpillar(spark):
    """A conversation over many range partitions, and one that branches at every turn."""
    rows = [(0, t, "user", f"turn {t % 7}") for t in range(600)]
    rows += [(100 * (1 + i), t, "user", f"turn {t % 7}") for i in range(25) for t in range(i)]
    assert run(spark, rows) == brute(rows)


def test_few_and_none(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, 1, "user", "x")]) == set()
    one = [(0, 3, None, None)]
    assert run(spark, one) == brute(one)
    long = [(0, 0, "user", "é" * 300_000), (100, 0, "user", "é" * 300_000), (200, 0, "usere", "")]
    assert run(spark, long) == brute(long)
    repeated = [(0, 1, "user", "again")] * 50 + [(100, 1, "user", "again")] * 3
    assert run(spark, repeated, 4) == brute(repeated)
