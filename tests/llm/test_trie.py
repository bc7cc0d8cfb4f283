import collections
import hashlib
import random
import zlib

import pytest

from touchline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, at string, n string, a string"


def rebuild(rows):
    """Rows (conv_id, turn, role, text) as lists of (role, text), by conversation."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            own[c].append((turn is not None, turn or 0, digest, role, text))
    turns = {c: [(r, x) for *_, r, x in sorted(t)] for c, t in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    return {c: turns.get(c - c % 100, [])[: h[c]] + turns[c][h[c] :] for c in turns}


def brute_force(convs):
    """The nodes of the trie, from all prefixes."""
    members = collections.defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = {}
    for node, own in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = [x for x in below if len(x) == len(node) + 1]
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(node))
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        leaves = sum(not any(y[: len(x)] == x and len(y) > len(x) for y in below) for x in below)
        up = min(members[node[:-1]]) if node else None
        out[min(own), len(node)] = (up, len(own), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def conversations(seed, n=60):
    """Few texts, so that beginnings agree; odd numbers of turns, ids with gaps, ties, nulls."""
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 400), n) + [None]:
        for t in range(rng.choice([1, 2, 3, 7, 9])):
            turn = rng.choice([t, t, t, None, 0])
            rows.append((c, turn, rng.choice(["user", "user", None, ""]), rng.choice(["a", "a", "", "hé", None])))
    return rows


def found(spark, rows):
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)
    out = trie.rebuilt_trie(table).collect()
    got = {(r["conv_id"], r["depth"]): tuple(r)[2:] for r in out}
    assert len(got) == len(out)
    return got


@pytest.mark.parametrize("width", [trie.WIDTH, 2])
def test_against_all_prefixes(spark, monkeypatch, width):
    """Blocks of two turns make every conversation span blocks."""
    monkeypatch.setattr(trie, "WIDTH", width)
    rows = conversations(width)
    assert found(spark, rows) == brute_force(rebuild(rows))


def test_one_conversation_over_many_tasks_and_long_texts(spark):
    rows = [(7, i, "user", f"t{i % 50}") for i in range(3000)] + [(0, i, "user", "x" * 100_000) for i in range(4)] + [(9, None, None, None)] * 40
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = found(spark, rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    convs = rebuild(rows)
    nodes = {tuple(t[:d]) for t in convs.values() for d in range(len(t) + 1)}
    assert len(got) == len(nodes)
    root = got[0, 0]
    assert root[1] == 3 and root[3] == len({tuple(t) for t in convs.values()})
    assert max(d for c, d in got if c == 7) == len(convs[7])


def test_conversations_left_without_turns(spark):
    """Ids whose first conversation is missing and whose own turns are all replaced."""
    rows = [(c, 0, "user", "a") for c in range(1, 40)]
    convs = rebuild(rows)
    assert any(not t for t in convs.values())
    assert found(spark, rows) == brute_force(convs)


def test_no_conversations(spark):
    assert found(spark, []) == {} and found(spark, [(None, 1, "user", "a")]) == {}


def test_ends_over_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, 0, "user", "a") for c in range(-30, 60)]
    assert found(spark, rows) == brute_force({c: t for c, t in rebuild_signed(rows).items()})


def rebuild_signed(rows):
    """As rebuild, with the remainder taken as SQL does, with the sign of the id."""
    turns = collections.defaultdict(list)
    for c, _, role, text in rows:
        turns[c].append((role, text))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in turns}
    base = {c: c - (abs(c) % 100) * (1 if c >= 0 else -1) for c in turns}
    return {c: turns.get(base[c], [])[: h[c]] + turns[c][h[c] :] for c in turns}
