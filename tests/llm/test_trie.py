"""The trie of conversations against brute force over whole prefixes."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import queries, trie


def brute(rows):
    """Rows as the contract states them, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    made = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        made[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[tuple(made[c][:d])].append(c)
        ends[tuple(made[c])].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for key in members:
        if key:
            children[key[:-1]] += 1
    for key, cs in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", key[-1][1])) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += not children[key]
            saved[key[:d]] += (len(cs) - 1) * words
    return sorted((cs[0], len(k), members[k[:-1]][0] if k else -1, len(cs), children[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, cs in members.items())


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*COLUMNS).collect())


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert plain(queries.op12_trie(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("leaf", [1, 2, 4, 64])
def test_any_piece_size(spark, leaf):
    """Shared beginnings, long and short conversations, ties, nulls, repeated rows, ids without a base, a turnless one."""
    rng = np.random.default_rng(leaf)
    rows = []
    for c in [*range(0, 45), *rng.integers(60, 10**12, 10).tolist(), -7, -40, -33]:
        length = int(rng.choice([1, 2, 3, 5, 8, 13, 40]))
        rows += [(c, int(k), str(rng.choice(["user", "assistant"])), str(rng.choice(["a", "b c", " d\te f ", ""]))) for k in range(length)]
        if c % 3 == 0:  # like another, down to the end
            rows += [(c + 1000, k, "user", "again and again") for k in range(30)]
    rows += [(7, None, None, None), (7, None, "user", "first"), (7, None, "user", "first"), (8, 3, "user", "x" * 40), (8, 3, "user", "y" * 70), (None, 1, "user", "nobody's"), (1, 0, "user", "a")]
    rng.shuffle(rows)
    df = spark.createDataFrame([tuple(None if v is None else v for v in r) for r in rows], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS depth", "'x' AS name_a").repartition(5)
    df = df.withColumns({"conv_id": df.conv_id.cast("long"), "turn": df.turn.cast("long")})
    got = plain(trie.prefix_trie(df, leaf=leaf))
    assert got == brute([(None if c is None else int(c), None if t is None else int(t), r, x) for c, t, r, x in rows])


def test_one_long_conversation_lies_in_many_ranges(spark):
    rows = spark.range(3000).selectExpr("20 AS conv_id", "id AS turn", "'user' AS role", "concat('w ', id % 7) AS text")
    rows = rows.union(spark.range(2500).selectExpr("cast(40 + id % 2 AS int) AS conv_id", "id div 2 AS turn", "'user' AS role", "concat('w ', (id div 2) % 7) AS text")).repartition(6)
    rows = rows.selectExpr("cast(conv_id AS long) AS conv_id", "turn", "role", "text")
    places = trie.turns(rows).filter("conv_id = 20").selectExpr("min(place)", "max(place)", "count(distinct place)").first()
    assert tuple(places) == (1, 3000, 3000)
    got = {(r.depth, r.conv_id): r for r in trie.prefix_trie(rows).collect()}
    root = got[0, 20]
    assert (root.n_convs, root.n_children) == (3, 1)
    assert max(d for d, _ in got) == 3000
    assert got[3000, 20].n_leaves == 1 and got[3000, 20].n_convs == 1
    assert got[1, 20].n_leaves == 1 and got[1, 20].n_convs == 3
    assert got[1, 20].saved_tokens == root.saved_tokens == sum((r.n_convs - 1) * 2 for (d, _), r in got.items() if d)


def test_empty_table(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.prefix_trie(df).columns == COLUMNS
    assert trie.prefix_trie(df).count() == 0


def test_only_turnless_conversations(spark):
    """Without a base, a conversation no longer than what it takes from there has no turn; the root is then the only node."""
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, 0, "user", "a"), (c, 1, "user", "b")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = plain(trie.prefix_trie(df))
    assert got == brute(rows) and len(got) == 1 and got[0][3:6] == (1, 0, 1)
