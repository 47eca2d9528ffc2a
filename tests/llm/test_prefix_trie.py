"""The prefix tree of conversations against a tree built turn by turn, and against its SQL."""

import hashlib
import random
import re
import zlib

import duckdb

from spanwright.llm import prefix_trie

KIND = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sequences(rows):
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    return {c: [x for _, x in sorted(turns, key=lambda t: t[0])] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    children, saved, leaves = {k: 0 for k in nodes}, {k: 0 for k in nodes}, {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(members) - 1) * words
            leaves[k[:d]] += not children[k]
    ends = {k: ",".join(map(str, sorted(c for c in m if len(convs[c]) == len(k)))) for k, m in nodes.items()}
    return sorted(((min(m), len(k), min(nodes[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in nodes.items()), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def cases():
    r = random.Random(5)
    say = lambda: " ".join(r.choice("abc") for _ in range(r.randint(0, 3)))
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice([say(), "hello there", None])) for c in [*range(-25, 60), *range(100, 130)] for t in range(r.choice([1, 1, 2, 3, 5]))]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 290) for t in range(4)]  # a hot whole conversation, and one that goes on
    rows += [(c, t, "user", f"same {t}") for c in range(300, 310) for t in range(6)]
    rows += [(400, t, "user", f"w{t % 7} x") for t in range(700)] + [(420, t, "user", f"w{t % 7} x") for t in range(650)]  # long ones
    rows += [(61, None, "user", "no number"), (61, 0, "user", "first"), (61, 0, "user", "first"), (61, 0, None, "tie"), (61, 5, None, None), (None, 1, "user", "nobody's"), (62, 1, "a", "b"), (63, 1, "1:a", "b"), (64, 1, "", "1:ab")]
    r.shuffle(rows)
    return rows


def test_trie_matches_brute_force(spark):
    from pyspark.sql import functions as F

    rows = cases()
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("other") for c in ("block", "at", "depth", "words", "k1", "base", "n")})
    assert rows_of(prefix_trie.prefix_trie(df)) == brute(sequences(rows))
    assert prefix_trie.prefix_trie(spark.createDataFrame([], KIND)).collect() == []


def test_rebuilt_conversations_over_many_blocks(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")  # so that long conversations lie over several blocks
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        turns = prefix_trie.ordered_turns(spark.read.parquet(str(tmp_path / "conversations.parquet")))
        assert turns.where("conv_id = 400").select("block").distinct().count() > 2
        got = rows_of(prefix_trie.op13_prefix_trie(spark, str(tmp_path)))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert got == brute(rebuilt(sequences(rows)))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet') WHERE conv_id NOT IN (400, 420)")
    spark.read.parquet(str(tmp_path / "conversations.parquet")).where("conv_id NOT IN (400, 420) OR conv_id IS NULL").write.parquet(str(tmp_path / "short" / "conversations.parquet"))
    want = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.OP13_SQL})").fetchall()
    assert rows_of(prefix_trie.op13_prefix_trie(spark, str(tmp_path / "short"))) == sorted(map(tuple, want), key=str)


def test_lists_of_ends_are_hashed_in_pieces(spark):
    ends = spark.range(0, 5000).selectExpr("id % 3 AS depth", "id % 3 AS k1", "0L AS k2", "id * 7 AS conv_id")
    got = {r["depth"]: r["ends_sha256"] for r in prefix_trie.end_hashes(ends.repartition(6)).collect()}
    assert got == {d: hashlib.sha256(",".join(str(i * 7) for i in range(5000) if i % 3 == d).encode()).hexdigest() for d in range(3)}
