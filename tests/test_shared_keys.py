"""Many rows on both sides of one key: labels that many share, sessions of many tokens."""

import random

from helpers import at
from pyspark.sql import functions as F

from checks import registry
from lifelog.operators import joins, ordered
from lifelog.plans import ledger

rng = random.Random(11)


def _counted(monkeypatch, name):
    """Rows that each call of a ``joins`` function is given."""
    seen, real = [], getattr(joins, name)

    def spy(df, *args):
        seen.append(df.count())
        return real(df, *args)

    monkeypatch.setattr(joins, name, spy)
    return seen


def test_links_and_people_of_a_label_do_not_meet_pairwise(spark, monkeypatch):
    links = [(i, f"u{i}", rng.choice(["A", "a", "b", "c"]), rng.choice(["verified", "verified", "pending"])) for i in range(60)]
    people = [(p, rng.choice(["a", "A", "B"]), rng.choice([None, at(rng.randrange(9))])) for p in range(50)]
    seen = _counted(monkeypatch, "latest_by")
    l_df = spark.createDataFrame(links, "id long, user_id string, gamertag string, status string")
    p_df = spark.createDataFrame(people, "id long, gamertag string, last_seen_at timestamp")
    for how in ("inner", "left"):
        got = joins.resolve_links(l_df, p_df, how)
        want = []
        for i, _, tag, status in links:
            pool = [(s is not None, s or at(0), -p) for p, g, s in people if g.lower() == tag.lower()]
            if status == "verified" and (pool or how == "left"):
                want.append((i, -max(pool)[2] if pool else None))
        assert sorted((r.link_id, r.player_id) for r in got.collect()) == sorted(want)
    assert max(seen) <= len(links)


def test_avatars_of_shared_labels_do_not_meet_pairwise(spark, monkeypatch):
    links = [(i, f"u{i}", rng.choice("ABC"), rng.choice(["verified", "pending"])) for i in range(60)]
    pictures = [(f"u{i}", f"h{i}") for i in range(60) if i % 3]
    held = sorted({(p, rng.choice("abcd")) for p in range(40) for _ in range(2)})
    now = [(p, rng.choice("ABD")) for p in range(40)]
    seen = _counted(monkeypatch, "first_by")
    got = joins.avatar_hash(
        spark.createDataFrame(now, "player_id long, gamertag string"),
        spark.createDataFrame(links, "id long, user_id string, gamertag string, status string"),
        spark.createDataFrame(pictures, "user_id string, hash string"),
        spark.createDataFrame(held, "player_id long, gamertag string"))
    best = {}
    for i, u, tag, status in links:
        if status == "verified" and i % 3:
            best.setdefault(tag.lower(), i)
    want = []
    for p, tag in now:
        past = [best[t] for q, t in held if q == p and t in best]
        mine = best.get(tag.lower(), min(past, default=None))
        want.append((p, None if mine is None else f"h{mine}"))
    assert sorted((r.player_id, r.avatar_hash) for r in got.collect()) == sorted(want)
    assert max(seen) <= len(held)


def test_pairs_of_a_hot_key_spread_over_tasks(spark):
    left = [(rng.choice([1, 1, 1, 2, 3, None]), i) for i in range(400)] + [(1, 5)] * 2
    right = [(rng.choice([1, 1, 1, 2, 4, None]), i) for i in range(300)]
    joined = joins.block_join(
        spark.createDataFrame(left, "k int, a int"), spark.createDataFrame(right, "k int, b int"), ["k"], block=20)
    want = sorted((k, a, b) for k, a in left if k is not None for q, b in right if q == k)
    assert sorted((r.k, r.a, r.b) for r in joined.select("k", "a", "b").collect()) == want
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < len(want) / 8


def test_purchases_become_tokens_after_the_last_shuffle(spark):
    buys = spark.createDataFrame(
        [("s", "a", 3), ("s", "a", 3), ("s", "a", 2), ("a:1", "b", 2), ("a", "c", 100), (None, "n", 4), (None, "n", 2), ("z", "d", None)],
        "session_id string, user_id string, quantity int")
    paid = spark.createDataFrame(
        [(k,) for k in ("stripe:s:2", "stripe:s:02", "stripe:a:1:2", "stripe:a:101", "stripe:a", "verify:a:7", "stripe:a:100\n", None)],
        "idempotency_key string")
    grants, refused = ledger.expand_purchases(buys, paid)
    want = [(None, "n"), ("stripe:s:1", "a"), ("stripe:s:3", "a"), ("stripe:a:1:1", "b"), *[(f"stripe:a:{n}", "c") for n in range(1, 101)]]
    assert sorted(((r.idempotency_key, r.user_id) for r in grants.collect()), key=repr) == sorted(want, key=repr)
    assert {(r.delta, r.kind) for r in grants.collect()} == {(1, "purchase")} and refused.count() == 1
    above = grants._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
    assert "Exchange" not in above and "Join" not in above


def _scans(spark, rows):
    df = spark.createDataFrame(rows, "k int, i long, v int, t timestamp")
    got = ordered.ordered_scan(
        df, ["k"], ["t", "i"], ordered.time_slice("t", 5), a=ordered.prev(F.struct("v", "i")), b=ordered.upto(F.col("v")),
        c=ordered.following(F.col("v")), d=ordered.running_sum(F.coalesce("v", F.lit(0))), e=ordered.sum_before(F.col("v")),
        f=ordered.max_before(F.col("v")))
    return got.dtypes, sorted((tuple(r) for r in got.collect()), key=repr), got._jdf.queryExecution().optimizedPlan().toString()


def test_small_keys_are_scanned_without_slices(spark, monkeypatch):
    rows = [(rng.randrange(3), i, rng.choice([None, rng.randrange(50)]), at(rng.randrange(60))) for i in range(150)]
    odd = [(None, 200, 1, at(3)), (None, 201, 2, at(50)), (1, 202, 3, None), (1, 203, None, None)]
    plain = _scans(spark, rows)
    assert "Join" not in plain[2]
    with_nulls = _scans(spark, rows + odd)
    assert "Join" in with_nulls[2]
    monkeypatch.setattr(ordered, "PLAIN_ROWS", 10)
    sliced = _scans(spark, rows)
    assert "Join" in sliced[2] and plain[:2] == sliced[:2]
    assert with_nulls[:2] == _scans(spark, rows + odd)[:2]


def test_stream_queries_read_the_projector_only(spark, monkeypatch):
    class Streamed:  # has no projections of its own
        streamed = "folder"

    monkeypatch.setattr(registry, "world", lambda *_: Streamed())
    for query, (table, columns) in registry.STREAMED.items():
        stored = spark.createDataFrame([], ", ".join(f"{c} string" for c in ["more", *columns.split()]))
        monkeypatch.setattr(registry, "read_projection", lambda _, root, name: {("folder", table): stored}[root, name])
        assert registry.QUERIES[f"stream_{query}"](spark, "any").columns == columns.split()
