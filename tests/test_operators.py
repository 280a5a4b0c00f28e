"""Operators against brute force and the boundary cases of the rules."""

import math
import random
import re
from datetime import datetime

import pytest
from helpers import at, collect, table
from pyspark.sql import functions as F

from lifelog.functions import scalars as X
from lifelog.functions.verdict import classify_death
from lifelog.operators import ordered, temporal
from lifelog.operators.filters import search_labels
from lifelog.operators.paging import survivor_order
from lifelog.operators.ordered import following, latest_by, max_before, ordered_scan, prev, running_sum, upto
from lifelog.operators.temporal import asof_join, interval_join, islands, last_open_span
from lifelog.operators.text import dedupe_quotes, find_mentions, scan_terms
from lifelog.operators import tracks
from lifelog.operators.tracks import thin_track
from lifelog.operators.windows import life_encounters, running_balance

rng = random.Random(5)


@pytest.mark.parametrize("width", [3, 1000])
def test_ordered_scan_equals_brute_force(spark, width):
    rows = [(rng.randrange(3), i, rng.choice([None, rng.randrange(50)])) for i in range(120)]
    df = spark.createDataFrame(rows, "k int, i long, v int")
    got = ordered_scan(df, ["k"], ["i"], F.expr(f"i div {width}"), before=prev(F.col("v")), so_far=upto(F.col("v")),
                       after=following(F.col("v")), total=running_sum(F.coalesce("v", F.lit(0))),
                       top=max_before(F.col("v")))
    want = []
    for k, i, v in rows:
        past = [x for kk, ii, x in rows if kk == k and ii < i and x is not None]
        future = [x for kk, ii, x in rows if kk == k and ii > i and x is not None]
        here = past + ([v] if v is not None else [])
        want.append((k, i, past[-1] if past else None, here[-1] if here else None, future[0] if future else None,
                     sum(here), max(past, default=None)))
    assert collect(got, "k", "i", "before", "so_far", "after", "total", "top") == sorted(want, key=repr)


@pytest.mark.parametrize("seconds", [5, 3600])
@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_equals_brute_force(spark, monkeypatch, seconds, strict, direction):
    monkeypatch.setattr(ordered.time_slice, "__defaults__", (seconds,))
    left = [(rng.randrange(2), i, at(rng.randrange(40))) for i in range(40)]
    right = [(rng.randrange(2), j, at(rng.randrange(40))) for j in range(25)]
    l_df = spark.createDataFrame(left, "k int, i int, t timestamp")
    r_df = spark.createDataFrame(right, "k int, j long, u timestamp")
    got = asof_join(l_df, r_df, ["k"], "t", "u", "m", direction=direction, strict=strict, tie=F.col("j"))
    want = []
    for k, i, t in left:
        if direction == "backward":
            pool = [(u, j) for kk, j, u in right if kk == k and (u < t or (u == t and not strict))]
            best = max(pool, default=None)
        else:
            pool = [(u, -j) for kk, j, u in right if kk == k and (u > t or (u == t and not strict))]
            best = min(pool, default=None)
        want.append((k, i, abs(best[1]) if best else None))
    assert collect(got.select("k", "i", "m.j"), "k", "i", "j") == sorted(want, key=repr)


@pytest.mark.parametrize("inclusive", [True, False])
def test_interval_join_with_touching_and_overlapping_intervals(spark, inclusive):
    spans = [(1, 1, 0, 10), (1, 2, 10, 20), (1, 3, 15, 30), (1, 4, 15, 15), (1, 5, 40, None), (2, 6, 0, None)]
    points = [(k, i * 100 + k, t) for k in (1, 2) for i, t in enumerate([0, 5, 10, 15, 20, 25, 30, 35, 40, 99])]
    s_df = spark.createDataFrame([(k, n, at(a), None if b is None else at(b)) for k, n, a, b in spans],
                                 "k int, n long, a timestamp, b timestamp")
    p_df = spark.createDataFrame([(k, i, at(t)) for k, i, t in points], "k int, i int, t timestamp")
    got = interval_join(p_df, s_df, ["k"], "t", "a", "b", "s", tie="n", end_inclusive=inclusive)
    want = [(i, n) for k, i, t in points for kk, n, a, b in spans
            if k == kk and a <= t and (b is None or (t <= b if inclusive else t < b))]
    assert collect(got.select("i", "s.n"), "i", "n") == sorted(want, key=repr)


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("levels", [2, 20])
def test_interval_join_with_nested_intervals(spark, monkeypatch, inclusive, levels):
    monkeypatch.setattr(temporal, "SEGMENT_LEVELS", levels)
    own = random.Random(levels)
    spans = []
    for n in range(70):
        a = own.randrange(200)
        b = own.choice([None, a, a + 1, a + own.randrange(20), a + own.randrange(200)]) if n % 7 else None
        spans.append((own.randrange(2), n, a, b))
    points = [(own.randrange(3), i, own.randrange(-5, 260)) for i in range(250)]
    s_df = spark.createDataFrame([(k, n, at(a), None if b is None else at(b)) for k, n, a, b in spans],
                                 "k int, n long, a timestamp, b timestamp")
    p_df = spark.createDataFrame([(k, i, at(t)) for k, i, t in points], "k int, i int, t timestamp")
    got = interval_join(p_df, s_df, ["k"], "t", "a", "b", "s", tie="n", end_inclusive=inclusive)
    want = [(i, n) for k, i, t in points for kk, n, a, b in spans
            if k == kk and a <= t and (b is None or (t <= b if inclusive else t < b))]
    assert collect(got.select("i", "s.n"), "i", "n") == sorted(want, key=repr)


def test_covering_meets_no_pair_in_vain(spark):
    """One key, spans far inside each other: rows that enter the join grow with the points, not their square."""
    def entering(n):
        points = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("i"), F.col("id").alias("t"))
        spans = spark.range(n // 4).select(
            F.lit(1).alias("k"), (F.col("id") * 4).alias("__successor"), (F.col("id") * 4 + 11).alias("__stop"), F.col("id").alias("__tie"),
            F.struct("id").alias("s"))
        return temporal.covering(points, spans, ["k"], "t", "s")

    for n in (400, 4000):
        assert entering(n).count() == 3 * n - 12
        assert entering(n).select("k", "i", "s.id").distinct().count() == 3 * n - 12


@pytest.mark.parametrize("rows", [5, 40])
@pytest.mark.parametrize("ordered_by", [["t", "tie"], ["t", "side", "tie"]])
def test_dense_stretches_are_cut_at_equal_depth(spark, rows, ordered_by):
    """One key has most rows in one hour, many of them in one second and one microsecond."""
    own = random.Random(rows)
    data = []
    for i in range(900):
        micro = own.choice([own.randrange(3_600_000_000), 7_000_000 + own.randrange(1_000_000), 9_000_001, own.randrange(10**12)])
        data.append((0 if i % 9 else own.randrange(1, 4), micro, own.randrange(2), i))
    df = spark.createDataFrame(data, "k int, m long, side int, tie long").withColumn("t", F.timestamp_micros("m"))
    got = ordered.sliced_by_time(df, ["k"], ordered_by, 3600, "slice", rows).collect()
    assert len(got) == len(data)
    sizes = {}
    for r in got:
        sizes[r.k, r.slice] = sizes.get((r.k, r.slice), 0) + 1
    assert max(sizes.values()) <= 2 * rows
    place = {"t": "m"}
    for k in range(4):
        mine = sorted((tuple(r[place.get(c, c)] for c in ordered_by), r.slice) for r in got if r.k == k)
        assert [s for _, s in mine] == sorted(s for _, s in mine)
    dense = sum(1 for k, m, _, _ in data if k == 0 and m < 3_600_000_000)
    held = {r.slice for r in got if r.k == 0 and r.m < 3_600_000_000}
    assert len(held) <= dense / rows + 1  # no more slices than depth asks for


def test_scans_over_dense_stretches(spark, monkeypatch):
    monkeypatch.setattr(ordered, "SLICE_ROWS", 6)
    own = random.Random(9)
    rows = [(own.randrange(2), i, at(own.randrange(30)), own.choice([None, own.randrange(50)])) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, i long, t timestamp, v int")
    got = ordered_scan(df, ["k"], ["t", "i"], ordered.time_slice("t"), before=prev(F.col("v")), after=following(F.col("v")),
                       total=running_sum(F.coalesce("v", F.lit(0))))
    want = []
    for k, i, t, v in rows:
        past = [x for _, _, x in sorted((tt, ii, x) for kk, ii, tt, x in rows if kk == k and (tt, ii) < (t, i) and x is not None)]
        future = [x for _, _, x in sorted((tt, ii, x) for kk, ii, tt, x in rows if kk == k and (tt, ii) > (t, i) and x is not None)]
        want.append((k, i, past[-1] if past else None, future[0] if future else None, sum(past) + (v or 0)))
    assert collect(got, "k", "i", "before", "after", "total") == sorted(want, key=repr)


def test_latest_by_prefers_non_null_and_breaks_ties(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 5, 1), ("b", None, 9)], "k string, seen int, id int")
    got = latest_by(df, ["k"], [F.col("seen"), -F.col("id")])
    assert collect(got, "k", "seen", "id") == [("a", 5, 1), ("b", None, 9)]


def test_islands_gap_exactly_at_bound(spark):
    df = spark.createDataFrame([(1, i, at(s)) for i, s in enumerate([0, 120, 241, 361])], "k int, event_id long, t timestamp")
    got = islands(df, ["k"], "t", "event_id", 120)
    assert [r.island for r in got.orderBy("t").collect()] == [1, 1, 2, 2]


def test_encounters_near_death_are_left_out(spark):
    schema = ("life_id long, occurred_at timestamp, event_id long, victim_hp double, attacker_gamertag string, "
              "attacker_type string, attacker_label string")
    rows = [(1, at(0), 1, 50.0, None, "infected", "Infected"), (1, at(100), 2, None, "Bob", "player", None),
            (1, at(130), 3, 40.0, "BOB", "player", None), (1, at(500), 4, 9.0, None, "environment", "FireplaceHot"),
            (1, at(880), 5, 9.0, None, "environment", "Animal_CanisLupus_Grey"), (1, at(879), 6, 3.0, None, "infected", "Infected")]
    ended = spark.createDataFrame([(1, at(1000))], "life_id long, ended_at timestamp")
    got = life_encounters(spark.createDataFrame(rows, schema), ended)
    assert collect(got, "category", "attacker_gamertag", "duration_seconds", "hits", "hp_low") == [
        ("fire", None, 0, 1, 9.0), ("infected", None, 0, 1, 3.0), ("infected", None, 0, 1, 50.0), ("player", "Bob", 30, 2, 40.0)]


def thin(points, meters):
    kept = [points[0]]
    for p in points[1:]:
        if math.hypot(p[2] - kept[-1][2], p[3] - kept[-1][3]) >= meters:
            kept.append(p)
    if kept[-1] is not points[-1]:
        kept.append(points[-1])
    return [p[0] for p in kept]


@pytest.mark.parametrize(("piece", "chunk"), [(7, 256), (1000, 3), (1000, 256)])
def test_thin_track_equals_sequential_walk(spark, monkeypatch, piece, chunk):
    monkeypatch.setattr(tracks, "CHUNK", chunk)
    rows, event = [], 0
    for life, n in ((1, 90), (2, 1), (3, 20)):
        x = y = 0.0
        for i in range(n):
            x, y = x + rng.uniform(-4, 12), y + rng.uniform(-4, 8)
            rows.append((event, life, x, y, at(i)))
            event += 1
    df = spark.createDataFrame(rows, "event_id long, life_id long, x double, y double, recorded_at timestamp")
    got = thin_track(df, piece_rows=piece)
    want = []
    for life in (1, 2, 3):
        want += thin([r for r in rows if r[1] == life], 15)
    assert sorted(r.event_id for r in got.collect()) == sorted(want)


@pytest.mark.parametrize(("piece", "fan"), [(4, 2), (9, 3), (30, 64)])
def test_pieces_of_long_tracks_are_entered_where_the_walk_comes(spark, monkeypatch, piece, fan):
    """Steps without a common point, standing still over many pieces, grids with exact distances and repeated places."""
    monkeypatch.setattr(tracks.piece_entries, "__defaults__", (fan,))
    own = random.Random(piece)
    walks = {
        1: [(10.0 * i, 0.0) for i in range(150)],
        2: [(0.0, 0.0)] * 60 + [(9.0, 12.0)] + [(0.5 * (i % 3), 0.0) for i in range(70)] + [(30.0, 0.0)],
        3: [(own.choice([0.0, 9.0, 9.1, 15.0]), own.choice([0.0, 12.0, 14.9])) for _ in range(160)],
        4: [(100.0 * math.cos(i / 9), 100.0 * math.sin(i / 9)) for i in range(140)],
        5: [(own.gauss(0, 6), own.gauss(0, 6)) for _ in range(200)],
        6: [(1.0, 1.0)],
        7: [(0.0, 0.0)] * 100,
    }
    rows, event = [], 0
    for life, walk in walks.items():
        for i, (x, y) in enumerate(walk):
            rows.append((event, life, x, y, at(i)))
            event += 1
    df = spark.createDataFrame(rows, "event_id long, life_id long, x double, y double, recorded_at timestamp").repartition(3)
    got = sorted(r.event_id for r in thin_track(df, piece_rows=piece).collect())
    assert got == sorted(e for life in walks for e in thin([r for r in rows if r[1] == life], 15))


def test_rounds_of_thinning_grow_with_the_logarithm(spark, monkeypatch):
    made = []
    real = tracks.stage
    monkeypatch.setattr(tracks, "stage", lambda df, name="stage": made.append(name) or real(df, name))

    def tables(n):
        made.clear()
        df = spark.range(n).select(F.lit(1).alias("life_id"), F.col("id").alias("event_id"), (F.col("id") * 10.0).alias("x"),
                                   F.lit(0.0).alias("y"), F.timestamp_seconds("id").alias("recorded_at"))
        assert thin_track(df, piece_rows=5).count() == n // 2 + 1 - n % 2
        return len(made)

    few, many = tables(80), tables(640)  # eight times the pieces: three more doublings, three steps back, one level of hulls
    assert many - few <= 8


def test_long_tracks_are_whole(spark):
    df = spark.createDataFrame([(i, 1, 20.0 * i, 0.0, at(i)) for i in range(3000)],
                               "event_id long, life_id long, x double, y double, recorded_at timestamp")
    assert thin_track(df).count() == 3000
    assert thin_track(df, piece_rows=700).count() == 3000
    assert thin_track(df.limit(0)).count() == 0


def test_mentions_equal_left_to_right_matching(spark):
    docs = [(1, "Bob met bob-smith, Bobby and BOB.", ["Bob", "Bob-Smith", "bob"]),
            (2, "Bob-Smithy spoke to a.b and axb", ["Bob-Smith", "Bob", "a.b"]),
            (3, "abab ab", ["ab"]), (4, "nothing", [" ", None]), (5, "élan Bobé", ["Bob"]), (6, "", ["Bob"])]
    df = spark.createDataFrame(docs, "doc_id int, text string, roster array<string>")
    want = []
    for key, text, roster in docs:
        names = sorted({n.strip() for n in roster if n and n.strip()}, key=lambda n: -len(n))
        if not names:
            continue
        for m in re.finditer("|".join(map(re.escape, names)), text, re.IGNORECASE):
            around = text[max(0, m.start() - 1):m.start()] + text[m.end():m.end() + 1]
            if not re.search("[A-Za-z0-9_]", around):
                want.append((key, m.start(), m.group()))
    assert collect(find_mentions(df), "doc_id", "start", "name") == sorted(want, key=repr)
    assert want


def test_terms_respect_boundaries_and_exemptions(spark):
    df = spark.createDataFrame([(1, "The tree line; barns, barn2. Éast EAST", ["barns"]), (2, "treeline", [])],
                               "doc_id int, text string, ex array<string>")
    got = scan_terms(df, ["barn", "barns", "tree line", "treeline", "east"], exempt="ex")
    assert collect(got, "doc_id", "term") == [(1, "east"), (1, "tree line"), (2, "treeline")]


def test_terms_against_one_pattern_each(spark):
    own = random.Random(4)
    words = ["tree", "line", "of", "the", "oak", "c", "x1", "é"]
    gaps = [" ", "  ", "-", ", ", "\n", "'"]
    terms = {"of the", "of the oak", "tree line", "tree-line", "the oak", "oak", "c++", "-x1", "of  the", "x1", "the tree of the line", "é tree"}
    terms |= {own.choice(words[:7]) + "".join(own.choice(gaps) + own.choice(words[:7]) for _ in range(own.randrange(4))) for _ in range(150)}
    texts = ["".join(own.choice(words) + own.choice([*gaps, "+", "++ "]) for _ in range(own.randrange(60))) for _ in range(80)] + ["", "oak", "of the"]
    df = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id int, text string")
    want = [(i, t) for i, text in enumerate(texts) for t in terms
            if re.search(f"(?<![a-z0-9]){re.escape(t)}(?![a-z0-9])", text, re.DOTALL)]
    assert collect(scan_terms(df, list(terms)), "doc_id", "term") == sorted(want, key=repr)
    assert scan_terms(df, []).count() == 0


def test_labels_rank_as_readers_expect(spark):
    names = ["zoe", "Zoe", "_z", "Ärger", "arger", "B", "a", "b", "A", "ß", "ss", "10", "9"]
    df = spark.createDataFrame([(n, 1, 0, 0.0) for n in names],
                               "gamertag string, time_alive_seconds int, kills_this_life int, longest_kill_meters double")
    got = [r.gamertag for r in df.orderBy(*survivor_order()).collect()]
    assert got == ["_z", "10", "9", "a", "A", "arger", "Ärger", "b", "B", "ss", "ß", "zoe", "Zoe"]


def test_reused_attribution_loses_its_quote(spark):
    new = spark.createDataFrame([(1, "q", " A Man "), (2, "q", "Other"), (3, "q", None)],
                                "id int, quote_text string, quote_attribution string")
    recent = spark.createDataFrame([("a man",), (None,), (" ",)], "attribution string")
    assert collect(dedupe_quotes(new, recent), "id", "quote_text") == [(1, None), (2, "q"), (3, "q")]


def test_prefix_search(spark):
    df = spark.createDataFrame([("Bob",), ("bOat",), ("abo",), ("B%x",)], "gamertag string")
    assert [r.gamertag for r in search_labels(df, "bo", 5).collect()] == ["Bob", "bOat"]
    assert search_labels(df, "b", 5).count() == 0
    assert search_labels(df, "b_", 5).count() == 3


def test_overdraft_flag(spark):
    df = table(spark, "token_transactions", [dict(id=i, user_id="u", delta=d) for i, d in enumerate([1, -1, -1, 1])])
    assert collect(running_balance(df), "id", "balance", "overdraft") == [
        (0, 1, False), (1, 0, False), (2, -1, True), (3, 0, False)]


def scalar_cases():
    return [
        (X.slug(F.lit("--Ab  C_d!")), "ab-c-d"),
        (X.obituary_slug(F.lit("?!"), F.lit("__"), F.lit(1), F.lit(2)), "obituary-survivor-1-2"),
        (X.time_alive_label(F.lit(172800)), "2d"), (X.time_alive_label(F.lit(90061)), "1d 1h"),
        (X.time_alive_label(F.lit(3600)), "1h 0m"), (X.time_alive_label(F.lit(59)), "0m"),
        (X.board_duration(F.lit(59)), "59s"), (X.board_duration(F.lit(90060)), "1d 1h 1m"),
        (X.page_duration(F.lit(90060)), "25h 1m"), (X.elapsed_label(F.lit(-5)), "0h 00m"),
        (X.distance_label(F.lit(999.5)), "1000 m"), (X.distance_label(F.lit(1234.5)), "1.23 km"),
        (X.distance_label(F.lit(None).cast("double")), "—"),
        (X.cause_label(F.lit("bled_out")), "Bled Out"), (X.cause_label(F.lit("died")), "Unknown"),
        (X.is_melee(F.lit(" Hunting Knife ")), True), (X.is_melee(F.lit(None).cast("string")), False),
        (X.emote_token(F.lit("RPS")), "EmoteRPSRandom"), (X.emote_label(F.lit("EmoteThumb")), "thumbs up"),
        (X.emote_is_safe(F.lit("EmoteSitA")), False),
        (X.grid_ref(F.lit(123456.0), F.lit(-5.0)), "1234 000"), (X.world_size(F.lit("mars")), None),
        (X.map_label(F.lit("enoch")), "Livonia"), (X.map_label(F.lit("deer isle")), "Deer Isle"),
        (X.place_visible(F.lit("village"), F.lit(1)), False), (X.place_visible(F.lit("hill"), F.lit(4)), True),
        (X.ms_to_next_even_hour(F.lit(datetime(2026, 1, 1, 3)).cast("timestamp")), 3_600_000),
        (X.first_sentence(F.lit("  One two. Three")), "One two."), (X.first_sentence(F.lit("v1.5 is out")), "v1.5 is out"),
        (X.first_sentence(F.lit("abc def"), 4), "abc…"),
        (X.ban_names(F.lit(" "), F.lit(" Bob ")), ["Bob"]),
        (X.dedupe_roster(F.array(F.lit(" Anna"), F.lit("ANNA "), F.lit("Bo"), F.lit("")), 3), ["Anna"]),
        (X.compose_tags(F.lit("sakhal"), F.lit("pvp"), F.array(F.lit("PVP"), F.lit(" grit "))),
         ["Obituaries", "Sakhal", "PvP", "grit"]),
        (X.round_half_up(F.lit(-0.5)), 0), (X.vitals_line(F.lit(None), F.lit(1.5), F.lit(0)), "Water 2"),
        (X.encounter_title(F.lit("infected"), F.lit(3), F.lit(10)), "Horde — 3 blows over 1m"),
        (X.encounter_line(F.lit("player"), F.lit(1), F.lit(9), F.lit(20.4)), "1 hit taken · HP 20"),
        (X.verdict_phrase(F.lit("starvation"), F.lit("low"), F.array(F.lit("x")), F.lit("died")), "Likely starvation"),
        (X.verdict_phrase(F.lit("suicide"), F.lit("high"), F.array(F.lit("starving")), F.lit("suicide")), "Suicide (starving)"),
        (X.board_value_label(F.lit("longest-kills"), F.lit(12.4)), "12 m"),
        (X.relative_date(F.lit(datetime(2026, 1, 1)).cast("timestamp"), F.lit(datetime(2026, 1, 16)).cast("timestamp")),
         "2 weeks ago"),
        (F.size(X.rap_sheet(F.lit(1), F.lit(2), F.lit(None).cast("double"), F.lit("c"))), 3),
        (X.salvage_reply(F.lit('ok {"headline":"h","lede":"l","body":"b","pullQuote":null,"tags":[]} bye'))["headline"], "h"),
        (X.salvage_reply(F.lit('{"headline":"h","lede":"l","body":"b","tags":[]}'))["headline"], None),
        (X.read_facts(F.lit('{"verdict":{"cause":"fall"}}'))["verdict"]["confidence"], "high"),
        (X.read_facts(F.lit(None).cast("string"))["sessions"], 0),
    ]


def test_scalars(spark):
    cases = scalar_cases()
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, (c, _) in enumerate(cases)]).first()
    assert list(row) == [expected for _, expected in cases]


def verdict(spark, mechanism=None, energy=None, water=None, bleed=None, hits=0, infected=0, low=None, falls=0, down=0):
    lits = [F.lit(mechanism).cast("string"), F.lit(energy).cast("double"), F.lit(water).cast("double"),
            F.lit(bleed).cast("int"), F.lit(hits), F.lit(infected), F.lit(low).cast("double"), F.lit(falls), F.lit(down)]
    r = spark.range(1).select(classify_death(*lits).alias("v")).first().v
    return r.cause, r.confidence, list(r.conditions)


@pytest.mark.parametrize("facts,expected", [
    (dict(mechanism="pvp", energy=0), ("pvp", "high", ["starving"])),
    (dict(mechanism="bled_out"), ("bled_out", "high", ["bleeding"])),
    (dict(mechanism="drowned", water=0.5), ("environmental", "high", ["dehydrated", "drowned"])),
    (dict(mechanism="wolf", bleed=2), ("wolf", "high", ["healthy"])),
    (dict(mechanism="died", energy=0, falls=1, hits=1), ("fall", "high", ["starving"])),
    (dict(mechanism="died", energy=1), ("starvation", "high", ["starving"])),
    (dict(mechanism="died", energy=1, hits=1), ("starvation", "low", ["starving"])),
    (dict(mechanism="died", water=1, hits=1, infected=1), ("dehydration", "low", ["dehydrated", "hunted"])),
    (dict(mechanism="died", hits=1, infected=1, down=1), ("mauled", "high", ["hunted"])),
    (dict(mechanism="died", hits=1, infected=1, low=1.0), ("mauled", "high", ["hunted"])),
    (dict(mechanism="died", hits=1, infected=1, bleed=1), ("mauled", "high", ["hunted", "bleeding"])),
    (dict(mechanism="died", hits=1, infected=1, low=1.5), ("unknown", "low", ["hunted"])),
    (dict(mechanism="died", hits=1, bleed=1), ("bled_out", "high", ["bleeding"])),
    (dict(bleed=1), ("unknown", "low", ["healthy"])),
])
def test_verdict_ladder(spark, facts, expected):
    assert verdict(spark, **facts) == expected


@pytest.mark.parametrize("fan", [2, 5, 64])
def test_last_open_span_against_every_span(spark, fan):
    ids = list(range(400))
    rng.shuffle(ids)
    spans = [(rng.choice("ab"), e, rng.choice([None, e + rng.randint(1, 250)]), f"v{e}") for e in ids[:200]]
    points = [(rng.choice("abc"), t) for t in ids[200:]]
    got = last_open_span(
        spark.createDataFrame(points, "k string, t long"),
        spark.createDataFrame(spans, "k string, started long, stopped long, v string"), ["k"], "t", "started", "stopped", "m", fan=fan)
    want = []
    for k, t in points:
        open_ = [s for s in spans if s[0] == k and s[1] < t and (s[2] is None or s[2] > t)]
        want.append((k, t, max(open_, key=lambda s: s[1])[3] if open_ else None))
    assert {(r.k, r.t): r.m and r.m.v for r in got.collect()} == {(k, t): v for k, t, v in want}
