"""Rules, models, spatial and merge operators, sources, sinks and streams on small cases."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from cairnlake.functions import arrays, calendar, geo, jsonx, numeric, text
from cairnlake.operators import entity, graph, keys, merge, rules, series, spatial, stats
from cairnlake.plans import daily, evidence, scheduling
from cairnlake.sources import feeds, sinks
from cairnlake.streaming import policies


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(("zoom", "degrees"), [(2, 11.25), (5, 1.40625), (8, 0.17578125), (-5, 45), (30, 0.04)])
def test_cluster_degrees(zoom, degrees):
    assert geo.cluster_degrees(zoom) == degrees


def test_numbers(spark):
    assert value(spark, numeric.scale(F.lit(5.0), 3, 3)) == 0
    assert value(spark, numeric.snap_half_up(F.lit(-2.5), 1)) == -2
    assert value(spark, numeric.snap_half_even(F.lit(2.5), 1)) == 2
    assert value(spark, numeric.band(F.lit(2.0), ((2, "a"), (3, "b")), "c")) == "a"
    assert value(spark, numeric.band(F.lit(2.0), ((2, "a"), (3, "b")), "c", inclusive=False)) == "b"
    assert value(spark, numeric.compact_number(F.lit(1234))) == "1.2k"
    assert value(spark, numeric.compact_number(F.lit(1_234_560_000))) == "1234.6m"
    assert value(spark, calendar.valid_date(F.lit("2024-02-30"))) is None
    assert value(spark, calendar.hours_between(F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp"))) == 12


def test_last_n_keeps_short_arrays(spark):
    short = F.array(F.lit(1), F.lit(2))
    assert value(spark, arrays.last_n(short, 60)) == [1, 2]
    assert value(spark, arrays.from_last(F.array(*map(F.lit, range(40))), 15, 30)) == list(range(24, 9, -1))


def test_text_forms(spark):
    assert value(spark, text.normal_name(F.lit("  Étoile & Lac Campground #2 "))) == "etoile and lac 2"
    assert value(spark, text.display_name(F.lit("- Pine Flat (555) 123-4567 ext 2 -"))) == "Pine Flat"
    assert value(spark, text.slug(F.lit("!!!"))) == "campground"
    assert value(spark, text.phone(F.lit("+1 (555) 123-4567"))) == "5551234567" and value(spark, text.phone(F.lit("12"))) is None
    assert value(spark, text.website_identity(F.lit("https://WWW.Example.org/A/?utm_source=x&b=2&a=1"))) == "example.org/a?a=1&b=2"
    assert value(spark, text.website_identity(F.lit("not a url"))) is None
    assert value(spark, text.normal_address(F.lit("Unknown"), F.lit("X"))) is None
    assert value(spark, text.normal_address(F.lit("12 Long Road"), F.lit("Town"))) == "12longrdtown"
    assert value(spark, text.html_text(F.lit("<p>a&nbsp;b &amp; <b>c</b></p>"))) == "a b & c"
    assert value(spark, text.set_similarity(text.trigrams(F.lit("word")), text.trigrams(F.lit("two words")))) == pytest.approx(4 / 11)
    assert value(spark, text.plain_ip(F.lit("::ffff:10.0.0.1"))) == "10.0.0.1"
    got = spark.createDataFrame([("Ａé",), (None,)], "t string").select(text.fold_exact("t").alias("x"), text.hmac_sha256(b"k")("t").alias("h")).collect()
    assert got[0].x == "ae" and len(got[0].h) == 43 and got[1].x is None


def test_names_alike(spark):
    sim = lambda a, b: value(spark, text.token_similarity(text.name_tokens(F.lit(a)), text.name_tokens(F.lit(b))))
    assert sim("Bear Lake Campground", "Bear Lake Camp") >= 0.95
    assert sim("River Campground", "Lake Campground") < 0.85


def test_rules(spark):
    camp = lambda name, d="", cats=("x",): value(spark, rules.camp_decision(F.lit(name), F.lit(d), F.array(*map(F.lit, cats))))
    assert camp("Bear Lake Ranger Station") == "reject:non_campground_recreation_feature"
    assert camp("Site #12") == "reject:individual_campsite_or_pitch"
    assert camp("Bear Lake") == "reject:no_campground_evidence"
    assert camp("Sunny RV Park", "rv park", ("campground",)) == "reject:rv_only_facility"
    assert camp("Bear Lake Group Campground") == "accept:group_campground"
    assert camp("Bear Lake Campground", "walk-in sites") == "accept:backcountry_campground"
    assert value(spark, rules.retention_reason(F.lit("Bear"), F.lit("campground"), F.lit(0.69))) == "low_source_confidence"
    publish = lambda n, c, w: value(spark, rules.place_publication(F.lit(n), F.lit(c), F.lit(w), F.lit("campground"), F.lit("open")))
    assert publish("Pine RV Resort", 0.8, "https://x.org") == "eligible_explicit_established_campground"
    assert publish("Pine RV", 0.9, "https://x.org/campground") == "eligible_web_supported_camping_facility"
    assert publish("Pine RV Resort", 0.9, None) == "insufficient_confidence"
    assert publish("Bible Camping", 1.0, None) == "excluded_name"
    none = F.lit(None).cast("string")
    assert value(spark, rules.map_publication(F.lit("Pine Campground"), F.lit("developed_campground"), none, F.lit("w"), none, none, F.lit(None).cast("int"), F.lit(1))) == "established_campground_evidence"
    sources = F.array(F.struct(F.lit("overture-x").alias("source"), F.lit(False).alias("authoritative"), F.lit(3).alias("missing")))
    sure, codes = rules.removal(F.lit("Camping Ottawa"), F.lit("Ottawa"), F.lit("Unknown"), none, none, F.lit(1), F.lit(0), sources)
    assert value(spark, codes) == ["unverified_generic_overture_location", "missing_from_all_current_sources", "has_user_data"]
    assert value(spark, sure) == pytest.approx(0.67)


def test_spam(spark):
    reasons = lambda t: rules.spam_reasons(spark.createDataFrame([(t,)], "t string"), "t").first().spam_reasons
    assert reasons("Lovely quiet lake, few bugs at night") == []
    assert reasons("see example . com now") == ["contains-url"]
    assert "restricted:casino bonus" in reasons("Get a CASINO  bonus")
    assert len(reasons("Your site is not showing in Google search results. We can provide SEO and AEO ranking")) == 3


def test_fingerprints(spark):
    base = "please send details about winter opening hours and prices for large families with two dogs and a trailer"
    df = spark.createDataFrame([(base,), (base.replace("two", "three"),), ("completely different words about lakes rivers forests trails bears maps stoves tents ropes boots",), ("short",), (None,)], "t string")
    f = [r.f for r in df.select(rules.fingerprint("t").alias("f")).collect()]
    near, far = (value(spark, rules.hamming(F.lit(f[0]), F.lit(x))) for x in f[1:3])
    assert near <= 16 < far and f[3] is None and f[4] is None
    assert value(spark, rules.hamming(F.lit("zz"), F.lit(f[0]))) is None


@pytest.mark.parametrize("last", [100, 3])
def test_near_before_against_brute_force(spark, last):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["a", "a", "a", "b", None]), f"{rng.getrandbits(64):016x}") for c in range(150) for t in range(3)]
    for i in range(0, 450, 7):  # near copies of an earlier row, mostly in another conversation
        c, t, role, _ = rows[i]
        f = int(rows[max(0, i - rng.randrange(1, 200))][3], 16) ^ (1 << rng.randrange(64))
        rows[i] = (c, t, role, f"{f:016x}")
    want = set()
    for group in ("a", "b", None):
        own = sorted(r for r in rows if r[2] == group) if group else sorted((r for r in rows if r[2] is None), key=lambda r: r[:2])
        for i, r in enumerate(own):
            if any((int(r[3], 16) ^ int(x[3], 16)).bit_count() <= 16 for x in own[max(0, i - last) : i]):
                want.add(r)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, f string").repartition(5)
    for block in (16, 4096):
        got = rules.near_before(df, "role", ["conv_id", "turn"], "f", last=last, block=block).collect()
        assert len(got) == len(want) > 0 and {tuple(r) for r in got} == want


def test_whole_name_pairs_against_brute_force(spark):
    rng = random.Random(4)
    words = ["lake", "river", "old", "pine", "north", "creek", "7", "12", "ridge", "hot"]
    rows = [(i, rng.choice(["x", "y", None]), " ".join(rng.choices(words, k=rng.randrange(0, 6)))) for i in range(300)] + [(300, "x", None)]
    df = spark.createDataFrame(rows, "id long, brand string, name string")
    sets = {r.id: (r.brand, set(r.t), set(r.g)) for r in df.where("name IS NOT NULL").select("id", "brand", text.name_tokens(F.col("name")).alias("t"), text.trigrams(F.col("name")).alias("g")).collect()}
    tokens, grams = {}, {}
    for a in sets:
        for b in sets:
            if a < b and sets[a][0] == sets[b][0] is not None:
                (_, s, g), (_, t, h) = sets[a], sets[b]
                if s & t and (x := min(1, 0.85 * len(s & t) / min(len(s), len(t)) + 0.15 * len(s & t) / len(s | t))) >= 0.78:
                    tokens[a, b] = round(x, 6)
                if g | h and len(g & h) / len(g | h) >= 0.5:
                    grams[a, b] = round(len(g & h) / len(g | h), 6)
    for pairs, least, want in ((entity.token_pairs_within, 0.78, tokens), (entity.trigram_pairs_within, 0.5, grams)):
        got = pairs(df, "id", "brand", "name", least).collect()
        assert len(got) == len(want) > 0 and {(r.a, r.b): round(r.similarity, 6) for r in got} == want


def test_near_copies_across_conversations(spark):
    from cairnlake.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", rules.fingerprint("text").alias("f")).where("f IS NOT NULL").collect()
    want, by = set(), {}
    for r in sorted(turns, key=lambda r: (r.conv_id is None, r.conv_id, r.turn, r.f)):
        earlier = by.setdefault(r.role, [])
        if any((int(r.f, 16) ^ int(x, 16)).bit_count() <= 16 for x in earlier[-100:]):
            want.add((r.conv_id, r.turn, r.f))
        earlier.append(r.f)
    assert {tuple(r) for r in QUERIES["simhash_near_dup"](spark, sf).collect()} == want


def test_fingerprints_are_made_once(spark):
    """One Python step over the messages, of Arrow values, not one more for the filter and one more for the ranges' sample."""
    from cairnlake.queries import QUERIES

    plan = QUERIES["simhash_near_dup"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "fingerprint" not in plan
    seen = spark.createDataFrame([("a " * 3,), (None,)], "t string").select(rules.fingerprint("t").alias("f"))
    assert [r.f for r in seen.collect()] == [None, None]
    assert "ArrowEvalPython" in seen._jdf.queryExecution().executedPlan().toString() and rules.fingerprint.evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


def test_theme_order(spark):
    rows = [("a", "Worse at dusk near the lake", 1), ("a", "dusk by the river", 2), ("a", "rain and water", 3), ("b", "dusk", 1), ("a", " ", 9)]
    got = stats.theme_summary(spark.createDataFrame(rows, "k string, t string, ts int"), "k", "t", "ts", rules.THEMES).orderBy("k", "rank").collect()
    assert [(r.k, r.phrase, r["count"]) for r in got] == [("a", "Near water", 3), ("a", "Worse at dusk", 2)]


def test_water_balance_is_the_loop(spark):
    days = [(0.5 * i % 7, 3.0 - i % 5, 0.2 * (i % 3), 2.0, float(i % 11 == 0) * 60) for i in range(67)]
    hist = F.array(*(F.struct(F.lit(t).alias("temperatureMeanC"), F.lit(s).alias("snowDepthM"), F.lit(e).alias("evapotranspirationMm"), F.lit(p + q).alias("precipitationMm")) for p, t, s, e, q in days))
    got = value(spark, evidence.water_balance(hist, F.lit(0.4), F.lit(0.3), F.lit(2.0), F.lit(0.2)))
    capacity = min(1, 0.35 + 0.4 * 0.65)
    water, snow = min(capacity, 0.4 * 0.35), days[0][2]
    for p, t, s, e, q in days[-60:]:
        melt = max(0, snow - s) * 1000 if t > 0 else 0
        snow = s
        water += (p + q) * 0.025 + melt * 0.03 - (0.01 + e * 0.015 + 0.3 * 0.025 + 2 * 0.001) * (1 - 0.4 * 0.55)
        water -= 0.08 * 0.6 if p + q >= 55 else 0
        water = max(0, min(capacity, water))
    assert got == pytest.approx(water)


def day(**other):
    base = dict(
        p=1, wetlandCoverage=(0.5,) * 4, marshCoverage=(0.4,) * 4, seasonalWaterCoverage=(0.3,) * 4, forestCoverage=(0.6,) * 4, smallWaterBodyDensity=0.4, stagnantWaterPotential=0.5, lakeShorelineProximity=0.5,
        largeOpenWaterCoverage=0.2, fastRiverProximity=0.2, slowRiverProximity=0.5, vegetationCoverage=0.6, drainagePotential=0.4, warmSeasonRainfallMm=400.0, landCoverType="Wetland", profileConfidence=0.8,
        temperatureMeanC=22.0, overnightLowC=14.0, relativeHumidityMean=78.0, dewPointMeanC=16.0, precipitation3dMm=6.0, precipitation7dMm=15.0, precipitation14dMm=24.0, soilMoisture=0.25, seasonality=0.9,
        eveningActivity=0.8, windSpeedKmh=6.0, activePrecipitationMm=0.0, dayOffset=0,
    )
    return base | other


def scored(spark, rows):
    ring = "struct<within250m:double,from250mTo1km:double,from1kmTo5km:double,from1kmTo3km:double>"
    kind = lambda k, v: f"{k} {ring}" if isinstance(v, tuple) else f"{k} {'string' if isinstance(v, str) else 'int' if isinstance(v, int) else 'double'}"
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(kind(k, v) for k, v in rows[0].items()))
    return {r.p: r for r in daily.score_daily(df).collect()}


def test_daily_score_moves_the_right_way(spark):
    got = scored(spark, [day(), day(p=2, windSpeedKmh=40.0), day(p=3, precipitation7dMm=45.0), day(p=4, temperatureMeanC=2.0, overnightLowC=-1.0), day(p=5, dayOffset=7)])
    assert got[2].score < got[1].score < got[3].score and got[4].score < got[1].score and got[5].confidence < got[1].confidence
    assert "Strong wind suppresses short-term flying activity." in got[2].factors and len(got[4].factors) <= 4


def test_cadence(spark):
    schema = "k int, active boolean, operating_status string, has_profile boolean, sites int, recent_report boolean, saves int, views int, requested boolean, manual_override string"
    rows = [(1, True, "open", True, 12, False, 0, 0, False, None), (2, True, "closed", True, 99, True, 9, 99, True, "daily"), (3, True, "open", False, 99, True, 9, 99, True, "daily"), (4, True, "open", True, 50, True, 3, 10, True, None), (5, True, "open", True, None, False, 0, 0, False, "daily")]
    got = {r.k: (r.cadence, r.priority_score, r.reason_codes) for r in scheduling.decide_cadence(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == ("weekly", 1, ["established-low-interest"]) and got[2] == ("paused", 0, ["not-operating"]) and got[3] == ("paused", 0, ["habitat-profile-required"])
    assert got[4][:2] == ("daily", 120) and got[5] == ("daily", 100, ["manual-override"])


def test_radius_join_wraps_and_reaches_poles(spark):
    a = spark.createDataFrame([(1, 0.0, 179.95), (2, 89.9, 10.0), (3, -45.0, 0.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([(1, 0.0, -179.95), (2, 89.9, -170.0), (3, -45.0, 0.2)], "r_id long, r_lat double, r_lon double")
    assert {(r.id, r.r_id) for r in spatial.radius_join(a, b, 25_000).collect()} == {(1, 1), (2, 2), (3, 3)}
    found = spatial.nearest(a, b.where("r_id = 3"), "id", "r_id", 1000).collect()
    assert {(r.id, r.r_id) for r in found} == {(1, 3), (2, 3), (3, 3)}
    assert spatial.nearest(a, b.limit(0), "id", "r_id").count() == 0


def test_three_stay_and_four_cluster(spark):
    df = spark.createDataFrame([(i, 10.1, 10.1) for i in range(4)] + [(10 + i, 30.1, 30.1) for i in range(3)], "id long, lat double, lon double")
    kinds = sorted((r.kind, r.n) for r in spatial.grid_clusters(df, "id", 1.40625).collect())
    assert kinds == [("cluster", 4), ("point", 1), ("point", 1), ("point", 1)]


def test_suppression_is_greedy(spark):
    rows = [(i, "x", float(100 - i), 0.0, i * 0.2) for i in range(12)]
    kept = sorted(r.id for r in spatial.suppress(spark.createDataFrame(rows, "id long, g string, pop double, lat double, lon double"), "g", "pop", "id", 30_000).collect())
    want = []
    for i, *_, lon in rows:
        if all(abs(lon - rows[k][4]) * spatial.METRES_PER_DEGREE > 30_000 for k in want):
            want.append(i)
    assert kept == want


def test_polygon_area(spark):
    ring = [[0.0, 0.0], [0.0, 0.01], [0.01, 0.01], [0.01, 0.0]]
    got = spatial.polygon_areas(spark.createDataFrame([(1, ring)], "id long, ring array<array<double>>"), "id", "ring").first()
    assert got.area_m2 == pytest.approx((0.01 * spatial.METRES_PER_DEGREE) ** 2, rel=1e-3)


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", ["x"], "pending"), (2, "b", None, "reviewed")], "k int, v string, tags array<string>, s string")
    new = spark.createDataFrame([(1, None, ["y", "x"], "pending"), (2, "z", ["q"], "pending"), (3, "c", None, "pending")], "k int, v string, tags array<string>, s string")
    got = {r.k: (r.v, r.tags, r.s) for r in merge.upsert(old, new, ["k"], {"v": "keep_if_null", "tags": "union", "s": "overwrite"}, F.col("old_s") == "reviewed").collect()}
    assert got == {1: ("a", ["x", "y"], "pending"), 2: ("b", None, "reviewed"), 3: ("c", None, "pending")}
    assert {r.k for r in merge.insert_absent(old.select("k"), new.select("k"), ["k"]).collect()} == {1, 2, 3}
    counted = merge.increment(spark.createDataFrame([(1, 5)], "k int, n long"), spark.createDataFrame([(1,), (2,), (1,)], "k int"), ["k"], "n")
    assert {r.k: r.n for r in counted.collect()} == {1: 7, 2: 1}
    assert {r.k: r.v for r in merge.replace_slice(old.select("k", "v"), new.select("k", "v"), ["k"]).collect()} == {1: None, 2: "z", 3: "c"}
    assert merge.anonymise(old, "k", spark.createDataFrame([(1,)], "id int"), "id").where("k IS NULL").count() == 1


def test_provenance_and_maps(spark):
    m = F.create_map(*map(F.lit, ("name", "b", "city", "a", "phone", "a")))
    assert value(spark, jsonx.compact_provenance(m)) == {"_": "a", "name": "b"}
    assert value(spark, jsonx.keep_keys(F.create_map(*map(F.lit, ("a", "1", "b", "", "c", "3"))), "a", "b")) == {"a": "1"}
    assert value(spark, jsonx.put(F.create_map(F.lit("a"), F.lit("1")), "a", F.lit("2"))) == {"a": "2"}
    assert value(spark, jsonx.number(F.lit('{"a": {"b": "x"}}'), "$.a.b")) is None


def test_components_on_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 2000 + i) for i in range(50)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 252


def test_out_of_range_page_knows_total(spark):
    df = spark.range(50)
    assert keys.page(df, [F.asc("id")], 9, 24).count() == 0
    assert keys.with_total(df).first().total == 50


def test_season_wraps_the_year(spark):
    target = spark.createDataFrame([(1, "2024-12-28"), (2, "2024-12-10")], "k int, d string").select("k", F.to_date("d").alias("day"))
    past = spark.createDataFrame([(1, "2023-01-10"), (1, "2023-02-20"), (2, "2022-12-31"), (2, "2024-12-09"), (2, "2023-01-01")], "k int, d string").select("k", F.to_date("d").alias("past"))
    got = sorted((r.k, str(r.past)) for r in series.season_matches(target, past, "k", "day", "past", 21).collect())
    assert got == [(1, "2023-01-10"), (2, "2022-12-31")]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "f.geojsonl").write_text('\x1e{"type":"Feature","id":"1","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"name":"A"}}\n\nbroken\n')
    got = feeds.geojson_lines(spark, str(tmp_path / "f.geojsonl")).collect()
    assert [r.rejected for r in got] == [False, True] and got[0].properties["name"] == "A"
    (tmp_path / "up.csv").write_text("﻿name,slug,city,province,country,latitude,longitude\nBear,bear,Town,WA,US,45,-120\n\nX,Bad Slug,Town,WA,US,95,0\n")
    valid, errors = feeds.csv_upload(spark, str(tmp_path / "up.csv"))
    assert [(r.row_number, r.region) for r in valid.collect()] == [(2, "WA")]
    assert [r.row_number for r in errors.collect()] == [3] and "coordinates" in errors.first().message
    pages = []
    for i in range(3):
        (tmp_path / f"p{i}.json").write_text(json.dumps({"data": {"rows": [{"id": f"{i}-{j}", "n": j, "more": {"a": ["x"]}} for j in range(2)]}}))
        pages.append(str(tmp_path / f"p{i}.json"))
    (tmp_path / "m.json").write_text(json.dumps({"pages": pages}))
    df = feeds.paged_json(spark, str(tmp_path / "m.json"), "data.rows", ["id", "n", "more", "none"])
    assert sorted(r.id for r in df.collect()) == [f"{i}-{j}" for i in range(3) for j in range(2)]
    assert {(r.n, r.more, r.none) for r in df.collect()} == {("0", '{"a":["x"]}', None), ("1", '{"a":["x"]}', None)}
    (tmp_path / "counted").mkdir()
    (tmp_path / "counted" / "a.json").write_text(json.dumps({"meta": {"pageCount": 2}, "data": [{"id": 1}, {"id": 2}]}))
    (tmp_path / "counted" / "b.json").write_text(json.dumps({"meta": {"pageCount": 2}, "data": []}))
    each, counted = feeds.paged_with_counts(spark, str(tmp_path / "counted"), "data", "meta.pageCount", ["id"])
    assert sorted(r.id for r in each.collect()) == ["1", "2"] and sorted((r.page_count, r.n) for r in counted.collect()) == [(2, 0), (2, 2)]
    (tmp_path / "bulk.csv").write_text("\ufeffId, Name\n1, A\n\nx,B\n")
    (tmp_path / "bulk.json").write_text('[{"id": 3, "name": "C"}]')
    assert sorted((r.id or 0, r.name) for r in feeds.bulk(spark, str(tmp_path / "bulk.csv"), "id int, name string").collect()) == [(0, "B"), (1, "A")]
    assert [(r.id, r.name) for r in feeds.bulk(spark, str(tmp_path / "bulk.json"), "id int, name string").collect()] == [(3, "C")]
    rows = spark.createDataFrame([(1, 'say "x"', None, 1.5, 2.5)], "id int, t string, e string, lon double, lat double")
    sinks.quoted_csv(rows.select("id", "t"), str(tmp_path / "csv"))
    written = b"".join(p.read_bytes() for p in sorted((tmp_path / "csv").glob("part*")))
    assert b'"1","say ""x"""\r\n' in written
    assert json.loads(rows.select(sinks.features(rows, "lon", "lat", "id").alias("x")).first().x)["geometry"]["coordinates"] == [1.5, 2.5]
    site = sinks.sitemap(spark.createDataFrame([("https://x.org/?a=1&b", "2024-01-02")], "u string, d string").select("u", F.to_date("d").alias("d")), "u", "d").first().value
    assert site == "<url><loc>https://x.org/?a=1&amp;b</loc><lastmod>2024-01-02</lastmod></url>"
    (tmp_path / "w.json").write_text('{"entity":"e","daily":{"time":["2024-01-01","2024-01-02"],"t":[1.0,null]},"hourly":{"time":["2024-01-01T00:00"],"h":[5]},"elevation":3}\n')
    days, hours = feeds.weather_payloads(spark, str(tmp_path / "w.json"), ["t"], ["h"])
    assert [(r.time, r.t) for r in days.collect()] == [("2024-01-01", 1.0), ("2024-01-02", None)] and hours.first().h == 5


def test_counts_of_a_stream(spark, tmp_path):
    rows = [(1, "a", "u1", "i1", 0), (2, "a", "u2", "i1", 3600), (3, "a", "u1", "i2", 86_400), (4, "a", "u1", "i2", 86_401), (5, "b", "u1", "i1", 10), (6, "a", "u9", "i9", 50)]
    df = spark.createDataFrame(rows, "event_id long, place string, account string, ip string, s long").select("event_id", "place", "account", "ip", F.timestamp_seconds(F.col("s") + 19_676 * 86_400).alias("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    counts = policies.daily_counts(stream, "place", "ts").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    counts.awaitTermination(120)
    assert {(r.place, str(r.day)): r.n for r in spark.sql("SELECT * FROM counts").collect()} == {("a", "2023-11-15"): 3, ("a", "2023-11-16"): 2, ("b", "2023-11-15"): 1}
    kept = policies.within_limits(df, [("ip", "ts", 7200, 1)])
    assert sorted(r.event_id for r in kept.collect()) == [1, 3, 6]


def test_landed_archives_profiles_and_gaps(spark, tmp_path):
    daily = spark.createDataFrame([("a", "2024-01-01", 2.0), ("a", "2024-01-02", None)], "entity string, time string, rain double")
    hourly = spark.createDataFrame([("a", "2024-01-01T00:00", 10.0), ("a", "2024-01-01T01:00", None), ("a", "2024-01-01T02:00", 20.0)], "entity string, time string, h double")
    got = feeds.archive_days(daily, hourly, {"rain": "rain_mm"}, {"h": "humidity"}).orderBy("day").collect()
    assert [(str(r.day), r.rain_mm, r.humidity) for r in got] == [("2024-01-01", 2.0, 15.0), ("2024-01-02", 0.0, 0.0)]
    rows = spark.createDataFrame([("x", 1.0), ("y", float("nan")), ("z", 2.0), ("w", None)], "slug string, v double")
    known = spark.createDataFrame([("x", 1), ("y", 2), ("w", 4)], "slug string, id int")
    active = spark.createDataFrame([(1, "old", 0.5, True), (2, "old", 0.6, True)], "id int, version string, v double, active boolean")
    profiles, rejected = feeds.load_profiles(rows, known, active, ["v"], "new")
    assert sorted(tuple(r) for r in profiles.collect()) == [(1, "new", 1.0, True), (1, "old", 0.5, False), (2, "old", 0.6, True)]
    assert sorted(tuple(r) for r in rejected.collect()) == [("w", "not_finite"), ("y", "not_finite"), ("z", "unknown_slug")]
    found = spark.createDataFrame([(1, 10.0, 10.0), (1, 10.0, 10.0), (2, 10.2, 10.0), (3, 50.0, 50.0)], "id int, lat double, lon double")
    gaps = spark.createDataFrame([(7, 10.0, 10.05), (8, 10.25, 10.0)], "gap_id int, lat double, lon double")
    assert sorted((r.id, r.gap_id) for r in feeds.near_gaps(found, gaps, 30_000).collect()) == [(1, 7), (2, 8)]
    points = spark.createDataFrame([(i, float(i), 1.0) for i in range(5)], "id int, lon double, lat double").repartition(3)
    sinks.feature_collection(points, str(tmp_path / "fc"), "lon", "lat", "id")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "fc").glob("part*")))
    assert sorted(f["properties"]["id"] for f in json.loads(whole)["features"]) == [0, 1, 2, 3, 4]
    sinks.sitemap_document(spark.createDataFrame([("https://x.org/?a=1&b", "2024-01-02")], "u string, d string").select("u", F.to_date("d").alias("d")), str(tmp_path / "sm"), "u", "d")
    whole = "".join(p.read_text() for p in sorted((tmp_path / "sm").glob("part*")))
    assert whole.startswith("<?xml") and whole.rstrip().endswith("</url>\n</urlset>")


def test_rollups_touch_only_their_buckets(spark, tmp_path):
    rollup = lambda df: df.groupBy("k").agg(F.count("*").alias("n"))
    run = policies.refresh_rollups(str(tmp_path / "r"), str(tmp_path / "f"), "k", rollup, 8)
    first = spark.createDataFrame([(i % 20,) for i in range(100)], "k int")
    more = spark.createDataFrame([(3,), (3,), (21,)], "k int")
    run(first, 0), run(more, 1), run(more, 1)  # the second batch ran twice
    got = {r.k: r.n for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert got == {**{i: 5 for i in range(20)}, 3: 7, 21: 1}


def test_locality(spark):
    own = "Alice Lake Provincial Park"
    cases = [  # notes, latitude, longitude, locality
        ("The nearest towns and cities are Hope and Yale, far off", 49.0, -121.0, "Hope"), ("Closest community is the town of St. Ives; bring food", None, None, "St. Ives"),
        ("It lies 12.5 km northeast of Fort Nelson on a road", 58.0, -122.0, "Fort Nelson"), ("Camp outside of Lac La Hache village", 51.8, -121.5, "Lac La Hache"),
        ("Nearest city is Hope or Yale.", None, None, "Hope"), ("Nearest community is Alice Lake Park. 3 miles south of Squamish", 49.7, -123.1, "Squamish"),
        ("near Highway", 49.7, -123.0, "Lower Mainland"), ("near water", 58.0, -122.0, "Northern British Columbia"), ("<p>on Vancouver&nbsp;Island</p>", 49.0, -124.0, "Vancouver Island"),
        ("in the Okanagan Valley", 49.5, -119.5, "Okanagan"), ("in the Okanagan Valley", 49.5, -117.0, "Kootenay"), ("the Kootenay region", None, -117.0, "Kootenay"),
        ("", None, None, "British Columbia"), (None, float("nan"), 1.0, "British Columbia"), ("1 km north of Hope Hwy’s Road", 50.9, -123.0, "Hope Hwy"), ("Peace River country", 49.0, -119.0, "Peace River"),
    ]
    df = spark.createDataFrame([(i, own, *c) for i, c in enumerate(cases)], "i int, name string, notes string, lat double, lon double, want string")
    got = df.select("notes", "want", rules.locality(F.col("name"), F.col("notes"), F.lit(None).cast("string"), F.col("lat"), F.col("lon")).alias("got")).collect()
    assert [(r.notes, r.got) for r in got] == [(r.notes, r.want) for r in got]
    told = spark.createDataFrame([(" BC ",), (None,), ("Hope",), ("Unknown",)], "v string").select(rules.is_generic_locality(F.col("v"))).collect()
    assert [r[0] for r in told] == [True, True, False, True]
