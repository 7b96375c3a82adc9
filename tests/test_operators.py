"""Operators on literal rows: boundaries, nulls, errors, geometry, sources, web services, streams."""

import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from trailforge import columns as C
from trailforge.core import MissingColumns, process
from trailforge.functions import geodesy, wkt
from trailforge.model import DataModel, HmmModel, period
from trailforge.operators import enrich, features, fragments, hmm, missions, outliers, segments
from trailforge.sources import io
from trailforge.streaming import runs as stream_runs

M = DataModel(timestamp=C.TIMESTAMP)


def column(df, name, order="k"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_states_on_boundaries_and_nulls(spark):
    df = spark.createDataFrame([(0, None), (1, 600), (2, 599), (3, 43200), (4, 43201)], f"k int, {C.DURATION} long").withColumn(C.MOTION_DURATION, F.col(C.DURATION))
    assert column(process(df, features.GapState()), C.GAP_STATE) == ["not_a_gap"] * 4 + ["GAP"]
    assert column(process(df, features.VisibilityProportion(threshold=600)), C.VISIBILITY) == [1.0, 1.0, 1.0, 0.0, 0.0]
    still = df.withColumn(C.MOVING_STATE, F.when(F.col("k") < 4, "STILL"))
    both = process(still, features.CourseOrStop(), features.CourseState())
    assert column(both, C.COURSE_OR_STOP) == ["STOP", "STOP", "COURSE", "STOP", "COURSE"]
    assert column(both, C.COURSE_STATE) == [None, None, "PAUSE", None, None]
    assert column(process(df.withColumn(C.DISTANCE, F.lit(10.0)).withColumn(C.DURATION, F.col("k").cast("long")), features.Speed("s")), "s")[0] is None


def test_missing_columns(spark):
    with pytest.raises(MissingColumns, match="frag_duration_s"):
        process(spark.range(3), features.GapState())


def test_runs_go_on_over_null_states(spark):
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 3, "x"), ("a", 4, None), ("a", 5, "x"), ("a", 6, "y"), ("b", 1, "y")]
    out = process(spark.createDataFrame(rows, "id string, k int, state string"), segments.RunOnChange("id", "state", "k", "run"))
    assert {(r.id, r.k): r.run for r in out.collect()} == {("a", 1): "a#1", ("a", 2): "a#2", ("a", 3): "a#2", ("a", 4): "a#2", ("a", 5): "a#5", ("a", 6): "a#6", ("b", 1): "b#1"}


def test_summary_keeps_other_rows(spark):
    base = {C.NB_POINTS: 2, C.TRAIL: "LINESTRING (2 48, 3 48)", C.DURATION: 10, C.END_LAT: 48.0, C.END_LON: 3.0, C.CENTER_LAT: 48.0, C.CENTER_LON: 2.5, C.DISTANCE: 100.0}
    rest = {C.COURSE_OR_STOP: "COURSE", C.COURSE_STATE: "PAUSE", C.MOTION_DURATION: 20, C.COURSE_ID: "c", C.COURSE_DURATION: 50}
    rows = [base | rest | {"id": "o", C.MOTION_ID: m, C.START: s, C.END: s + 10, C.MOVING_STATE: st} for m, s, st in (("m1", 0, "STILL"), ("m1", 10, "STILL"), ("m2", 20, "MOVE"), ("m3", 30, None))]
    out = {(r[C.MOTION_ID]): r for r in process(spark.createDataFrame(pd.DataFrame(rows)), fragments.StopPauseSummary(M)).collect()}
    assert len(out) == 3 and out["m1"][C.NB_POINTS] == 3 and out["m1"][C.DURATION] == 20 and out["m1"][C.SPEED] == 10.0
    assert out["m1"][C.TRAIL] == "LINESTRING (2 48, 3 48, 2 48, 3 48)" and out["m1"][C.FRAGMENT_ID] == "m1#0_20"
    assert out["m2"][C.DISTANCE] == 100.0 and out["m3"][C.MOVING_STATE] is None


def test_summaries_read_their_rows_once(spark):
    """Equal rows, rows without a key and rows without a state all pass, and what makes the table is in the plan once."""
    fixed = {C.NB_POINTS: 2, C.TRAIL: "LINESTRING (0 0, 1 1)", C.DURATION: 10, C.END_LAT: 1.0, C.END_LON: 1.0, C.CENTER_LAT: 0.5, C.CENTER_LON: 0.5, C.DISTANCE: 5.0, C.VISIBILITY: 1.0, C.COURSE_DURATION: 10}
    kinds = [("c", C.COURSE), ("c", C.STOP), ("c", C.STOP), ("c", None), ("c", None), (None, C.COURSE), (None, C.COURSE), ("c", C.COURSE), ("c", C.COURSE)]
    rows = [{"id": "o", "n": i, C.COURSE_ID: key, C.COURSE_OR_STOP: kind, C.COURSE_STATE: C.MOTION, C.MOVING_STATE: C.MOVE, C.START: 0, C.END: 10, **fixed} for i, (key, kind) in enumerate(kinds)]
    rows[7] |= {C.START: -10, C.END: 0, C.TRAIL: None}
    rows[8] |= {C.START: 10, C.END: 20, C.MOVING_STATE: C.STILL, C.CENTER_LON: 0.123456789, C.CENTER_LAT: -0.00000001}
    df = spark.createDataFrame(rows, ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in (rows[0] | {"id": "o"}).items()))
    out = process(df.repartition(3), fragments.CourseExtraction(M))
    got = out.collect()
    assert sorted(r.n for r in got if r.n is not None) == [3, 4, 5, 6]
    (course,) = (r for r in got if r.n is None)
    assert (course[C.START], course[C.END], course[C.NB_POINTS], course[C.DISTANCE]) == (-10, 20, 4, 15.0)
    # the first place is that of the first row with a trail; a still row gives its centre, as the trail has it
    assert course[C.TRAIL] == "LINESTRING (0 0, 1 1, 0.1234568 0)"
    assert [course[f"{s}{x}"] for s in (C.DEPARTURE, C.ARRIVAL) for x in ("lat", "lon")] == [0.0, 0.0, 0.0, 0.123457]
    assert out._jdf.queryExecution().analyzed().toString().count("LogicalRDD") == 1


def test_missions_make_no_trails(spark):
    """The places of courses need no Python, and the fold's rows are as narrow as can be."""
    from trailforge.plans import catalog

    plan = catalog.QUERIES["mission_tag"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 0 and plan.count("MapInArrow") == 1 and plan.count("Relation") == 1


def test_main_tempo(spark):
    summary = fragments.StopPauseSummary(M, tempos={"a": "fast", "b": "slow", "i": C.IRREGULAR})
    df = spark.createDataFrame([(0, 0.5, 0.4, 0.1), (1, 0.0, 0.0, 1.0), (2, 0.05, 0.9, 0.05)], "k int, a double, b double, i double").withColumns(summary._main_tempo())
    assert column(df, C.TEMPO) == ["fast", C.IRREGULAR, "slow"] and column(df, C.TEMPO_MULTI) == [True, False, False]


def test_missions_begin_where_the_way_turns_back(spark):
    places = [(0.0, 0.0), (0.0, 1.0), (0.0, 2.0), (0.0, 0.5), (0.0, 0.1)]
    rows = [("o", i, i * 10, i * 10 + 10, 5, *places[i], *places[i + 1]) for i in range(4)]
    df = spark.createDataFrame(rows, f"id string, k int, {C.START} long, {C.END} long, {C.COURSE_DURATION} long, departure_lat double, departure_lon double, arrival_lat double, arrival_lon double")
    df = df.withColumns({f"{s}{f}": F.lit(s + f) for s in (C.DEPARTURE, C.ARRIVAL) for f in C.ADDRESS_FIELDS} | {"sensor": F.lit(7.0), "gps": F.lit(8.0)})
    out = process(df, missions.Missions(M, "sensor", "gps"))
    assert column(out, "mission_id") == ["o#0_20", "o#0_20", "o#20_40", "o#20_40"]
    assert column(out, "mission_duration_s") == [10] * 4 and abs(column(out, "mission_straight_line_m")[0] - 222638.98) < 0.1


def test_viterbi_and_unknown(spark):
    model = HmmModel.parse(json.dumps({"states": ["S", "M"], "bin_edges": [1], "emission_probability": {"S": [0.9, 0.1], "M": [0.1, 0.9]}, "transition_probability": {"S": {"S": 0.7, "M": 0.3}, "M": {"S": 0.3, "M": 0.7}}, "init_probability": {"S": 0.5, "M": 0.5}}))
    import itertools
    import math

    import numpy as np

    r = random.Random(3)
    for _ in range(20):
        values = [r.choice([0.0, 2.0]) for _ in range(6)]

        def weight(path, values=values):
            p = math.log(model.initial[path[0]])
            p += sum(math.log(model.transition[a][b]) for a, b in zip(path, path[1:], strict=False))
            return p + sum(math.log(model.emission[s][int(v >= 1)]) for s, v in zip(path, values, strict=True))

        best = max(weight(p) for p in itertools.product("SM", repeat=6))
        assert abs(weight(hmm.viterbi(model, np.array(values))) - best) < 1e-9
    never = HmmModel(("S",), (1.0,), {"S": (1.0, 0.0)}, {"S": {"S": 1.0}}, {"S": 1.0})
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 5.0, None])], f"id string, {C.TIMESTAMP} int, v double")
    assert {r.st for r in process(df, hmm.HmmStates("v", never, "id", "st", chunk=2)).where(f"{C.TIMESTAMP} < 2").collect()} == {"Unknown"}
    with pytest.raises(MissingColumns, match="Missing required column w to compute HMM"):
        process(df, hmm.HmmStates("w", model, "id", "st"))
    with pytest.raises(FileNotFoundError, match="HMM model not found"):
        HmmModel.read(spark, "/nowhere/model.json")


def test_chunks_are_decoded_together(spark):
    """As one by one, by a step for each value: chunks of many lengths, over several batches, scalars and lists, and with a limit."""
    import numpy as np

    model = HmmModel(("S", "M", "A"), (1.0, 2.0), {"S": (0.8, 0.2, 0.0), "M": (0.1, 0.6, 0.3), "A": (0.3, 0.3, 0.4)}, {"S": {"S": 0.7, "M": 0.3, "A": 0.0}, "M": {"S": 0.3, "M": 0.4, "A": 0.3}, "A": {"S": 0.2, "M": 0.2, "A": 0.6}}, {"S": 1.0, "M": 0.0, "A": 0.0})

    def plain(values):
        with np.errstate(divide="ignore"):
            start, step = np.log([model.initial[s] for s in model.states]), np.log([[model.transition[a][b] for b in model.states] for a in model.states])
            emit = np.log([model.emission[s] for s in model.states])[:, np.searchsorted(model.edges, values, side="right")].T
        score, back = start + emit[0], []
        for e in emit[1:]:
            back.append((score[:, None] + step).argmax(0))
            score = (score[:, None] + step).max(0) + e
        path = [int(score.argmax())]
        if not np.isfinite(score[path[0]]):
            return ["Unknown"] * len(values)
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return [model.states[k] for k in reversed(path)]

    r = random.Random(5)
    objects = {f"o{k}": [r.choice([[], [0.5], [1.0, 2.5, None], [float("nan"), 1.5], None]) for _ in range(r.choice([1, 2, 6, 7, 8, 40]))] for k in range(60)}
    rows = [(o, i, v, (v or [None])[0]) for o, vs in objects.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), f"id string, {C.TIMESTAMP} int, v array<double>, x double")
    clean = lambda v: [0.0 if x is None or x != x else x for x in v or [None]]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        for source, listed in (("v", clean), ("x", lambda v: clean(v)[:1])):
            want = {}
            for o, vs in objects.items():
                for at in range(0, len(vs), 7):
                    own = [listed(v) for v in vs[at : at + 7]]
                    states = plain(np.array([x for v in own for x in v]))
                    for i, v in enumerate(own):
                        mine, states = states[: len(v)], states[len(v) :]
                        want[o, at + i] = min(set(mine), key=lambda s: (-mine.count(s), s))
            out = process(df, hmm.HmmStates(source, model, "id", "st", chunk=7))
            assert {(q.id, q[C.TIMESTAMP]): q.st for q in out.collect()} == want and out.columns[-1] == "st"
            assert all(want[q.id, q[C.TIMESTAMP]] == q.st for q in out.limit(3).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("name", ["hmm_moving_state", "hmm_tempo"])
def test_states_cost_no_other_columns(spark, name):
    """Columns that a query of hidden states doesn't return aren't made: no geodesics, no trails."""
    from trailforge.plans import catalog

    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "ATAN" not in plan.upper() and C.TRAIL not in plan


def test_published_geodesics(spark):
    """Lengths and bearings from the literature: Flinders Peak to Buninyong, JFK to LHR, a degree of the equator, a quarter meridian."""
    dms = lambda d, m, s: (abs(d) + m / 60 + s / 3600) * (1 if d >= 0 else -1)
    rows = [
        (dms(-37, 57, 3.7203), dms(144, 25, 29.5244), dms(-37, 39, 10.1561), dms(143, 55, 35.3839), 54972.271, dms(306, 52, 5.37)),
        (40.6, -73.8, 51.6, -0.5, 5551759.400, 51.198882845579824), (0.0, 10.0, 0.0, 11.0, 111319.491, 90.0), (0.0, 0.0, 90.0, 0.0, 10001965.729, 0.0), (5.0, 5.0, 5.0, 5.0, 0.0, 0.0),
    ]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, length double, bearing double")
    for r in geodesy.with_geodesic(df, "a", "b", "c", "d", "got", "toward").collect():
        assert abs(r.got - r.length) < 2e-3 and abs(r.toward - r.bearing) < 2e-6, r
        assert abs(missions.inverse(r.a, r.b, r.c, r.d) - r.length) < 2e-3


def test_geometry_of_rings_and_long_lines():
    square = "POLYGON ((0 0, 5 0.00001, 10 0, 10 10, 0 10, 0 0), (2 2, 2 2.00001, 2.00001 2, 2 2), (4 4, 6 4, 6 6, 4 6, 4 4))"
    assert wkt.simplify(square) == "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
    assert wkt.simplify("POLYGON ((0 0, 0 0.00001, 0.00001 0, 0 0))") == "POLYGON EMPTY" and wkt.simplify("POINT (1 2)") == "POINT (1 2)"
    assert wkt.simplify(f"MULTIPOLYGON ({square[8:]}, ((20 0, 30 0, 30 9, 20 0)))") == "MULTIPOLYGON (((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4)), ((20 0, 30 0, 30 9, 20 0)))"
    assert wkt.split_antimeridian("LINESTRING (-100 0, 0 0, 100 0)") == "LINESTRING (-100 0, 0 0, 100 0)"
    assert wkt.split_antimeridian("LINESTRING (-90 0, 90 10)") == "MULTILINESTRING ((-90 0, -180 5), (180 5, 90 10))"
    assert wkt.split_antimeridian("LINESTRING (170 0, -170 10, 170 20)") == "MULTILINESTRING ((170 0, 180 5), (-180 5, -170 10, -180 15), (180 15, 170 20))"


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_times_in_every_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        raw = spark.createDataFrame([("a", "2018-06-01 00:00:00")], "id string, timestamp string")
        plain = process(raw, features.StandardTimestamp(DataModel(time_format="yyyy-MM-dd HH:mm:ss")))
        assert column(plain, C.TIMESTAMP, "id") == [1527811200]
        zoned = process(raw.withColumn("timestamp", F.concat("timestamp", F.lit("+02:00"))), features.StandardTimestamp(DataModel(time_format="yyyy-MM-dd HH:mm:ssXXX")))
        assert column(zoned, C.TIMESTAMP, "id") == [1527811200 - 7200]
        times = spark.range(0, 4 * 86400, 3600).select((F.col("id") + 1527811200).alias(C.TIMESTAMP))
        days = process(times, features.TimePartition())
        inside = io.within(days, period("2018-06-01T22:00:00+00:00", "2018-06-03T03:00:00+00:00")).count()
        assert inside == 30
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_large_integers_stay_whole(spark):
    """Whole rows pass through Python with their types: a long beyond doubles, beside a null."""
    big = (1 << 60) + 1
    model = HmmModel(("S", "M"), (1.0,), {"S": (0.9, 0.1), "M": (0.1, 0.9)}, {"S": {"S": 0.5, "M": 0.5}, "M": {"S": 0.5, "M": 0.5}}, {"S": 0.5, "M": 0.5})
    df = spark.createDataFrame([("a", 1, 0.0, big), ("a", 2, 5.0, None)], f"id string, {C.TIMESTAMP} int, v double, n long")
    out = process(df, hmm.HmmStates("v", model, "id", "st"))
    assert [(r.st, r.n) for r in out.orderBy(C.TIMESTAMP).collect()] == [("S", big), ("M", None)]
    named = df.withColumns({f"{s}{f}": F.lit(s) for s in (C.DEPARTURE, C.ARRIVAL) for f in C.ADDRESS_FIELDS} | {f"{s}{x}": F.lit(1.0) for s in (C.DEPARTURE, C.ARRIVAL) for x in ("lat", "lon")})
    named = named.withColumns({C.START: F.col(C.TIMESTAMP).cast("long"), C.END: F.col(C.TIMESTAMP).cast("long"), C.COURSE_DURATION: F.lit(1)})
    plan = process(named, missions.Missions(M, "v", "v"))
    assert {r.n for r in plan.collect()} == {big, None}
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    asked = process(df.withColumns({"lat": F.lit(1.0), "lon": F.lit(2.0)}), enrich.Addresses("{lat}{lon}{zoom}", "lat", "lon", fetcher=lambda u: None))
    assert {r.n for r in asked.collect()} == {big, None}


def test_fetch_from_a_server():
    import http.server
    import threading

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            self.send_response(200 if self.path == "/ok" else 400)
            self.end_headers()
            self.wfile.write("é".encode())

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    assert enrich.fetch(f"{at}/ok") == "é" and enrich.fetch(f"{at}/bad") is None and enrich.fetch_or_fail(f"{at}/bad") is None
    server.shutdown()
    server.server_close()
    assert enrich.fetch(at) is None
    with pytest.raises(enrich.ServiceUnavailable):
        enrich.fetch_or_fail(at)


def test_geometry():
    assert wkt.number(-0.00000001) == "0" and wkt.number(1.10) == "1.1" and wkt.number(12345678.5) == "12345678.5"
    assert wkt.simplify(None) is None and wkt.simplify("") is None
    assert wkt.simplify("LINESTRING (0 0, 1 0.0001, 2 0, 2 5)") == "LINESTRING (0 0, 2 0, 2 5)"
    assert wkt.split_antimeridian("LINESTRING (179 10, -179 12)") == "MULTILINESTRING ((179 10, 180 11), (-180 11, -179 12))"
    assert wkt.split_antimeridian("LINESTRING (1 1, 2 2)") == "LINESTRING (1 1, 2 2)" and wkt.split_antimeridian("POINT (1 1)") == "POINT (1 1)" and wkt.split_antimeridian(None) is None
    assert wkt.geohashes(None) == [] and wkt.geohash(57.64911, 10.40744, 11) == "u4pruydqqvj"
    assert wkt.joined_trail(["POINT (1 1)", "LINESTRING (1 1, 2 2)"], [5, 6], [7, 8], [True, False]) == "LINESTRING (1 1, 8 6)"
    assert wkt.joined_trail(["POINT (1 1)"], [], [], []) is None
    assert wkt.grouped_trails(True, [True, True, False, True], ["LINESTRING (0 0, 1 1)", "LINESTRING (1 1, 2 2)", "POINT (3 3)", "POINT (4 4)"]) == "MULTILINESTRING ((0 0, 1 1, 2 2), (4 4, 4 4))"
    many = [(float(i // 2), 0.0) for i in range(1_000_000)]
    assert len(wkt.without_repeats(many)) == 500_000


def test_formatting(spark):
    raw = spark.createDataFrame([("a", "2018-06-01T00:00:00+00:00", "1,5", "x"), ("a", "2018-06-01T00:00:00+00:00", "1,5", "x"), ("b", "bad", "2.5", None)], "id string, timestamp string, lat string, lon string")
    got = sorted((r.id, r.lat, r.lon, r[C.TIMESTAMP], r[C.PARTITION]) for r in features.formatted(raw, DataModel()).collect())
    assert got == [("a", 1.5, None, 1527811200, 20180601), ("b", 2.5, None, None, None)]
    assert features.valid_name("_My Col-é 1") == "my_col_1"
    with pytest.raises(ValueError, match="cannot be made"):
        features.nested(raw, {"lat": {"a": "lon"}})


def test_outliers_at_the_ends(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([1.0, 1.0, 50.0, 1.0, None, 1.0])], f"id string, {C.TIMESTAMP} int, v double")
    out = process(df, outliers.LocalOutliers("id", "bad", ["v"], 1, 10.0, keep_innovation=True))
    assert column(out, "bad", C.TIMESTAMP) == [False, False, True, False, False, False]
    assert process(out, outliers.WithoutOutliers("bad")).count() == 5


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("a", 1527811200, 48.0, 2.0, ["x", "y"], 20180601), ("b", 1527897600, 1.0, 2.0, None, 20180602)], f"id string, {C.TIMESTAMP} long, lat double, lon double, tags array<string>, {C.PARTITION} int")
    io.write_parquet(df, f"{tmp_path}/p", files_per_day=2)
    back = io.within(io.read_parquet(spark, f"{tmp_path}/p"), period("2018-06-02T00:00:00+00:00", "2018-06-02T23:00:00+00:00"))
    assert [r.id for r in back.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().toString()
    io.write_csv(df, f"{tmp_path}/c")
    assert sorted(r.tags for r in io.read_csv(spark, f"{tmp_path}/c").collect()) == ["[]", "[x,y]"]
    assert [r.doc_key for r in io.with_document_id(df, M).orderBy("id").collect()][0] == "a#1527811200"


def test_web_services(spark):
    def places(url):
        assert "48.000000" in url or "0.000001" in url
        return json.dumps({"address": {"city": "Here", "country": "There"}}) if "48.0" in url else json.dumps({"error": "none"})

    df = spark.createDataFrame([(0, 48.0, 2.0, True, "old"), (1, 0.000001, 2.0, True, "old"), (2, 48.0, 2.0, False, "old")], "k int, lat double, lon double, go boolean, city string")
    out = process(df, enrich.Addresses("http://x/{lat}/{lon}/{zoom}", "lat", "lon", condition="go", fetcher=places))
    assert column(out, "city") == ["Here", None, "old"] and column(out, "country") == ["There", None, None]
    answer = json.dumps({"paths": [{"distance": 12.5, "time": 3499, "points": {"coordinates": [[1, 2], [3, 4]]}}]})
    trails = spark.createDataFrame([(0, "LINESTRING (0 0, 1 1)"), (1, "POINT (9 9)"), (2, None)], "k int, t string")
    routed = process(trails, enrich.Routes("http://x?{points}", "t", fetcher=lambda u: answer if "0.000000" in u else None))
    assert column(routed, "routing_trail") == ["LINESTRING (1 2, 3 4)", "POINT (9 9)", None]
    assert column(routed, "routing_duration_s") == [3, None, None]


def test_streams(spark, tmp_path):
    points = spark.createDataFrame([("a", 0), ("a", 100), ("a", 50_000), ("b", 10)], f"id string, {C.TIMESTAMP} long")
    points.where(f"{C.TIMESTAMP} < 200").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/in")

    def go(frame, name):
        made = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        done = made.awaitTermination(60)
        made.stop()
        assert done
        return spark.table(name).collect()

    got = go(stream_runs.stream_durations(stream), "made")
    assert sorted((r.id, r[C.TIMESTAMP], r[C.DURATION]) for r in got) == [("a", 0, None), ("a", 100, 100), ("b", 10, None)]
    points.where(f"{C.TIMESTAMP} > 200").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    points.where("id = 'b'").withColumn(C.TIMESTAMP, F.lit(300_000).cast("long")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # the watermark has passed all but the latest point, whose run is still open
    assert {(r.id, r[C.START], r[C.END], r.n) for r in go(stream_runs.gap_runs(stream), "runs")} == {("a", 0, 100, 2), ("b", 10, 10, 1), ("a", 50_000, 50_000, 1)}
