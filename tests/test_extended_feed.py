"""Typed tables of the extended dialect, a resumable stream, and the guard of the scratch folder."""

import pytest

from farandole import scratch
from farandole.sources import extended, feeds
from farandole.streaming import realtime

FILES = {
    "stops": "stop_id,stop_name,stop_lat,stop_lon,location_type,parent_station,geometry_id\na,A,48,2,0,z,\na,A2,49,3,0,,\nz,Z,48,2,1,,\ny,Zone,48,2,2,,g2\nx,Door,48,2,3,z,\nw,?,48,2,9,,\n",
    "routes": "route_id,route_name,direction_type,line_id,geometry_id\nr,R,forward,l1,g1\nq,Q,backward,none,\n",
    "trips": "route_id,service_id,trip_id,trip_headsign,block_id,company_id,physical_mode_id,trip_property_id\nr,s,t,H,b,c,Bus,p\nr,s,u,,,,,\n",
    "stop_times": "trip_id,arrival_time,departure_time,stop_id,stop_sequence\nt,08:00:00,08:01:00,a,1\n",
    "feed_infos": "feed_info_param,feed_info_value\nfeed_creation_date,20240102\nfeed_creation_time,03:04:05\nlang,fr\nlang,de\n",
    "networks": "network_id,network_name,network_timezone,network_lang,network_sort\nn,N,Europe/Paris,fr,-1\nm,M,,,3\nn,again,,,\n",
    "lines": "line_id,line_code,line_name,line_sort,network_id,commercial_mode_id,line_opening_time,line_closing_time\nl1,1,One,-1,n,bus,05:00:00,25:30:00\nl2,2,Two,4,,nope,,\n",
    "companies": "company_id,company_name\nc,C\n,nameless\n",
    "physical_modes": "physical_mode_id,physical_mode_name,co2_emission\nBus,Bus,132.5\nTram,Tram,x\n",
    "commercial_modes": "commercial_mode_id,commercial_mode_name\nbus,Bus\n",
    "contributors": "contributor_id,contributor_name\nk,K\n",
    "frames": "frame_id,contributor_id,frame_start_date,frame_end_date\nf,k,20240101,20240131\ng,unknown,20240101,20240131\n",
    "line_groups": "line_group_id,line_group_name,main_line_id\nlg,G,l1\n",
    "line_group_links": "line_group_id,line_id\nlg,l2\nlg,l9\n",
    "comments": "comment_id,comment_name\nc1,Hello\n",
    "comment_links": "object_id,object_type,comment_id\nl1,LINE,c1\nl1,line,c1\nt,trip,c1\nl1,line,c9\n",
    "object_codes": "object_type,object_id,object_system,object_code\nStop,a,Old,1\nstop,a,Old,1\nline,l1,other,2\nline,l1,other,\n",
    "object_properties": "object_type,object_id,object_property_name,object_property_value\nLine,l1,k,v\n",
    "equipments": "equipment_id,wheelchair_boarding,sheltered,elevator,escalator,bike_accepted,bike_depot,visual_announcement,audible_announcement,appropriate_escort,appropriate_signage\ne,1,0,1,2,0,0,0,0,0,1\n",
    "trip_properties": "trip_property_id,wheelchair_accessible,bike_accepted,school_vehicle\np,1,1,0\n",
    "grid_calendars": "grid_calendar_id,name,monday,tuesday,wednesday,thursday,friday,saturday,sunday\ngc,Week,1,1,1,1,1,0,0\n",
    "grid_periods": "grid_calendar_id,start_date,end_date\ngc,20240101,20240105\ngc,bad,20240105\n",
    "grid_exception_dates": "grid_calendar_id,date,type\ngc,20240103,0\ngc,20240106,1\ngc,20240107,2\n",
    "grid_rel_calendar_line": "grid_calendar_id,line_id\ngc,l1\ngc,l9\nx,l1\n",
    "admin_stations": "admin_id,station_id\nad,z\nad,nope\n",
    "addresses": "address_id,street_name,house_number\nd,Main,7\n",
    "geometries": "geometry_id,geometry_wkt\ng1,\"LINESTRING(2 48, 3 49)\"\ng2,\"MultiPolygon (((0 0, 1 0, 1 1, 0 0)))\"\ng3,POINT(1 1)\n",
}


def rows(df):
    return {tuple(r) for r in df.collect()}


@pytest.fixture(scope="module")
def feed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("feed")
    for name, content in FILES.items():
        (folder / f"{name}.txt").write_text(content)
    return feeds.read_feed(spark, str(folder), feeds.NTFS)


def test_dimensions(feed):
    assert rows(extended.parameters(feed["feed_infos"])) == {("lang", "fr"), ("feed_creation_datetime", "2024-01-02T03:04:05")}
    networks = extended.networks(feed["networks"])
    assert {(r.network_id, r.name, r.timezone, r.sort) for r in networks.collect()} == {("n", "N", "Europe/Paris", None), ("m", "M", None, 3)}
    modes = extended.commercial_modes(feed["commercial_modes"])
    lines = extended.lines(feed["lines"], networks, modes)
    assert {(r.line_id, r.sort, r.network_id, r.commercial_mode_id, r.opening, r.closing) for r in lines.collect()} == {("l1", None, "n", "bus", 18_000, 5_400), ("l2", 4, extended.DEFAULT_NETWORK, extended.DEFAULT_MODE, None, None)}
    with pytest.raises(ValueError, match="unknown network n"):
        extended.lines(feed["lines"], networks.where("network_id = 'm'"), modes)
    assert rows(extended.routes(feed["routes"], lines)) == {("r", "R", "forward", "l1", "g1")}
    assert rows(extended.companies(feed["companies"])) == {("c", "C")}
    assert rows(extended.physical_modes(feed["physical_modes"])) == {("Bus", "Bus", 132.5), ("Tram", "Tram", None)}
    contributors = extended.contributors(feed["contributors"])
    assert [(r.frame_id, str(r.begin), str(r.end)) for r in extended.frames(feed["frames"], contributors).collect()] == [("f", "2024-01-01", "2024-01-31")]
    assert rows(extended.line_groups(feed["line_groups"], feed["line_group_links"], lines)) == {("lg", "G", "l1", True), ("lg", "G", "l2", False)}
    assert {(r.geometry_id, r.kind) for r in extended.geometries(feed["geometries"]).collect()} == {("g1", "LINESTRING"), ("g2", "MULTIPOLYGON")}
    assert rows(extended.addresses(feed["addresses"])) == {("d", "Main", "7")}


def test_links_and_bits(feed, spark):
    assert rows(extended.comments(feed["comments"], feed["comment_links"])) == {("line", "l1", "c1", "Hello"), ("trip", "t", "c1", "Hello")}
    assert rows(extended.object_codes(feed["object_codes"], "old")) == {("stop", "a", "external_code", "1"), ("line", "l1", "other", "2")}
    assert rows(extended.object_properties(feed["object_properties"])) == {("line", "l1", "k", "v")}
    assert rows(extended.equipments(feed["equipments"])) == {("e", 1 | 4 | 512)}
    assert rows(extended.trip_properties(feed["trip_properties"])) == {("p", 3)}
    grids = extended.grid_calendars(feed["grid_calendars"])
    assert rows(grids) == {("gc", "Week", 31)}
    assert {(r.grid_calendar_id, str(r.begin), str(r.end)) for r in extended.grid_periods(feed["grid_periods"]).collect()} == {("gc", "2024-01-01", "2024-01-06")}
    assert {(str(r.day), r.type) for r in extended.grid_exceptions(feed["grid_exception_dates"]).collect()} == {("2024-01-03", 2), ("2024-01-06", 1)}
    lines = spark.createDataFrame([("l1",)], "line_id string")
    assert rows(extended.grid_links(feed["grid_rel_calendar_line"], grids, lines, "line_id")) == {("gc", "l1")}
    assert rows(extended.admin_stations(feed["admin_stations"], spark.createDataFrame([("z",)], "area_id string"))) == {("ad", "z")}
    assert {(r.stop_id, r.kind, r.name) for r in extended.zones_and_access(feed["stops"]).collect()} == {("a", "stop", "A"), ("z", "area", "Z"), ("y", "zone", "Zone"), ("x", "access", "Door")}


def test_trips_split_over_offsets(feed, spark):
    days = spark.sql("select 's' as service_id, explode(sequence(date'2024-03-29', date'2024-04-02')) as day")
    out = extended.trips(feed["trips"], days, extended.trip_properties(feed["trip_properties"]), "Europe/Paris")
    want = {(t, part, bits, b, e, o) for t, bits in (("t", 3), ("u", 0)) for part, b, e, o in ((0, "2024-03-29", "2024-03-30", 60), (1, "2024-03-31", "2024-04-02", 120))}
    assert {(r.trip_id, r.part, r.bits, str(r.begin), str(r.end), r.offset) for r in out.collect()} == want


def test_default_modes(spark):
    told = spark.createDataFrame([("a", "0"), ("b", "102"), ("c", "x"), ("d", None), ("e", "401")], "route_id string, route_type string")
    assert rows(extended.default_modes(told)) == {("a", "Tramway"), ("b", "Train"), ("c", "Bus"), ("d", "Bus"), ("e", "Metro")}


def test_first_line_counts(feed):
    assert {(r.stop_id, r.stop_name) for r in feeds.stop_points(feed["stops"]).collect()} == {("a", "A")}


def test_stream_goes_on(spark, tmp_path):
    say = lambda name, *told: spark.createDataFrame([(i, t, u, "view", float(i), "") for i, t, u in told], "event_id long, t string, user_id long, event_type string, value double, props string").selectExpr("event_id", "cast(t as timestamp_ntz) ts", "user_id", "event_type", "value", "props").coalesce(1).write.parquet(str(tmp_path / "in" / name))
    say("one", (1, "2024-01-01 00:00:00", 7), (2, "2024-01-01 00:00:00", 8))
    run = lambda: {(r.entity_id, r.id) for r in realtime.latest_by_stream(spark, str(tmp_path / "in" / "*"), str(tmp_path / "state")).collect()}
    assert run() == {(7, 1), (8, 2)}
    say("two", (3, "2024-01-02 00:00:00", 7), (4, "2023-01-01 00:00:00", 8))
    assert run() == {(7, 3), (8, 2)} and run() == {(7, 3), (8, 2)}
    state = realtime.LatestState(spark, str(tmp_path / "state" / "state"))
    before, epochs = state.table().count(), sorted(p.name for p in (tmp_path / "state" / "state").glob("epoch=*"))
    last = int(epochs[-1][6:])
    batch = realtime.messages(spark.read.parquet(str(tmp_path / "in" / "two")))
    state.apply(batch, last)  # a replay
    assert state.table().count() == before and {(r.entity_id, r.id) for r in state.table().collect()} == {(7, 3), (8, 2)}


def test_scratch_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *_: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"
            getConf = staticmethod(lambda: Session.conf)

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session)
