"""Nothing is lost or altered on load: ids, decimals, moved columns, in-sheet order, the version marker."""

import os

import pytest

from riskloom import constants as K
from riskloom.plans import ingest
from riskloom.session import scratch_path
from riskloom.sources import sheets as SH
from riskloom.sources.upsert import upsert_last_wins
from riskloom.streaming.jobs import fresh

HEADERS = list(K.CATALOGUE_HEADERS)


def sheet(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(",".join(line) for line in lines) + "\n", encoding="utf-8")
    return str(path)


def threat(i, name, **more):
    cells = dict.fromkeys(HEADERS, "") | {HEADERS[0]: i, HEADERS[1]: name} | more
    return cells


def threats_sheet(tmp_path, rows, order=None, name="threats.csv"):
    order = order or HEADERS
    return sheet(tmp_path, name, [["banner"] + [""] * (len(order) - 1), order, *[[r.get(h, "x") for h in order] for r in rows]])


def test_ids_with_a_decimal_point_and_moved_columns(spark, tmp_path):
    order = ["Лишний", *reversed(HEADERS)]
    path = threats_sheet(tmp_path, [threat("7", "a"), threat("12.0", "b")], order)
    assert {(r.threat_id, r.name) for r in SH.read_threat_sheet(spark, path).collect()} == {(7, "a"), (12, "b")}
    assert SH.count_rejected(spark, path).first().rejected == 2


def test_a_row_without_id_and_a_missing_header_are_errors(spark, tmp_path):
    path = threats_sheet(tmp_path, [threat("7", "a"), threat("abc", "b")])
    with pytest.raises(Exception, match="without an id"):
        SH.read_threat_sheet(spark, path).collect()
    short = threats_sheet(tmp_path, [threat("7", "a")], HEADERS[:-1], "short.csv")
    with pytest.raises(ValueError, match="missing"):
        SH.read_threat_sheet(spark, short)


INCIDENT = ["Тип предприятия", "Код предприятия", "Количество хостов", "Код реализованной угрозы", "Успех",
            "Регион размещения предприятия", "Дата инцидента", "Региональное время"]


def incidents_sheet(tmp_path, rows, name="incidents.csv"):
    assert {SH.normalise_header(h) for h in INCIDENT} <= {SH.normalise_header(h) for h in K.INCIDENT_SHEET_HEADERS}
    return sheet(tmp_path, name, [INCIDENT, *rows])


def row(code, hosts, threat_code, success, time="12.08.2024 11:00"):
    return ["T", code, hosts, threat_code, success, "R", "12.08.2024", time]


def test_decimal_cells_keep_their_value(spark, tmp_path):
    path = incidents_sheet(tmp_path, [row("1", "5.0", "3.0", "1.0"), row("2", "12.7", "4", ""), row("3", "", "5", "1")])
    got = {r.enterprise_code: (r.host_count, r.threat_code, r.success) for r in SH.read_incident_sheet(spark, path).collect()}
    assert got == {"1": (5, 3, 1), "2": (12, 4, 0), "3": (0, 5, 1)}
    with pytest.raises(Exception, match="not a number"):
        SH.read_incident_sheet(spark, incidents_sheet(tmp_path, [row("1", "five", "3", "1")], "bad.csv")).collect()


def test_last_row_of_a_key_wins_in_a_sheet(spark, tmp_path):
    path = incidents_sheet(tmp_path, [row("1", "9", "3", "1"), row("1", "2", "4", "0"), row("2", "1", "1", "1")])
    rows = upsert_last_wins([SH.read_incident_sheet(spark, path, sequence="seq")], ingest.INCIDENT_KEY, ["seq"], drop=("seq",))
    got = {r.enterprise_code: (r.host_count, r.threat_code, r.success) for r in rows.collect()}
    assert got == {"1": (2, 4, 0), "2": (1, 1, 1)} and "seq" not in rows.columns


def test_versions_survive_a_failed_load_and_a_broken_marker(spark, tmp_path):
    store = scratch_path(spark, os.path.basename(fresh(spark, "store")))
    thr = threats_sheet(tmp_path, [threat("7", "old"), threat("7", "new"), threat("8", "b")])
    inc = incidents_sheet(tmp_path, [row("1", "9", "7", "1")])
    assert ingest.current_version(spark, store) is None
    ingest.load(spark, thr, inc, store).collect()
    first = ingest.current_version(spark, store)
    with pytest.raises(Exception):
        ingest.load(spark, threats_sheet(tmp_path, [threat("bad", "x")], None, "bad.csv"), inc, store)
    assert ingest.current_version(spark, store) == first
    os.makedirs(os.path.join(store, "_versions", "000000002-halfwritten"))   # a crash before the commit
    ingest.load(spark, threats_sheet(tmp_path, [threat("9", "c")], None, "more.csv"), inc, store).collect()
    names = {r.threat_id: r.name for r in ingest.tables(spark, store)[0].collect()}
    assert names == {7: "new", 8: "b", 9: "c"}
    for f in os.listdir(os.path.join(store, f"threats-{ingest.current_version(spark, store)}")):
        if f.startswith("part"):
            with open(os.path.join(store, f"threats-{ingest.current_version(spark, store)}", f), "wb"):
                pass
    with pytest.raises(Exception):           # an unreadable version is never a first load
        ingest.load(spark, thr, inc, store).collect()


def test_line_breaks_in_cells_stay_and_no_row_below_the_header_is_a_banner(spark, tmp_path):
    notes, about = HEADERS[-1], HEADERS[2]
    rows = [threat("7", "a", **{about: '"one\ntwo\nthree"', notes: '"first\nsecond"'}), threat("8", "b", **{notes: "n"})]
    path = threats_sheet(tmp_path, rows)
    got = {r.threat_id: (r.description, r.notes) for r in SH.read_threat_sheet(spark, path).collect()}
    assert got == {7: ("one\ntwo\nthree", "first\nsecond"), 8: (None, "n")}
    store = str(tmp_path / "store")
    inc = incidents_sheet(tmp_path, [row("1", "5", "3", "1")], "ok.csv")
    ingest.load(spark, path, inc, store)
    assert {r.threat_id: r.notes for r in ingest.tables(spark, store)[0].collect()} == {7: "first\nsecond", 8: "n"}
    stray = threats_sheet(tmp_path, [threat("7", "a"), dict.fromkeys(HEADERS, "") | {HEADERS[0]: "tail"}], name="stray.csv")
    with pytest.raises(Exception, match="without an id"):
        SH.read_threat_sheet(spark, stray).collect()


def test_folder_of_sheets_with_other_column_orders(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    threats_sheet(folder, [threat("7", "a"), threat("9", "late")], name="1.csv")
    threats_sheet(folder, [threat("12.0", "b", **{HEADERS[-1]: "n"})], ["Лишний", *reversed(HEADERS)], name="2.csv")
    sheet(folder, "3.csv", [["x" if h == "Лишний" else threat("13", "goes on").get(h, "x") for h in ["Лишний", *reversed(HEADERS)]]])
    assert {(r.threat_id, r.name) for r in SH.read_threat_sheet(spark, str(folder)).collect()} == {
        (7, "a"), (9, "late"), (12, "b"), (13, "goes on")}
    assert SH.count_rejected(spark, str(folder)).first().rejected == 4
    sheet(folder, "0.csv", [["1", "no header before it"]])
    with pytest.raises(ValueError, match="no header row"):
        SH.read_threat_sheet(spark, str(folder))


def test_folder_of_incident_sheets(spark, tmp_path):
    folder = tmp_path / "sheets"
    folder.mkdir()
    incidents_sheet(folder, [row("1", "9", "3", "1")], "1.csv")
    back = list(reversed(INCIDENT))
    sheet(folder, "2.csv", [back, list(reversed(row("2", "8", "4", "0")))])
    sheet(folder, "3.csv", [["Итог"] + [""] * 6, back[1:], list(reversed(row("3", "7", "5", "1")))[1:], [""] * 7])
    got = {r.enterprise_code: (r.host_count, r.threat_code, r.success, str(r.incident_time)) for r in
           SH.read_incident_sheet(spark, str(folder), default_time="2020-01-01 00:00:00").collect()}
    assert got == {"1": (9, 3, 1, "2024-08-12 11:00:00"), "2": (8, 4, 0, "2024-08-12 11:00:00"), "3": (7, 5, 1, "2020-01-01 00:00:00")}
    sheet(folder, "4.csv", [INCIDENT[:4], ["T", "4", "1", "1"]])
    with pytest.raises(ValueError, match="headers missing"):
        SH.read_incident_sheet(spark, str(folder))


def test_headers_beyond_the_first_cells_are_found(spark, tmp_path):
    order = [f"col{i}" for i in range(90)] + HEADERS
    path = threats_sheet(tmp_path, [threat("7", "a", **{HEADERS[-1]: "n"})], order, "wide.csv")
    assert [(r.threat_id, r.name, r.notes) for r in SH.read_threat_sheet(spark, path).collect()] == [(7, "a", "n")]


def test_only_likely_headers_are_sorted_or_parsed_whole(spark, tmp_path):
    """A row that only mentions the key is no header, a key in a quoted cell is one, and the plan parses and sorts no other rows."""
    key = HEADERS[0]
    rows = [threat("7", "a", **{HEADERS[2]: f'"see {key}, there"'}), threat("8", key.replace(" ", "_") + "?")]
    path = sheet(tmp_path, "mentions.csv", [[f'"{key},x"'], ["banner"], [f'" {key} "', *HEADERS[1:]], *[list(r.values()) for r in rows]])
    assert {(r.threat_id, r.description) for r in SH.read_threat_sheet(spark, path).collect()} == {(7, f"see {key}, there"), (8, None)}
    found = SH._headers(spark, path, True, SH.normalise_header(key), 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert [r["x"]["h"][1] for r in found.collect()] == [SH.normalise_header(HEADERS[1])]
    scans = plan.split("FileScan csv")[1:]
    assert scans and all("_c1:" not in scan.split("ReadSchema")[1].split(">")[0] for scan in scans)


def test_a_written_sheet_is_cut_into_parts_that_keep_the_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(SH, "_PART_RECORDS", 3)
    path = str(tmp_path / "parts")
    source = spark.range(10).coalesce(1).selectExpr(
        "'T' AS enterprise_type", "'1' AS enterprise_code", "int(id) AS host_count", "1 AS threat_code", "1 AS success",
        "'R' AS region", "date'2024-08-12' AS incident_date", "timestamp_ntz'2024-08-12 11:00:00' AS incident_time")
    SH.write_incident_sheet(source, path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 4
    read = SH.read_incident_sheet(spark, path, sequence="seq")
    assert [r.host_count for r in read.orderBy("seq").collect()] == list(range(10))
