import io
import json
import random
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewash.plans.cleaning import clean
from tidewash.session import shared_folder
from tidewash.sources import csv_records, generator, listing, sessions as S, tables as T, workbook as W
from tidewash.sources.headers import trim_headers


def test_csv_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        'id, n ,f,gap,empty,flag,maybe,text,na\n1,1,1.5,1,,True,True,"a, ""b""",x\n2,2,2,NA,NaN,false,,N/A,null\n3,-3,1e2,3,n/a,TRUE,False, c ,y\n'
    )
    df = T.read_csv(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {
        "id": "bigint", " n ": "bigint", "f": "double", "gap": "double", "empty": "double", "flag": "boolean", "maybe": "string", "text": "string", "na": "string"}
    rows = df.orderBy("id").collect()
    assert tuple(rows[0]) == (1, 1, 1.5, 1.0, None, True, "True", 'a, "b"', "x")
    assert tuple(rows[1]) == (2, 2, 2.0, None, None, False, None, None, None)
    assert rows[2]["text"] == " c "
    assert trim_headers(df).columns[1] == "n"


def test_csv_line_breaks_and_surplus_cells(spark, tmp_path):
    (tmp_path / "m.csv").write_text('a,b\n1,"two\nlines"\n2\n3,c\n')
    rows = sorted(map(tuple, T.read_csv(spark, str(tmp_path / "m.csv")).collect()))
    assert rows == [(1, "two\nlines"), (2, None), (3, "c")]
    (tmp_path / "w.csv").write_text("a,b\n1,2\n3,4,5\n")
    with pytest.raises(ValueError, match="more cells"):
        T.read_csv(spark, str(tmp_path / "w.csv"))


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_csv_loses_no_cell(spark, tmp_path):
    for k, text in enumerate(["a,b\n1,2\n3,4,,lost\n", 'a,b\n1,"2\n"\n3,4,,lost\n', 'a,b\n1,2\n3,4,\n', 'a,b\n1,"x, ""y""",z\n']):
        (tmp_path / f"{k}.csv").write_text(text)
        with pytest.raises(ValueError, match="1 rows have more cells"):
            T.read_csv(spark, str(tmp_path / f"{k}.csv"))
    (tmp_path / "few.csv").write_text('a,b,c\n1\n2,"x,""y\n"\n\n  \n3,5" pipe,\n')
    assert sorted(map(tuple, T.read_csv(spark, str(tmp_path / "few.csv")).collect())) == [(1, None, None), (2, 'x,"y\n', None), (3, '5" pipe', None)]


@pytest.mark.parametrize("cell", ["x", '"x\ny"'])
def test_csv_headers_of_files_must_agree(spark, tmp_path, cell):
    for name, header in (("1.csv", "a,b"), ("2.csv", "b,a"), ("3.csv", "a,b")):
        (tmp_path / name).write_text(f"{header}\n1,{cell}\n")
    with pytest.raises(Exception, match="header"):
        T.read_csv(spark, [str(tmp_path / n) for n in ("1.csv", "2.csv")]).collect()
    assert T.read_csv(spark, [str(tmp_path / n) for n in ("1.csv", "3.csv")]).count() == 2
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="does not end"):
        T.read_csv(spark, str(tmp_path / "open.csv"))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks_is_read_by_many_tasks(spark, tmp_path, small_splits, end):
    rng = random.Random(end)
    rows = []
    for k in range(400):
        text = "".join(rng.choice(['"', ",", end, "a", " b", "é", '""', "\n"]) for _ in range(rng.choice([0, 1, 3, 12])))
        rows.append((k, text, f'{k}" pipe', end * 600 if k % 90 == 7 else "t"))  # some records go over several splits
    quote = lambda t: '"' + t.replace('"', '""') + '"'
    body = "".join(f"{k},{quote(a)},{b},{quote(c)}{end}" for k, a, b, c in rows)
    (tmp_path / "many.csv").write_bytes(("id,text,size,long" + end + body).encode())
    (tmp_path / "other.csv").write_bytes(f"id,text,size,long{end}1000,x,y,z".encode())
    files = [str(tmp_path / "many.csv"), str(tmp_path / "other.csv")]
    lines = csv_records.physical_lines(spark, files)
    assert lines.rdd.getNumPartitions() > 20
    states = csv_records.split_states(csv_records.split_maps(lines)).collect()
    assert sum(r["inside"] for r in states) > 5 and any(r["inside"] and r["opener"] < r["block"] - 300 for r in states)
    got = {r.id: tuple(r)[1:] for r in T.read_csv(spark, files).collect()}
    expected = pd.read_csv(tmp_path / "many.csv", na_filter=False, lineterminator=None)
    assert len(got) == 401 and got[1000] == ("x", "y", "z")
    tokens = {"", "NA", "n/a"}
    for k, a, b, c in rows:
        assert got[k] == (None if a in tokens else a, b, c)
    if end == "\n":
        assert [got[k][0] or "" for k in range(400)] == expected["text"].tolist()


def test_csv_lone_carriage_returns(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes(b'a,b\r1,"x\ry"\r2,z\r')
    assert sorted(map(tuple, T.read_csv(spark, str(tmp_path / "r.csv")).collect())) == [(1, "x\ny"), (2, "z")]  # one kind of line end


def test_csv_states_of_lines():
    cases = ['', 'a,b', '"a"', '"a', 'a,"b', '"a""', '"a"",b', '5" x,"y', '5" x,y"', '"a"b"c,d', '"a",,"', ',', '"', '""', '"""', 'x","y', '","', '"a,b",c"']
    for line in cases:
        for inside in (False, True):
            state = "in" if inside else "start"
            at = 0
            while at < len(line):  # the machine that a reader of one character at a time is
                ch = line[at]
                if state == "in":
                    if ch == '"':
                        if line[at + 1 : at + 2] == '"':
                            at += 1
                        else:
                            state = "cell"
                elif ch == ",":
                    state = "start"
                else:
                    state = "in" if ch == '"' and state == "start" else "cell"
                at += 1
            assert csv_records._after(line, inside) == (state == "in"), (line, inside)


def test_csv_sink_keeps_fractions(spark):
    df = spark.sql("SELECT 1 AS k, TIMESTAMP_NTZ '2021-01-01 10:00:00.123456' AS t UNION ALL SELECT 2, TIMESTAMP_NTZ '2021-01-01 10:00:00'")
    folder = shared_folder(spark, "fractions")
    T.write_cleaned(df, folder, "csv")
    assert {r.k: r.t for r in T.read_csv(spark, folder).collect()} == {1: "2021-01-01 10:00:00.123456", 2: "2021-01-01 10:00:00"}
    told = {r.k: json.loads(r.j)["t"] for r in df.select("k", S.json_record("t").alias("j")).collect()}
    assert told == {1: "2021-01-01T10:00:00.123456", 2: "2021-01-01T10:00:00"}


def test_csv_headers_like_pandas(spark, tmp_path):
    text = "a,a,,a,b.1,b,b\n1,2,3,4,5,6,7\n"
    (tmp_path / "h.csv").write_text(text)
    assert T.read_csv(spark, str(tmp_path / "h.csv")).columns == list(pd.read_csv(io.StringIO(text)).columns)


def test_csv_round_trip_of_cleaned(spark):
    df = generator.dirty_table(spark, 200)
    result = clean(df, {"Age": {"action": "keep"}, "Gender": {"action": "keep"}, "Registration_Date": {"action": "transform", "transformation": "date"},
                        "Null_Column_All_Empty": {"action": "drop"}})
    folder = shared_folder(spark, "csv")
    T.write_cleaned(result.data, folder, "csv")
    back = T.read_csv(spark, folder)
    assert back.count() == 200 and dict(back.dtypes)["Age"] == "double" and "Null_Column_All_Empty" not in back.columns
    key = ["User_ID_Hash", "Age", "Gender", "Monthly_Subscription_Fee", "Churned_Status"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, result.data.select(*key).collect()))


def test_admission(spark, tmp_path):
    for name, size in (("a.csv", 10), ("b.CSV", 1), ("c.txt", 5), ("csv", 5), ("d.xlsx", 16 * 1024 * 1024 + 1)):
        (tmp_path / name).write_bytes(b"x" * size)
    got = {r["name"]: r.accepted for r in listing.list_files(spark, str(tmp_path)).collect()}
    assert got == {"a.csv": True, "b.CSV": True, "c.txt": False, "csv": False, "d.xlsx": False}


def test_lookup_opens_the_folder_of_its_id(spark, tmp_path):
    ids = [f"s{k}" for k in range(500)] + ["", "ü/ä", None, "s1"]
    records = spark.createDataFrame([(i, f"goal of {i}") for i in ids], "session_id string, goal string")
    schema = spark.createDataFrame([], S.SESSION_SCHEMA)
    S.write_store(schema.unionByName(records, allowMissingColumns=True), str(tmp_path), buckets=32)
    assert S.read_store(spark, str(tmp_path)).count() == len(ids) and S.read_store(spark, str(tmp_path)).columns == schema.columns
    assert [r.goal for r in S.find_in_store(spark, str(tmp_path), "ü/ä").collect()] == ["goal of ü/ä"]
    assert S.find_in_store(spark, str(tmp_path), "s1").count() == 2 and S.find_in_store(spark, str(tmp_path), "gone").isEmpty()
    found = S.find_in_store(spark, str(tmp_path), "s77")
    own = found.select(F.input_file_name()).first()[0]
    folders = list((tmp_path / "buckets=32").iterdir())
    assert len(folders) > 20
    for folder in folders:  # no task can read the others any more
        if folder.name not in own:
            for file in folder.glob("part-*"):
                file.unlink()
    assert [r.goal for r in found.collect()] == ["goal of s77"]


def test_sessions(spark, tmp_path):
    def save(name, record):
        (tmp_path / name).write_text(record if isinstance(record, str) else json.dumps(record, indent=2))

    save("1.json", {"session_id": "1", "name": "a.csv", "goal": "g", "created_at": "2024-01-01T00:00:00",
                    "column_actions": {"Age": {"action": "keep", "reason": "r", "transformation": None}},
                    "chat_history": [{"role": "assistant", "content": "hi"}], "preview": [{"Age": 1}]})
    save("2.json", {"session_id": "2", "created_at": "2024-02-01T00:00:00"})
    save("3.json", {"session_id": "3"})
    save("broken.json", '{"session_id": ')
    save("other.txt", {"session_id": "9"})
    records = S.read_sessions(spark, str(tmp_path))
    assert [r.session_id for r in S.list_sessions(records).collect()] == ["2", "1", "3"]
    assert records.count() == S.list_sessions(records).count() == 3
    found = S.find_session(records, "1").first()
    assert found.column_actions["Age"].action == "keep" and found.chat_history[0].content == "hi"
    assert S.find_session(records, "8").count() == 0


def test_json_record(spark):
    row = spark.range(1).select(S.json_record(
        F.lit("a").alias("s"), F.lit(None).cast("int").alias("n"), F.lit("2021-01-01 10:00:00").cast("timestamp_ntz").alias("t"), F.array(F.lit(1.5)).alias("l")).alias("j")).first()
    assert json.loads(row.j) == {"s": "a", "n": None, "t": "2021-01-01T10:00:00", "l": [1.5]}


def test_generator(spark):
    df = generator.dirty_table(spark, 5000)
    assert df.count() == 5000
    again = generator.dirty_rows(spark.range(5000).repartition(13), "id")
    assert df.exceptAll(again).count() == 0
    row = df.agg(
        F.min("Age").alias("lo"), F.max("Age").alias("hi"), F.avg(F.col("Age").isNull().cast("int")).alias("gap"), F.avg("System_Noise_Signal").alias("mean"),
        F.stddev("System_Noise_Signal").alias("std"), F.avg(F.col("Gender").isNull().cast("int")).alias("none"), F.avg("Churned_Status").alias("churn"),
        F.min("User_ID_Hash").alias("first"), F.count_distinct("Customer_Profile_Name").alias("names")).first()
    assert (row.lo, row.hi, row.first) == (18, 69, "USR_001000")
    assert row.gap == pytest.approx(0.05, abs=0.015) and row.none == pytest.approx(1 / 3, abs=0.03)
    assert abs(row["mean"]) < 0.06 and row.std == pytest.approx(1, abs=0.05)
    assert row.churn == pytest.approx(0.1 + 0.4 * 0.4 + 0.2 * 19 / 52, abs=0.03) and row.names == 600


# -- workbooks ----------------------------------------------------------------

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def make_workbook(path, sheets):
    """A small .xlsx with shared and inline texts, numbers, booleans, dates and gaps."""
    shared = []

    def cell(ref, v):
        if v is None:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v}</v></c>'
        if isinstance(v, datetime):
            days = (v - datetime(1899, 12, 30)).total_seconds() / 86400
            return f'<c r="{ref}" s="1"><v>{days}</v></c>'
        if v.startswith("inline:"):
            return f'<c r="{ref}" t="inlineStr"><is><t>{v[7:]}</t></is></c>'
        shared.append(v)
        return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        names = "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
        book.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>{names}</sheets></workbook>")
        links = "".join(f'<Relationship Id="rId{i + 1}" Target="worksheets/sheet{i + 1}.xml"/>' for i in range(len(sheets)))
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {NS}><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        for i, rows in enumerate(sheets.values()):
            body = "".join(
                f'<row r="{r + 1}">' + "".join(cell(f"{chr(65 + c)}{r + 1}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows))
            book.writestr(f"xl/worksheets/sheet{i + 1}.xml", f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
        items = "".join(f"<si><t>{t}</t></si>" for t in shared)
        book.writestr("xl/sharedStrings.xml", f"<sst {NS}>{items}</sst>")
    path.write_bytes(buffer.getvalue())


def test_workbooks(spark, tmp_path):
    header = ["id", "name", "score", "ok", "day", "gap"]
    make_workbook(tmp_path / "a.xlsx", {"First": [header, [1, "x", 1.5, True, datetime(2021, 1, 1), None], [2, "inline:y", 2, False, datetime(2021, 1, 2, 12), 7]], "Second": [["k"], [5]]})
    make_workbook(tmp_path / "b.xlsx", {"Data": [header] + [[i, "z", i / 2, True, datetime(2021, 1, 3), i] for i in range(3, 12003)]})
    sheets = sorted((r.path[-6:], r.sheet_idx, r.sheet_name) for r in W.list_sheets(spark, str(tmp_path)).collect())
    assert sheets == [("a.xlsx", 0, "First"), ("a.xlsx", 1, "Second"), ("b.xlsx", 0, "Data")]
    df = W.read_workbook(spark, str(tmp_path))
    assert dict(df.dtypes) == {"id": "bigint", "name": "string", "score": "double", "ok": "boolean", "day": "string", "gap": "double"}
    rows = df.orderBy("id").collect()
    assert len(rows) == 12002
    assert tuple(rows[0]) == (1, "x", 1.5, True, "2021-01-01 00:00:00", None) and tuple(rows[1]) == (2, "y", 2.0, False, "2021-01-02 12:00:00", 7.0)
    assert W.read_workbook(spark, str(tmp_path / "a.xlsx"), "Second").collect()[0]["k"] == 5


def test_workbooks_are_not_thinned(spark, tmp_path, monkeypatch):
    make_workbook(tmp_path / "w.xlsx", {"S": [["k"], [1, 2, 3], [4]]})
    assert sorted(map(tuple, W.read_workbook(spark, str(tmp_path)).select("k", "`Unnamed: 1`", "`Unnamed: 2`").collect())) == [(1, 2.0, 3.0), (4, None, None)]
    monkeypatch.setattr(W, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="more than 100 bytes"):
        W.read_workbook(spark, str(tmp_path))
