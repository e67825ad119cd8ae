import csv
import hashlib
import json
import os

import pytest

from scribelake.functions.roles import MissingColumnError
from scribelake.operators.guards import EmptyInputError
from scribelake.operators.ids import IncompleteError
from scribelake.plans.manifests import write_manifests
from scribelake.sources import fingerprint as fp
from scribelake.sources import ledger, splits, tables

HEADER = "id,transcription,language,original_split\n"


def read(spark, folder, body, **options):
    path = folder / "t.csv"
    path.write_text(HEADER + body, encoding="utf-8")
    return tables.read_table(spark, str(path), **options)


@pytest.mark.parametrize("dialect", ["mixed", "backslash"])
def test_backslash_quotes(spark, tmp_path, dialect):
    row = read(spark, tmp_path, 'x1,"say \\"hello\\"",lug,train\n', dialect=dialect).first()
    assert row.transcription == 'say "hello"'


@pytest.mark.parametrize("dialect", ["mixed", "doubled"])
def test_doubled_quotes_and_line_breaks(spark, tmp_path, dialect):
    rows = read(
        spark, tmp_path, 'x1,"say ""hello"", now\nagain",lug,train\nx2,b,lug,train\n', dialect=dialect
    ).collect()
    assert [r.transcription for r in rows] == ['say "hello", now\nagain', "b"]


def test_mixed_styles_and_blank_cells(spark, tmp_path):
    body = 'x1,"a \\"b\\" ""c"" \\\\",lug,train\nx2,,NA,train\n'
    rows = read(spark, tmp_path, body, dialect="mixed").orderBy("id").collect()
    assert rows[0].transcription == 'a "b" "c" \\'
    assert rows[1].transcription is None and rows[1].language == "NA" and len(rows) == 2


@pytest.mark.parametrize("dialect", ["mixed", "backslash", "doubled"])
def test_short_rows_fail(spark, tmp_path, dialect):
    with pytest.raises(Exception, match="fields|[Mm]alformed"):
        read(spark, tmp_path, "x1,a,b,c\nx3,only\n", dialect=dialect).collect()


@pytest.mark.parametrize("dialect", ["mixed", "backslash", "doubled"])
def test_numbered_rows_are_in_file_order(spark, tmp_path, dialect):
    body = "".join(f"{i * 7 % 100:03},\"a\nb\",l,t\n" for i in range(100))
    rows = read(spark, tmp_path, body, dialect=dialect, numbered=True).repartition(7)
    ordered = [r.id for r in rows.orderBy(*tables.POSITION).collect()]
    assert ordered == [f"{i * 7 % 100:03}" for i in range(100)]


def test_single_line_files_are_split(spark, tmp_path):
    body = "".join(f"x{i},a,b,c\n" for i in range(2000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = read(spark, tmp_path, body, multi_line=False)
        assert rows.rdd.getNumPartitions() > 1 and rows.count() == 2000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError, match="numbered"):
        read(spark, tmp_path, body, multi_line=False, numbered=True)


def test_defaults_agree_on_awkward_texts(spark, tmp_path):
    data = [
        ("1", "C:\\new\\table"), ("2", "ends with \\"), ("3", '"'), ("4", '""'), ("5", "\\"), ("6", '\\"'),
        ("7", "\\\\\\\""), ("8", " lead and trail \t"), ("9", "a\nb\r\nc"), ("10", None),
    ]
    df = spark.createDataFrame(data, "id string, t string")
    tables.write_table(df, str(tmp_path / "o"))
    assert sorted((r.id, r.t) for r in tables.read_table(spark, str(tmp_path / "o")).collect()) == sorted(data)


def test_long_fields_and_many_rows(spark, tmp_path):
    body = "".join(f"x{i},{'w ' * (100_000 if i == 5 else 1)},l,train\n" for i in range(25_000))
    df = read(spark, tmp_path, body)
    assert df.count() == 25_000
    assert len(df.where("id = 'x5'").first().transcription) == 200_000


def test_rows_that_do_not_fit(spark, tmp_path):
    body = "x1,a,b,c,d,e\nx2,a,b,c\n"
    with pytest.raises(Exception, match="6 fields"):
        read(spark, tmp_path, body, dialect="mixed").collect()
    assert tables.malformed_rows(read(spark, tmp_path, body, strict=False)) == 1
    with pytest.raises(Exception, match="lacks columns"):
        read(spark, tmp_path, body, dialect="mixed", columns=["nope"]).collect()
    with pytest.raises(ValueError, match="dialect"):
        read(spark, tmp_path, body, dialect="other")


@pytest.mark.parametrize("dialect", ["backslash", "doubled"])
def test_what_is_written_is_read_back(spark, tmp_path, dialect):
    data = [("1", 'q " c , n \n b \\ end'), ("2", "plain")]
    df = spark.createDataFrame(data, "id string, t string")
    tables.write_table(df, str(tmp_path / "o"), dialect=dialect)
    native = tables.read_table(spark, str(tmp_path / "o"), dialect=dialect)
    assert sorted((r.id, r.t) for r in native.collect()) == data


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store") / "s")
    rows = [
        (1, ("a.wav", bytearray(b"x")), "old one", "x", "train"),
        (2, ("b.wav", None), "old two", "x", "train"),
        (3, ("c.wav", None), "old three", "y", "train"),
        (4, ("d.wav", None), None, "y", "test"),
    ]
    schema = "ID int, audio struct<path:string,bytes:binary>, sentence string, language string, split string"
    spark.createDataFrame(rows, schema).write.partitionBy("language", "split").parquet(path)
    return splits.read_recordings(spark, path)


def test_split_scan_prunes_folders_and_columns(store):
    df = splits.load_split(store, "train", ["x"], keep_text=False)
    assert df.columns == ["id", "language", "audio"]
    assert sorted(r.id for r in df.collect()) == ["1", "2"]
    plan = df.select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ID:int>" in plan
    assert "split#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]


LABELS = "id string, transcription string, language string, original_split string"


def test_labelled_split(spark, store):
    labels = spark.createDataFrame(
        [("1", "new one", "x", "train"), ("3", "new three", "y", "train"), ("9", "t", "y", "validation")],
        LABELS,
    )
    rows = splits.load_labelled_split(store, labels, "train", ["x", "y"]).orderBy("id").collect()
    assert [(r.id, r.language, r.text) for r in rows] == [("1", "x", "new one"), ("3", "y", "new three")]
    with pytest.raises(EmptyInputError):
        splits.load_labelled_split(store, labels, "train", ["zz"])
    with pytest.raises(IncompleteError, match="1 ids without a recording"):
        splits.load_labelled_split(store, labels, "validation", ["y"])
    with pytest.raises(MissingColumnError, match="original_split"):
        splits.load_labelled_split(store, labels.drop("original_split"), "train")
    # an id counts only within its own language
    moved = spark.createDataFrame([("1", "t", "y", "train")], LABELS)
    with pytest.raises(IncompleteError):
        splits.load_labelled_split(store, moved, "train", ["x", "y"])


def test_manifests(store, tmp_path):
    write_manifests(store, str(tmp_path / "m"), ["train", "test"], ["x", "y"], read_bytes=True)
    files = list((tmp_path / "m").glob("language_=*/split_=*/*.json"))
    records = {
        r["id"]: r for f in files for r in map(json.loads, f.read_text(encoding="utf-8").splitlines())
    }
    assert records["1"] == {
        "id": "1",
        "language": "x",
        "split": "train",
        "audio": {"path": "a.wav", "bytes_present": True},
        "text": "old one",
    }
    assert "text" not in records["4"] and records["4"]["audio"]["bytes_present"] is False


def test_ledger_appends_fixed_columns(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for name in ("r1", "r2"):
        record = spark.createDataFrame([(name, 0.25, "x")], "experiment_id string, local_wer double, other string")
        ledger.append_ledger(record, path)
    rows = tables.read_table(spark, path, columns=ledger.LEDGER_COLUMNS).orderBy("experiment_id").collect()
    assert [(r.experiment_id, r.local_wer, r.notes) for r in rows] == [("r1", "0.25", None), ("r2", "0.25", None)]
    for file in (tmp_path / "ledger").glob("*.csv"):
        with file.open() as handle:
            assert tuple(next(csv.reader(handle))) == ledger.LEDGER_COLUMNS
    assert len(ledger.LEDGER_COLUMNS) == 16


@pytest.mark.parametrize("size", [3, 3_000_000])
def test_fingerprint(spark, tmp_path, size):
    data = b"x" * size
    (tmp_path / "a.bin").write_bytes(data)
    asked = [str(tmp_path / "a.bin"), str(tmp_path / "gone.bin"), "/no/such/folder/f", str(tmp_path)]
    rows = {r.path: r for r in fp.fingerprint(spark, asked).collect()}
    assert list(rows[asked[0]])[1:] == [True, len(data), hashlib.sha256(data).hexdigest()[:16]]
    assert list(rows[asked[1]])[1:] == [False, None, None]
    assert not rows[asked[2]].exists and not rows[asked[3]].exists and len(rows) == 4
    assert not fp.fingerprint(spark, asked[2:3]).first().exists


def test_fingerprint_of_relative_paths_and_odd_names(spark, tmp_path):
    names = ["a b.csv", "c[1].csv", "e,f.csv", "g{h}.csv", "i*.csv", "j?.csv", "é.csv"]
    for name in names:
        (tmp_path / name).write_text(name)
    asked = [f"file:{tmp_path}/{n}" for n in names[:3]] + [str(tmp_path / n) for n in names[3:]]
    found = {r.path: r.sha256 for r in fp.fingerprint(spark, asked).collect()}
    assert [found[p] for p in asked] == [hashlib.sha256(n.encode()).hexdigest()[:16] for n in names]
    working = os.getcwd()
    inside = os.path.relpath(tmp_path / "a b.csv", working)
    assert fp.fingerprint(spark, [inside]).first().exists


def labels_of(spark, *rows):
    return spark.createDataFrame(
        list(rows), "id string, transcription string, language string, original_split string"
    )


def test_labels_need_known_and_single_ids(spark, store):
    good = labels_of(spark, ("1", "n", "x", "train"))
    assert splits.load_labelled_split(store, good, "train", ["x"]).first().text == "n"
    bad = {
        "unknown": (None, "n", "x", "train"),
        "repeatedly": ("1", "again", "x", "train"),
        "without": ("3", "other language", "x", "train"),
    }
    for problem, row in bad.items():
        with pytest.raises(IncompleteError, match=problem):
            splits.load_labelled_split(store, good.unionByName(labels_of(spark, row)), "train", ["x"])
    twice = store.unionByName(store.where("id = 1"))
    with pytest.raises(IncompleteError, match="several"):
        splits.load_labelled_split(twice, good, "train", ["x"])


def test_mixed_lines_as_the_streaming_reader_reads_them(spark, tmp_path):
    lines = [
        "ID,text,more",
        'a,"say \\"x\\"",1',
        'b,"say ""x""",2',
        'c,plain \\, text,',
        'd,"a, ""b\\", c",",,"',
        ",,",
        'e,"","\\\\"',
        "ID,text,more",
        'f,' + "long, word ".replace(",", "") * 20_000 + ',"' + 'x""' * 20_000 + '"',
    ]
    folder = tmp_path / "t"
    folder.mkdir()
    for k in range(2):
        (folder / f"part-{k}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    by_line = tables.read_table(spark, str(folder), dialect="mixed", multi_line=False)
    streamed = tables.read_table(spark, str(folder), dialect="mixed")
    assert by_line.columns == streamed.columns == ["ID", "text", "more"]
    assert sorted(map(str, by_line.collect())) == sorted(map(str, streamed.collect()))
    assert by_line.count() == 16
    (folder / "part-2.csv").write_text("ID,text,more\nx,y\n")
    with pytest.raises(Exception, match="other than 3 fields"):
        tables.read_table(spark, str(folder), dialect="mixed", multi_line=False).collect()
