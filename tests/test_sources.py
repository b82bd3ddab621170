import csv
import io

import pytest
from pyspark.sql import functions as F

from tabloom import staging
from tabloom import Workbench
from tabloom.sinks import files
from tabloom.sources import detect, tables, text


def write(folder, name, content, encoding="utf-8"):
    path = folder / name
    path.write_text(content, encoding=encoding)
    return str(path)


LINES = [
    "a,b,c",
    "a, b ,",
    ",,x",
    '"a,1",b',
    '"say ""hi""",2,3',
    'x,"",y',
    '"q" tail,2',
    'plain "inner" quote,1',
    "",
    "one",
    ",",
    "a,,,,b",
]


def test_split_cells_like_csv_module(spark):
    df = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, value string")
    got = {r["i"]: r["cells"] for r in df.select("i", text.split_cells(F.col("value")).alias("cells")).collect()}
    for i, line in enumerate(LINES):
        want = next(csv.reader(io.StringIO(line)), [""])
        assert got[i] == want, line


def test_detection():
    rows = detect.split_lines(["id,name,n", "1,x,5", "2,y,6"])
    assert detect.has_header(rows) and not detect.is_key_value(rows, True)
    assert not detect.has_header([["1", "2"]])
    assert not detect.has_header([["1", "2"], ["3", "x"]])
    assert detect.is_key_value([["1", "a:2", "b", "t"], ["2", "a:1", "c:2", "t"]])
    # Exactly half is not enough.
    assert not detect.is_key_value([["1", "a:2", "b", "t"]])
    assert not detect.is_key_value([["1", "t"]])
    assert [detect.delimiter(x) for x in ("a;b\tc", "a\tb,c", "a,b", "a")] == [";", "\t", ",", ","]


def test_flat_rows(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id, name ,x\n1, ann ,\n\n , ,\n2\n3,bob,4,extra\n")
    table = tables.read_table(spark, path, header=True, typed=False)
    assert table.columns == ["id", "name", "x"]
    got = [tuple(r) for r in table.df.orderBy("_row").collect()]
    assert got == [("1", "ann", None, 1), ("2", None, None, 2), ("3", "bob", "4", 3)]


def test_flat_without_header(spark, tmp_path):
    path = write(tmp_path, "t.csv", "1,2\n3,4,5\n")
    assert tables.read_table(spark, path, header=False, typed=False).columns == ["col_0", "col_1", "col_2"]
    assert tables.read_table(spark, path, header=False, typed=False, col_names=["a"]).columns == ["a"]


def test_key_value_rows(spark, tmp_path):
    path = write(
        tmp_path, "t.csv", "1,a:x, b : y:z ,loose,2024-01-01\nsolo\n2,a:1,a:2,id:9,2024-01-02\n3,c:,2024-01-03\n"
    )
    table = tables.read_table(spark, path, header=False)
    assert table.format == "kv"
    assert table.columns == ["id", "timestamp", "a", "b", "c"]
    got = [tuple(r) for r in table.df.orderBy("_row").collect()]
    assert got == [
        ("1", "2024-01-01", "x", "y:z", None, 1),
        (None, None, None, None, None, 2),
        ("9", "2024-01-02", "2", None, None, 3),
        ("3", "2024-01-03", None, None, None, 4),
    ]


def test_typed_csv(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id,status,amount,region,when\n1,active,5000,North,2024-01-15\n2,,30.5,South,2024-01-16\n")
    table = tables.read_table(spark, path)
    assert dict(table.df.dtypes) == {
        "id": "bigint", "status": "string", "amount": "double", "region": "string", "when": "date", "_row": "bigint"
    }
    assert table.info()["rows"] == 2 and table.header


def test_bom_and_semicolons(spark, tmp_path):
    path = write(tmp_path, "t.csv", "id;name\n1;x\n2;y\n", "utf-8-sig")
    table = tables.read_table(spark, path, sep="auto", typed=False)
    assert table.columns == ["id", "name"] and table.df.count() == 2


def test_row_numbers_over_files_and_splits(spark, tmp_path):
    for f in range(3):
        lines = "".join(f"{f * 1000 + i},{'x' * 20}\n" for i in range(1000))
        write(tmp_path, f"part-{f}.csv", "n,pad\n" + lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = tables.read_table(spark, str(tmp_path), header=True, typed=False).df
        assert df.rdd.getNumPartitions() > 6
        assert df.where("cast(n AS bigint) + 1 <> _row").count() == 0 and df.count() == 3000
        typed = tables.read_table(spark, str(tmp_path), header=True).df
        assert typed.where("n + 1 <> _row").count() == 0 and typed.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_names(tmp_path):
    assert tables.table_name("/a/sales-2024 q1.csv") == "sales_2024_q1"
    assert tables.split_spec("x.csv:sales") == ("x.csv", "sales")
    assert tables.split_spec("s3://bucket/x.csv") == ("s3://bucket/x.csv", None)
    odd = tmp_path / "a:b"
    odd.write_text("x")
    assert tables.split_spec(str(odd)) == (str(odd), None)


def test_duplicate_table_names(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="two inputs"):
        Workbench(spark).load(path, path)


def test_empty_file(spark, tmp_path):
    with pytest.raises(ValueError, match="no data"):
        tables.read_table(spark, write(tmp_path, "t.csv", "\n \n"))


@pytest.mark.parametrize("format", ["csv", "JSON", "Parquet"])
def test_sinks(spark, tmp_path, format):
    df = spark.createDataFrame([(1, "a,b", None), (2, 'say "hi"', 1.5)], "i int, s string, x double")
    path = str(tmp_path / "out")
    files.export(df, path, format)
    reader = spark.read.schema(df.schema).options(header=True, escape='"')
    back = getattr(reader, format.lower())(path)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported"):
        files.export(spark.range(1), str(tmp_path / "x"), "xlsx")


def test_changed_splits_are_an_error(spark, tmp_path):
    path = write(tmp_path, "t.csv", "n,pad\n" + "".join(f"{i},{'x' * 50}\n" for i in range(2000)))
    df = tables.read_table(spark, path, header=True, typed=False).df
    assert df.agg(F.max("_row")).first()[0] == 2000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        with pytest.raises(Exception, match="splits changed"):
            df.select("_row", "n").where("n >= '0'").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize(
    "lines, sep",
    [
        (["a;b;c", "1;2,5;3"], ";"),
        (["a\tb", "1,5\t2"], "\t"),
        (["a|b", "1|2"], "|"),
        (['"x;y",b', '"1;2",3'], ","),
        (["one", "two"], ","),
        ([], ","),
    ],
)
def test_separator_is_guessed(lines, sep):
    assert detect.sniff(lines) == sep


def test_options_that_cannot_be_honoured(spark, tmp_path):
    path = write(tmp_path, "t.csv", "a,b\n1,2\n")
    with pytest.raises(ValueError, match="schema"):
        tables.read_table(spark, path, typed=False, schema="a int, b int")
    with pytest.raises(ValueError, match="format"):
        tables.read_table(spark, path, format="avro")
    assert tables.read_table(spark, path, format="text", header=True).columns == ["a", "b"]


def test_staged_folders_can_be_released(spark):
    kept = staging.stage(spark.range(5), "released")
    assert kept.count() == 5 and staging.release(spark) >= 1 and staging.release(spark) == 0
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_a_load_changes_no_setting(spark, tmp_path):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.files.minPartitionNum", None)
    tables.read_table(spark, write(tmp_path, "t.csv", "a,b\n1,2\n")).df.count()
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.files.minPartitionNum", None))


def in_splits(spark, size):
    """Reads cut files into splits of so many bytes."""
    from contextlib import contextmanager

    @contextmanager
    def cut():
        kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            yield
        finally:
            for k, v in kept.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return cut()


@pytest.mark.parametrize("size, header", [(150, True), (400, False), (10_000_000, True)])
def test_quoted_breaks_across_splits(spark, tmp_path, size, header):
    import csv
    import random

    rng = random.Random(size)
    cells = ["plain", 'with "quotes"', "two\nlines", "\n\nstart", "a\r\nb", "x,\ny", "", "long " * 30 + "\n" + "end " * 20, '"', "é\n\u4e2d"]
    folder = tmp_path / "many"
    folder.mkdir()
    want = []
    for f in range(3):
        with open(folder / f"part-{f}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\n" if f else "\r\n")
            if header:
                writer.writerow(["n", "a\nb" if not f else "note", "c"])
            for i in range(20):
                row = [str(f * 100 + i), rng.choice(cells), rng.choice(cells)]
                writer.writerow(row)
                want.append(tuple(c.strip() or None for c in row))
            if f == 1:
                out.write("\n\n , ,\n")
    with in_splits(spark, size):
        rows = text.load_flat(spark, str(folder), text.Layout(header=header, kv=False, col_names=("n", "x", "y"), sep=","), multi_line=True)
        got = sorted((tuple(r) for r in rows.collect()), key=lambda r: r[3])
    assert [r[:3] for r in got] == want and [r[3] for r in got] == list(range(1, len(want) + 1))


def test_quoted_breaks_in_key_value_rows(spark, tmp_path):
    path = write(tmp_path, "kv.csv", '1,"note:first\nline",k:2,t1\n2,k:3,"note:a\n\nb",t2\n')
    with in_splits(spark, 9):
        rows = text.load_key_value(spark, path, text.Layout(header=False), multi_line=True).orderBy("_row")
        assert [(r["id"], r["note"], r["k"], r["timestamp"]) for r in rows.collect()] == [("1", "first\nline", "2", "t1"), ("2", "a\n\nb", "3", "t2")]


def test_a_quote_that_never_closes_takes_the_rest(spark, tmp_path):
    path = write(tmp_path, "open.csv", 'a,b\n1,x\n2,"y\n3,z\n4,w\n')
    with in_splits(spark, 6):
        rows = text.load_flat(spark, path, text.Layout(header=True, kv=False, sep=","), multi_line=True).orderBy("_row").collect()
    assert [(r["a"], r["b"]) for r in rows] == [("1", "x"), ("2", "y\n3,z\n4,w")]


def test_many_entries_cost_in_proportion(spark, tmp_path):
    import time

    def seconds(keys, rows):
        lines = "".join(f"{r}," + ",".join(f"k{i % (keys - 5)}:{r}_{i}" for i in range(keys)) + ",t\n" for r in range(rows))
        path = write(tmp_path, f"wide{keys}.csv", lines)
        best = 1e9
        for _ in range(3):
            loaded = text.load_key_value(spark, path, text.Layout(header=False))
            start = time.perf_counter()
            loaded.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        first = loaded.where("_row = 2").first()
        assert first["k0"] == f"1_{keys - 5}" and first["k7"] == "1_7" and len(loaded.columns) == keys - 5 + 3
        return best

    # The same number of entries, in rows of 100 and of 1,000.
    assert seconds(1000, 400) < 2 * seconds(100, 4000) + 1


def test_cells_that_do_not_fit_are_kept(spark, tmp_path):
    path = write(tmp_path, "bad.csv", 'n,d,s\n1,2024-01-02,a\nx,2024-01-03,b\n3,soon,"c,d",more, ,e\n4\n5,,\n,,z\n')
    rows = text.load_rescued(spark, path, "n int, d date, s string", text.Layout(header=True, sep=","))
    got = [(r["n"], str(r["d"]) if r["d"] else None, r["s"], r["_rescued"], r["_row"]) for r in rows.orderBy("_row").collect()]
    assert got == [
        (1, "2024-01-02", "a", None, 1),
        (None, "2024-01-03", "b", {"n": "x"}, 2),
        (3, None, "c,d", {"d": "soon", "_surplus": '["more",null,"e"]'}, 3),
        (4, None, None, {"_missing": "2"}, 4),
        (5, None, None, None, 5),
        (None, None, "z", None, 6),
    ]
    counts = text.malformed_counts(rows).first()
    assert tuple(counts)[1:] == (6, 3, 2, 1, 1) and counts["_file"].endswith("bad.csv")
    layout = text.Layout(header=True, sep=",")
    assert dict(text.load_or_text(spark, path, "n int, d date, s string", layout).dtypes)["n"] == "string"
    assert dict(text.load_or_text(spark, path, "n int, d date, s string", layout, malformed=3).dtypes)["n"] == "int"


def test_plain_key_value_lines_are_read_like_any_others(spark, tmp_path):
    rows = ["1,a:1,b:2,a:,end", "2,x,a:3,,b:,a:4,end", "3", "4,5", "id:9,id:7,k::v,:w,end", "6,_corrupt_record:5,A:1,end"]
    rows += [f"{i}," + ",".join(f"w{j}:{i + j}" for j in range(i % 7, 30)) + ",end" for i in range(10, 30)]
    found = []
    # Blanks around the cells, which are trimmed, make a line one that is not plain.
    for name, lines in (("plain", rows), ("blanks", [r.replace(",", " , ") for r in rows])):
        path = write(tmp_path, f"{name}.txt", "\n".join(lines) + "\n")
        numbered = text.numbered_lines(spark, path, False)
        taken = text.kv_rows(numbered).agg(F.count("__plain"), F.count("entries")).first()
        assert taken[0] == (len(rows) if name == "plain" else 1)
        loaded = text.load_key_value(spark, path, text.Layout(header=False, sep=","))
        found.append((loaded.columns, loaded.orderBy("_row").collect()))
    assert found[0] == found[1]
    columns, loaded = found[0]
    assert columns[:8] == ["id", "timestamp", "a", "b", "k", "", "_corrupt_record", "A"]
    assert [tuple(r[:4]) for r in loaded[:5]] == [("1", "end", None, "2"), ("2", "end", "4", None), (None,) * 4, ("4", "5", None, None), ("7", "end", None, None)]
    assert (loaded[4]["k"], loaded[4][""], loaded[5]["_corrupt_record"]) == (":v", "w", "5")
