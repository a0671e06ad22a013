import pytest

from tidemark.operators.timebase import parse_clock
from tidemark.sources.recordings import SIGNALS, clean_recordings, read_recordings
from tidemark.sources.tables import load_table, read_behaviour, save_table


def write(folder, name, rows, header="t,a,b,c,d,e,f,g,h,i,note"):
    lines = [header, "s,V,V,V,V,V,V,V,V,V,", ",,,,,,,,,,"]
    lines += [f"{t}," + ",".join([str(v)] * 9) + f",{note}" for t, v, note in rows]
    (folder / name).write_text("\n".join(lines) + "\n")


@pytest.fixture
def folder(tmp_path):
    write(tmp_path, "one.csv", [("00:00:01", 1, ""), ("00:00:02", 2, "in slurry"), ("00:00:03", "x", "")])
    write(tmp_path, "two words.csv", [("00:00:05", 5, ""), ("00:00:06", 6, "")], header=",".join("klmnopqrstu"))
    write(tmp_path, "three_Double.csv", [("00:00:07", 7, "")])
    (tmp_path / "notes.txt").write_text("not a recording\n")
    return tmp_path


def test_files_columns_and_unit_rows(spark, folder):
    rows = read_recordings(spark, str(folder)).collect()
    assert sorted((r.source_file, r.time) for r in rows) == [
        ("one.csv", "00:00:01"), ("one.csv", "00:00:02"), ("one.csv", "00:00:03"),
        ("two words.csv", "00:00:05"), ("two words.csv", "00:00:06"),
    ]


def test_unit_rows_go_even_if_numeric(spark, tmp_path):
    lines = ["h" + ",h" * 10] + [f"00:00:0{i}," + ",".join(["1"] * 9) + "," for i in range(5)]
    (tmp_path / "n.csv").write_text("\n".join(lines) + "\n")
    assert sorted(r.time for r in read_recordings(spark, str(tmp_path)).collect()) == [
        "00:00:02", "00:00:03", "00:00:04"
    ]


def test_split_file_loses_its_first_rows_only(spark, tmp_path):
    rows = [(f"00:{i // 60:02d}:{i % 60:02d}", i, "") for i in range(3000)]
    write(tmp_path, "long.csv", rows)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = read_recordings(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() > 5
        assert df.count() == 3000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_clean_keeps_blank_comments_and_drops_missing_numbers(spark, folder):
    rows = parse_clock(clean_recordings(read_recordings(spark, str(folder))), "time").collect()
    kept = sorted((r.source_file, r.time_seconds, r.comments) for r in rows)
    assert kept == [
        ("one.csv", 1.0, ""), ("one.csv", 2.0, "in slurry"),
        ("two words.csv", 5.0, ""), ("two words.csv", 6.0, ""),
    ]
    assert all(rows[0][s] is not None for s in SIGNALS)


def test_behaviour_and_result_tables(spark, tmp_path):
    (tmp_path / "b.csv").write_text(
        "animal_id,day,loc,stun,start,stage,txt,secs,a,b,w,s,c,n\n"
        "1,d,germany,2_1,09:50,stage_3,20 mins 17.41s,9,,,17.05,m,27.9,\n"
        "1,d,germany,2_1,09:50,stage_4,,,,,,,,\n"
    )
    rows = read_behaviour(spark, str(tmp_path / "b.csv")).orderBy("recovery_stage").collect()
    assert [r.time_seconds_stage for r in rows] == [9.0, None]
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        save_table(df, path, fmt)
        assert sorted(map(tuple, load_table(spark, path, df.schema, fmt).collect())) == [(1, "x"), (2, None)]
