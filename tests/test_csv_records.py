"""CSV records against pandas, over splits of any size."""

import io
import os
import random

import pandas as pd
import pytest

from shelfrank.sources import csv_records as R
from shelfrank.sources import files

SPLITS = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"


@pytest.fixture()
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in SPLITS}

    def to(n):
        spark.conf.set(SPLITS[0], str(n))
        spark.conf.set(SPLITS[1], "1")
    yield to
    for k, v in before.items():
        spark.conf.set(k, v)


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def by_pandas(text):
    df = pd.read_csv(io.BytesIO(text), sep=";", dtype=str, on_bad_lines="skip", keep_default_na=False, na_values=[""],
                     engine="c", encoding="utf-8")
    return [tuple(None if v != v else v for v in r) for r in df.itertuples(index=False, name=None)]


def by_spark(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is not None, v or "") for v in r))


def same(df, text):
    key = lambda r: tuple((v is not None, v or "") for v in r)
    assert by_spark(df) == sorted(by_pandas(text), key=key)


QUOTED = ('a;b;c\n1;"PAO ""FRANCES"" X";10\n2;"PAO ""FR;ANCES"" X";20\n3;"PAO\nFRANCES";30\n4;PIZZA 12" GRANDE;40\n'
          '5;"x"y";50\n\n6;"";60\n7;"a\r\nb";70\r\n8;short\n9;"too;long";1;2\n10;" spaces ";"1\n2\n\n3"\n11;é;"ü;\n""ö"""\n').encode()


@pytest.mark.parametrize("size", [7, 20, 33, 1 << 20])
def test_quoted_fields(spark, tmp_dir, small_splits, size):
    small_splits(size)
    put(tmp_dir, "f.csv", QUOTED)
    df = files.read_csv(spark, tmp_dir)
    same(df, QUOTED)
    got = {r.a: r.b for r in df.collect()}
    assert got["1"] == 'PAO "FRANCES" X' and got["2"] == 'PAO "FR;ANCES" X' and got["3"] == "PAO\nFRANCES" and got["4"] == 'PIZZA 12" GRANDE'
    assert got["7"] == "a\r\nb" and "9" not in got and got["6"] is None


def field(rng):
    plain = "".join(rng.choice(["x", "yy", " ", "é", "1,5", "'"]) for _ in range(rng.randrange(4)))
    inner = "".join(rng.choice(["x", '""', ";", "\n", "\r\n", "é", "\n\n"]) for _ in range(rng.randrange(6)))
    return rng.choice([plain, plain, plain + '"' if plain.strip() else plain, f'"{inner}"', f'"{inner}"', f'"{inner}"tail'])


def random_csv(seed):
    rng = random.Random(seed)
    lines = ["a;b;c"] if seed % 2 else ['"a";b;"c"']
    for i in range(rng.randrange(2, 40)):
        n = rng.choice([3, 3, 3, 3, 2, 1, 4, 5]) if i else 3  # pandas takes a longer first row for one with an index
        lines.append(";".join(field(rng) for _ in range(n)) + ("" if n > 1 else "z"))
        if rng.random() < 0.1:
            lines.append("")
    end = rng.choice(["\n", "\r\n"])
    text = end.join(lines) + rng.choice([end, ""])
    return text.encode()


def test_random_files_over_splits(spark, tmp_dir, small_splits):
    for size in (5, 31, 4096):
        small_splits(size)
        for seed in range(8):
            folder = os.path.join(tmp_dir, f"{size}-{seed}")
            text = random_csv(100 * size + seed)
            put(folder, "f.csv", text)
            same(files.read_csv(spark, folder), text)


def test_many_files_other_orders_and_encodings(spark, tmp_dir, small_splits):
    small_splits(40)
    put(tmp_dir, "1.csv", 'a;b\n1;"x\ny"\n')
    put(tmp_dir, "2.csv", 'b;a\n"p;\nq";2\n"r""\n";3\n')
    put(tmp_dir, "3.csv", b'a;b\n4;"caf\xe9\n"\n5;"caf\xc3\xa9"\n')
    put(tmp_dir, "4.csv", b"\xef\xbb\xbf" + b'"b";"a"\nlast;6\n')
    put(tmp_dir, "5.csv", b"")
    put(tmp_dir, "6.csv", b"\n\r\na;b\n7;\n")
    assert by_spark(files.read_csv(spark, tmp_dir).select("a", "b")) == [
        ("1", "x\ny"), ("2", "p;\nq"), ("3", 'r"\n'), ("4", "café\n"), ("5", "café"), ("6", "last"), ("7", None)]
    put(tmp_dir, "7.csv", "a;z\n1;2\n")
    with pytest.raises(files.MalformedFile, match="7.csv"):
        files.read_csv(spark, tmp_dir)


def test_strict_takes_valid_quoted_lines_and_refuses_bad_ones(spark, tmp_dir, small_splits):
    small_splits(25)
    good = os.path.join(tmp_dir, "good")
    put(good, "f.csv", 'a;b\n1;"x;y"\n2;"x ""y"" \n;z"\n3\n')
    assert by_spark(files.read_csv(spark, good, strict=True)) == [("1", "x;y"), ("2", 'x "y" \n;z'), ("3", None)]
    for i, bad in enumerate(['a;b\n1;2;3\n', 'a;b\n1;"x\n;y";3\n', 'a;b\n1;2;\n', 'a;b\n1;"open\n2;3\n']):
        put(os.path.join(tmp_dir, f"bad{i}"), "f.csv", bad)
        with pytest.raises(files.MalformedFile):
            files.read_csv(spark, os.path.join(tmp_dir, f"bad{i}"), strict=True)


def test_a_quote_that_is_never_closed(spark, tmp_dir, small_splits):
    """The record is dropped; one beyond the limit fails the read."""
    for size in (10, 1000):
        small_splits(size)
        folder = os.path.join(tmp_dir, str(size))
        put(folder, "f.csv", 'a;b\n1;x\n2;"open\n3;y\n4;z\n')
        put(folder, "g.csv", "a;b\n5;y\n")
        assert by_spark(files.read_csv(spark, folder)) == [("1", "x"), ("5", "y")]


def test_a_lone_carriage_return_ends_a_record(spark, tmp_dir):
    text = b'a;b\r1;x\r2;"y\rz"\r3;w'
    put(tmp_dir, "f.csv", text)
    same(files.read_csv(spark, tmp_dir), text)


def test_quote_states_equal_a_state_machine():
    rng = random.Random(2)
    quotes = R.Quotes(";")

    def after(line, inside):
        state = "in" if inside else "start"
        for c in line:
            if state == "start":
                state = "in" if c == '"' else "start" if c in ";\r" else "field"
            elif state == "field":
                state = "start" if c in ";\r" else "field"
            elif state == "in":
                state = "quote" if c == '"' else "in"
            else:
                state = "in" if c == '"' else "start" if c in ";\r" else "field"
        return state == "in"
    for _ in range(20_000):
        line = "".join(rng.choice('"";;x\r') for _ in range(rng.randrange(10)))
        for inside in (False, True):
            assert quotes.after(line.encode(), inside) == after(line, inside), (line, inside)


def test_other_splits_than_surveyed_fail_the_read(spark, tmp_dir, small_splits):
    put(tmp_dir, "f.csv", "a;b\n" + '1;"x\ny"\n' * 30)
    small_splits(1 << 20)
    df = files.read_csv(spark, tmp_dir)
    small_splits(20)
    with pytest.raises(Exception, match="read them again"):
        df.collect()


def test_only_header_and_refused_charsets(spark, tmp_dir):
    put(tmp_dir, "f.csv", "a;b\n")
    df = files.read_csv(spark, tmp_dir)
    assert df.columns == ["a", "b"] and df.collect() == []
    with pytest.raises(ValueError):
        files.read_csv(spark, tmp_dir, encoding="utf-16")
    put(tmp_dir, "f.csv", '"a\nx";b\n1;2\n')
    with pytest.raises(files.MalformedFile):
        files.read_csv(spark, tmp_dir)


def test_one_job_without_a_shuffle_finds_headers_and_quotes(spark, tmp_dir, small_splits):
    small_splits(30)
    for i in range(20):
        put(tmp_dir, f"{i}.csv", f'a;b\n{i};"x\ny"\n')
    sc = spark.sparkContext
    sc.setJobGroup("read-many", "read_csv")
    try:
        df = files.read_csv(spark, tmp_dir)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("read-many")) == 1
    assert df.count() == 20
