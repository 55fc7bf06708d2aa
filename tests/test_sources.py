"""CSV files read by many tasks against csv.reader."""

import csv
import io
import random

import pytest

from landquill.sources import files
from landquill.sources.split_csv import ends_inside, split_csv_rows


def plain(content, encodings=files.ENCODINGS):
    return list(csv.reader(io.StringIO(files.decode(content, encodings), newline="")))


@pytest.fixture
def small_ranges(spark):
    keys = {"spark.sql.files.maxPartitionBytes": None, "spark.sql.files.openCostInBytes": "0"}
    yield lambda n: [spark.conf.set(k, str(n) if v is None else v) for k, v in keys.items()]
    for k in keys:
        spark.conf.unset(k)


CELLS = ["", "a", "地番", "髙橋", '"x"', '"a,b"', '"line\nbreak"', '"two\n\nbreaks ""quoted"""', 'in"side', '"closed"rest', "ソ表能", '"\r\n"', '"long\n' + "x" * 40 + '\nend"']


def test_ranges_at_every_place(spark, tmp_path, small_ranges):
    rng = random.Random(7)
    contents = {}
    for k, encoding in enumerate(("cp932", "utf-8-sig", "cp932")):
        rows = [",".join(rng.choice(CELLS) for _ in range(rng.randint(1, 4))) for _ in range(5)]
        text = rng.choice(["\n", "\r\n"]).join(rows) + ("\n" if k % 2 else "")
        text = text.replace("髙", "高") if encoding == "cp932" and k else text
        if encoding != "cp932":
            text += "\n♥,é"
        contents[f"{k}.csv"] = text.encode(encoding)
    contents["empty.csv"] = b""
    contents["feed.csv"] = b"\n"
    contents["open.csv"] = b'a,"never\nclosed\n'
    contents["a.csv:Zone.Identifier"] = b"no"
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    want = {(n, i): row for n, c in contents.items() if n.endswith(".csv") for i, row in enumerate(plain(c))}
    for size in (11, 23, 1000):
        small_ranges(size)
        got: dict[str, list] = {}
        for r in split_csv_rows(spark, str(tmp_path)).collect():
            got.setdefault(r.file, []).append((r.line_idx, r.fields))
        assert {n: min(v)[0] for n, v in got.items()} == dict.fromkeys(got, 0)
        assert {(n, i): row for n, v in got.items() for i, (_, row) in enumerate(sorted(v))} == want, size


def test_a_file_that_no_encoding_reads(spark, tmp_path):
    (tmp_path / "bad.csv").write_bytes(b"a,\x81\n")
    with pytest.raises(ValueError):
        split_csv_rows(spark, str(tmp_path))
    got = split_csv_rows(spark, str(tmp_path), strict=False).collect()
    assert [r.fields for r in got] == plain(b"a,\x81\n".decode("cp932", "replace").encode("utf-8"), ("utf-8",))


def test_quotes_open_only_at_the_start_of_a_cell():
    rng = random.Random(3)
    for _ in range(2000):
        line = "".join(rng.choice('a,"\r') for _ in range(rng.randint(0, 9)))
        pieces = list(io.StringIO(line + "\n", newline=""))
        rows = list(csv.reader(iter([*pieces, "#\n"])))
        assert ends_inside(line.encode(), False) == (rows[-1] != ["#"])
