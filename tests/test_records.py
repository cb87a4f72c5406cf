"""Records with quoted line breaks, cut by many tasks, against the reader of whole files."""

import random

import pytest
from helpers import rows

from vigia.sources import delimited, records

PIECES = ["a", "\n", ";", '""', "é", " ", "\r\n"]
PLAIN = ['x"y', '5" screen', '"ab"c', '"ab"c"d', 'a""', '""', '"" x', ""]


@pytest.fixture(scope="module")
def small(spark):
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", 400)
    session.conf.set("spark.sql.files.openCostInBytes", 10)
    return session


def field(rng):
    kind = rng.random()
    if kind < 0.3:
        return '"' + "".join(rng.choice(PIECES) for _ in range(rng.choice([0, 1, 3, 10, 80]))) + '"'
    return rng.choice(PLAIN) if kind < 0.4 else "".join(rng.choice("abcç ") for _ in range(rng.randint(0, 6)))


def both_readers(session, folder, header="a;b;c", **options):
    """Rows of the splitting reader and of Spark's."""
    out = []
    for size in (None, 1 << 40):
        before = delimited.split_size
        if size:
            delimited.split_size = lambda _: size
        try:
            out.append(sorted(map(str, rows(delimited.read_delimited(session, folder, multi_line=True, malformed="mark", **options)))))
        finally:
            delimited.split_size = before
    return out


@pytest.mark.parametrize("seed", range(4))
def test_records_equal_those_of_whole_files(small, tmp_path, seed):
    rng = random.Random(seed)
    for f in range(3):
        lines = [";".join(field(rng) for _ in range(rng.choice([3, 3, 3, 3, 2, 4]))) for _ in range(120)]
        text = '"a\nx";b;c\n' + "\n".join(lines) + ("\n" if f else "")
        (tmp_path / f"{f}.csv").write_bytes(text.encode())
    found, expected = both_readers(small, str(tmp_path))
    assert found == expected and len(found) >= 300
    files = [f for f, _ in delimited.listed(small, str(tmp_path))]
    lines = records.scan_lines(small, files, ";", "UTF-8")
    assert lines.rdd.getNumPartitions() > 6 and records.split_states(lines).owners


def test_a_record_longer_than_splits_and_one_that_never_closes(small, tmp_path):
    long = "linha\n" * 1_000
    text = f'a;b\n1;"{long}"\n2;x\n3;"{long}{long}"\n4;"open\n5;y\n' + "6;z\n" * 300 + "7"
    (tmp_path / "a.csv").write_text(text)
    found, expected = both_readers(small, str(tmp_path))
    assert found == expected and len(found) == 4


def test_a_header_longer_than_a_split_and_empty_lines(small, tmp_path):
    head = '\n\n"a' + "\n" * 900 + 'a";b\n'
    (tmp_path / "a.csv").write_text(head + "\n\n1;x\n\n" + '2;"y\n\n"\n' * 200)
    found, expected = both_readers(small, str(tmp_path))
    assert found == expected and len(found) == 201


@pytest.mark.parametrize("encoding", ["latin-1", "cp1252", "auto"])
def test_charsets_and_carriage_returns(small, tmp_path, encoding):
    signs = "é" if encoding == "latin-1" else "é€"
    text = "a;b\r\n" + "".join(f'{i};"{signs}\r\n""x"""\r\n' for i in range(200))
    (tmp_path / "a.csv").write_bytes(text.encode("cp1252"))
    found, expected = both_readers(small, str(tmp_path), encoding=encoding)
    assert found == expected and len(found) == 200 and signs in found[0]


def test_a_charset_that_cannot_be_split_and_failing_on_misfits(small, tmp_path):
    wide = tmp_path / "wide"
    wide.mkdir()
    (wide / "a.csv").write_bytes(("a;b\n" + '1;"x\ny"\n' * 100).encode("utf-16"))
    assert delimited.read_delimited(small, str(wide), encoding="UTF-16", multi_line=True).count() == 100
    (tmp_path / "a.csv").write_text("a;b\n" + '1;"x\ny"\n' * 100 + "1;2;3\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        delimited.read_delimited(small, str(tmp_path / "a.csv"), multi_line=True, malformed="fail").collect()


def test_states_of_splits_come_as_rows(small, tmp_path):
    """A task gets the states of its own splits as rows; with all of them in its closure, work grew
    with the square of the number of splits."""
    (tmp_path / "a.csv").write_text("a;b\n" + '1;"x\ny"\n' * 2_000)
    files = [f for f, _ in delimited.listed(small, str(tmp_path))]
    lines = records.scan_lines(small, files, ";", "UTF-8")
    splits = records.split_states(lines)
    told = splits.beside(lines).select("file", "block", "goes_on", "owner").distinct()
    assert splits.table.count() == told.count() == lines.rdd.getNumPartitions() > 20
    assert {(r[0], r[1]): r[3] for r in told.where("goes_on").collect()} == splits.owners
