"""Tagged text by line: against a reader of its own, cut at every line, and as files in many parts."""

import random
import re

import pytest

from quillon.sources import formats as f
from quillon.sources.bibliography import read_bibliography

MARKS = {"ris": (r"^[A-Z0-9]{2}\s+-", "TY", "ER"), "pubmed_nbib": (r"^[A-Z0-9]{2,4}\s*-", "PMID", "ER"), "refworks": (r"^(?:[A-Z][A-Z0-9]|vo)\s+.", "RT", None)}


def plain(text, kind):
    """Items by brute force: one line after the other."""
    mark, opens, closes = MARKS[kind]
    items = [[]]
    for line in text.splitlines():
        if re.match(mark, line):
            tag = re.match(r"\w+", line)[0]
            rest = line[len(tag) :].lstrip().removeprefix("-" if kind != "refworks" else "").strip()
            if tag == opens or tag == closes:
                items.append([])
            if tag != closes:
                items[-1].append([tag, rest])
        elif items[-1]:
            items[-1][-1][1] = (items[-1][-1][1] + " " + line.strip()).strip()
    found = []
    for own in items:
        raw = {}
        for tag, value in own:
            raw.setdefault(tag, []).append(value)
        found += [raw] if raw else []
    return found


def random_text(rng, kind, titled=True):
    """A file of a format with folded and empty lines, tags without values, and line ends with and without blanks."""
    dash = {"ris": "  - ", "pubmed_nbib": "- ", "refworks": " "}[kind]
    title = {"ris": "TI", "pubmed_nbib": "TI", "refworks": "T1"}[kind]
    value = lambda: rng.choice(["a b", "中文 ü", "", "x; y", "AB  - no", "10.1234/q", "z" * rng.randrange(1, 60), "UK", "K1"])
    lines = []
    for k in range(rng.randrange(1, 12)):
        lines.append({"ris": "TY  - JOUR", "pubmed_nbib": f"PMID- {k}", "refworks": "RT Journal Article"}[kind])
        lines.append(f"{title}{dash}Title {k}")
        for _ in range(rng.randrange(6)):
            lines.append(rng.choice([f"{rng.choice(['AU', 'KW', 'AB', 'AD', 'K1', 'PY', 'OT'])}{dash}{value()}", f"      {value()}", value().replace("AB  - no", "no"), "", "  "]))
        lines += rng.choice([["ER  -"], ["ER  - "], ["ER  -", ""], []]) if kind != "refworks" else [""]
    return rng.choice(["\n", "\r\n"]).join(x.rstrip() if rng.random() < 0.5 else x for x in lines)


@pytest.mark.parametrize("kind", sorted(MARKS))
def test_items_equal_a_reader_by_line(kind):
    rng = random.Random(1)
    for _ in range(300):
        text = random_text(rng, kind)
        assert list(f.tagged_items(text, kind)) == plain(text, kind)


def test_marks_without_blanks_lose_nothing():
    two = f.parse(b"TY  - JOUR\nTI  - A\nER  -\nTY  - JOUR\nTI  - B\nER  -\n")
    assert [x["TI"] for x, _ in two.records] == [["A"], ["B"]]
    x = f.parse(b"TY  - JOUR\nAU  -\nTI  - A\nKW  -\nAB  - text\nER  -").records[0][0]
    assert x == {"TI": ["A"], "AB": ["text"], "DT": ["JOUR"]}
    y = f.parse(b"PMID- 1\nTI  - A\nOT  -\nAB  - text\n").records[0][0]
    assert y["AB"] == ["text"] and "DE" not in y
    z = f.parse(b"RT Journal Article\nT1 A\nAD Univ X,\nUK\nK1 foo;bar\n").records[0][0]
    assert z["DE"] == ["foo", "bar"] and z["C1"] == ["Univ X, UK"]


WOS = "FN Clarivate\nVR 1.0\nPT J\nAU Li, A\n   Wang, B\nTI A\nCR x\nER\n\njunk\nPT J\nTI Second\n   goes on\nPT inside\nER \nER\nPT J\nAU no title\nEF"


@pytest.mark.parametrize("kind", [*sorted(MARKS), "wos_tagged"])
def test_cuts_at_every_line_join_again(kind):
    rng = random.Random(2)
    for _ in range(20):
        lines = (WOS if kind == "wos_tagged" else random_text(rng, kind)).splitlines()
        whole = [own for _, own in f.cut_lines(lines, kind)]
        for at in range(1, len(lines)):
            *first, (state, left) = f.cut_lines(lines[:at], kind)
            (head_state, head), *rest = f.cut_lines(lines[at:], kind, synced=False)
            assert state == "open" and head_state == "head"
            runs = [own for _, own in first] + [own for _, own in f.cut_lines(left + head, kind)] + [own for _, own in rest]
            assert [x for x in runs if x] == [x for x in whole if x]


@pytest.mark.parametrize("kind", [*sorted(MARKS), "wos_tagged"])
def test_files_in_parts_equal_whole_files(spark, tmp_path, kind):
    rng = random.Random(3)
    paths = []
    for k in range(6):
        text = WOS.replace("\n", rng.choice(["\n", "\r\n"])) if kind == "wos_tagged" and k else random_text(rng, kind) if kind != "wos_tagged" else WOS + "\nTI late\n"
        path = tmp_path / f"{kind} {k}%.txt"
        path.write_bytes(text.encode(["utf-8", "utf-8-sig", "gb18030"][k % 3]))
        paths.append(str(path))
    if kind == "ris":
        (tmp_path / "untitled.ris").write_text("TY  - JOUR\nTI  - A\nER  -\nTY  - JOUR\nAU  - B\nER  -\n" * 9)
        (tmp_path / "x.csv").write_text("PMID,Title\n1,T\n")
        paths += [str(tmp_path / "untitled.ris"), str(tmp_path / "x.csv")]
    expected, rows, old = read_bibliography(spark, paths), {}, {}
    for name in ("maxPartitionBytes", "openCostInBytes"):
        old[name] = spark.conf.get(f"spark.sql.files.{name}")
    try:
        for size in (23, 64, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", 0)
            got = read_bibliography(spark, paths, split_over=0)
            for name in ("records", "files", "warnings"):
                rows[name] = sorted(map(repr, (tuple(r) for r in getattr(got, name).collect())))
                assert rows[name] == sorted(map(repr, (tuple(r) for r in getattr(expected, name).collect()))), (size, name)
            assert got.header == expected.header
    finally:
        for name, value in old.items():
            spark.conf.set(f"spark.sql.files.{name}", value)
