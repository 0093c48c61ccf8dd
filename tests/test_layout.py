import hashlib
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from rollbook.operators import audit, layout
from rollbook.sources import files

HEADER = "પ્રશ્ન      િવાબ"


def test_repair_gives_each_quality(spark):
    rows = [
        (1, "૧૨\nરોજગાર યોજના\nbody", "રોજગાર યોજના"),
        (2, "12\nરોજગાર યોજ઩ા\nઅ઩ેક", "રોજગાર યોજના"),
        (3, "nothing of the kind\nat all", "રોજગાર યોજના"),
        (4, "text ૩ ાાા", None),
        (5, None, "abcd"),
        (6, "", ""),
        (7, "a*cd*f", "abcdef"),
    ]
    docs = spark.createDataFrame(rows, "id int, text string, subject string").withColumn("_rank", F.lit(1))
    got = {r.id: (r.quality, r.text) for r in layout.repaired(docs, "text", "subject").collect()}
    assert got[1] == ("clean", "12\nરોજગાર યોજના\nbody")
    assert got[2] == ("repaired", "12\nરોજગાર યોજના\nઅનેક")
    assert got[3] == ("low", "nothing of the kind\nat all")
    assert got[4] == ("unknown", "text 3 ા")
    assert got[5] == ("low", "") and got[6] == ("unknown", "")
    assert got[7][0] == "low"  # one sign stands for two characters


def test_glyph_map_leaves_conflicts_out(spark):
    rows = [("abcabc", "xbcxbc"), ("abcd", "*bc*"), (None, "a"), ("a", None), ("", "")]
    got = [r[0] for r in spark.createDataFrame(rows, "clean string, garbled string").select(layout.glyph_map("clean", "garbled")).collect()]
    assert got == [{"x": "a"}, {}, None, None, {}]
    assert SequenceMatcher(None, "xbcxbc", "abcabc", autojunk=False).get_opcodes()[0][0] == "replace"


def test_two_columns(spark):
    text = "\n".join(
        [
            "12", "Title", "Asked by *15/8/3863", HEADER,
            "(૧) how many              (૧) none",
            "    in all",
            "                              at all",
            "                        and more",
            "પત્રક-૧", "  1   2  ", "(1) a (2) b",
        ]
    )
    rows = [(1, text), (2, "no header"), (3, None), (4, HEADER + "\n(1) only a question"), (5, HEADER), (6, "T\n" + HEADER + "\nq\nપત્રક\nx"), (1, text)]
    got = layout.split_columns(spark.createDataFrame(rows, "id int, text string"), "id", "text").collect()
    first = [r for r in got if r.id == 1]
    assert len(first) == 2 and first[0] == first[1]
    r = first[0]
    assert r.question == "Title\nAsked by *15/8/3863\n(1) how many\n    in all"
    assert r.answer == "(1) none\nat all\nand more\nપત્રક-1\n  1   2\n(1) a (2) b"
    assert (r.confidence, r.subject, r.question_ref, r.marker) == (0.8, "Title", "15/8/3863", HEADER)
    six = next(r for r in got if r.id == 6)
    assert (six.question, six.answer, six.confidence) == ("T\nq", "પત્રક\nx", 0.8)
    assert {r.id for r in got} == {1, 6}


def test_district_figures(spark):
    text = "\n".join(["સુ રત  ૧,૨૩૪  5.5", "સુરત શહે ર 7", "સુરત is told of", "સુરત" + " " * 41 + "9", "ગીર સોમનાથ (1) 31/12/2025 8", ""])
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, text string")
    names = ["સુરત", "ગીર સોમનાથ", "ગીર"]
    got = [(r.line_no, r.district, r.area, r.figures) for r in layout.district_figures(docs, "id", "text", names).collect()]
    assert got == [(1, "સુરત", "", [1234.0, 5.5]), (2, "સુરત", layout.CITY, [7.0]), (5, "ગીર સોમનાથ", "", [8.0])]
    assert layout.district_figures(docs, "id", "text", []).count() == 0


def test_catalogue_floor(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "label string")
    assert audit.catalogue_floor(rows, "label", 2).count() == 2
    with pytest.raises(ValueError, match="fewer than 3"):
        audit.catalogue_floor(rows, "label", 3)
    with pytest.raises(ValueError, match="fewer than 1"):
        audit.catalogue_floor(rows.limit(0), "label", 1)
    with pytest.raises(ValueError, match="twice: a"):
        audit.catalogue_floor(rows.union(rows), "label", 2)


def test_still_verifies(spark, tmp_path):
    folder = tmp_path / "held"
    folder.mkdir()
    for name in "abc":
        (folder / name).write_bytes(name.encode())
    sha = hashlib.sha256(b"a").hexdigest()
    rows = [("u1", 1, "failed", None, None), ("u1", 2, "ok", "a", sha), ("u2", 1, "ok", "b", sha), ("u3", 1, "ok", "c", None), ("u4", 1, "ok", "gone", None), ("u5", 1, "ok", "a", sha), ("u5", 2, "failed", "a", sha), ("u6", 1, "ok", "", None)]
    manifest = spark.createDataFrame(rows, "url string, at int, status string, local_file string, sha256 string")
    assert {r.url for r in files.still_verifies(spark, manifest, str(folder), "url", "at").collect()} == {"u1", "u3"}
    assert {r.url for r in files.still_verifies(spark, manifest, str(folder), "url", "at", lambda c: c.cast("string") == "c").collect()} == {"u3"}
