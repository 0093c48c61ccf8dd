from rollbook.functions.affidavit import NUMBERS, TEXTS, affidavit

PAGE = """<h2>A &amp;  B <font color=green>(Winner)</font></h2><b>Party:</b> One Party<br><b>Age:</b> 54
<b>Self Profession:</b> Farmer &lt;x&gt;<br>Category: Graduate <br>Assets: </td><td> <b>Rs&nbsp;1,23,45,678</b>
Liabilities:</td><td><b>Rs&nbsp;0</b> ['Cases', 3]"""


def test_affidavit_fields(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, "<h2>Plain</h2><b>Age:</b> none"), (3, ""), (4, None)], "id int, html string")
    got = {r.id: r.a.asDict() for r in rows.select("id", affidavit("html").alias("a")).collect()}
    assert got[1] == {
        "name": "A & B", "winner_status": "Winner", "party": "One Party", "self_profession": "Farmer <x>", "spouse_profession": None,
        "education_category": "Graduate", "age": 54, "assets_rupees": 12345678, "liabilities_rupees": 0, "criminal_cases_declared": 3,
    }
    nothing = dict.fromkeys([*TEXTS, *NUMBERS])
    assert got[2] == nothing | {"name": "Plain"} and got[3] == got[4] == nothing
