from rollbook.operators import listings


def site(spark, html, url="https://h.in/a/list.html"):
    return spark.createDataFrame([(1, url, html)], "k int, u string, t string")


def test_demands_and_reports(spark):
    html = '<a href="x/DDG_2023-24.pdf">Detailed</a><a href="/y.pdf">Demand for Grants 2022-2023</a><a href="/y.pdf">Demand 2022-23</a><a href="z.pdf">Other 2021-22</a><a href="d.pdf">Demand</a><a href="q.html">Demand 2020-21</a>'
    got = sorted((r.title, r.year, r.url) for r in listings.demand_documents(site(spark, html), "k", "u", "t").collect())
    assert got == [("Demand for Grants 2022-2023", "2022-23", "https://h.in/y.pdf"), ("Detailed", "2023-24", "https://h.in/a/x/DDG_2023-24.pdf")]
    html = '<a href="/u/Annual%20Report%202024-25%20Hindi_V3.pdf">x</a><a href="/2020/AR.pdf">y</a><a href="/AR_2025-26.pdf">z</a>'
    got = sorted((r.year, r.language, r.filename) for r in listings.annual_reports(site(spark, html), "k", "u", "t").collect())
    assert got == [("2024-25", "hindi", "Annual Report 2024-25 Hindi_V3.pdf"), ("2025-26", "english", "AR_2025-26.pdf")]


def test_year_behind_other_numbers(spark):
    """A key before the year is no year, even if it looks like one."""
    names = {"2012_2021-22": "2021-22", "12012_2021-22": "2021-22", "2020_2021-22": "2021-22", "202223_2021–2022": "2021-22", "2010_2021_22": "2021-22", "2099-2100": "2099-21", "v2_202122": "2021-22", "1999-00": None, "2019_20202": "2019-20", "2099_2000": "2099-00"}
    html = "".join(f'<a href="/d/{x}.pdf">Demand no. 7</a>' for x in names)
    got = {r.url[len("https://h.in/d/") : -4]: r.year for r in listings.demand_documents(site(spark, html), "k", "u", "t").collect()}
    assert got == {k: v for k, v in names.items() if v}
    files = [(r.filename, r.year) for r in listings.annual_reports(site(spark, '<a href="/2012_AR_2013_2021-22.pdf">x</a>'), "k", "u", "t").collect()]
    assert files == [("2012_AR_2013_2021-22.pdf", "2021-22")]


def test_recruitment(spark):
    html = '<a href="#a">jobs</a><a href="/careers">Careers</a><a href="ad1.pdf">Advertisement 1</a><a href="./ad1.pdf">Advt again</a><a href="/jobs/jobs/12">Click here</a><a href="/x">News</a>'
    got = sorted((r.url, r.title, r.generic) for r in listings.recruitment_links(site(spark, html), "k", "u", "t").collect())
    assert got == [("https://h.in/a/ad1.pdf", "Advertisement 1", False), ("https://h.in/jobs/jobs/12", "Click here", True)]


def test_grids(spark):
    row = lambda *c: "<tr>" + "".join(f"<td>{x}</td>" for x in c) + "</tr>"
    good = "<table>" + row("Sl caption") + row("Sl. No.", "District", "AWC") + row("1", "A", "5") + row("2.", "B", "6") + row("Total", "", "11") + "</table>"
    got = [(r.row_no, r.header, r.cells, r.error) for r in listings.grid_rows(site(spark, good), "k", "t").orderBy("row_no").collect()]
    assert got == [(0, ["Sl. No.", "District", "AWC"], ["1", "A", "5"], None), (1, ["Sl. No.", "District", "AWC"], ["2.", "B", "6"], None)]
    bad = "<table>" + row("Name", "District", "AWC") + row("1", "A", "5") + row("2", "A", "5") + "</table>"
    assert [r.error for r in listings.grid_rows(site(spark, bad), "k", "t").collect()] == ["no header row"]


def test_dimensions(spark):
    acts = spark.createDataFrame([("Goa", "The X Act"), ("Goa", "X (Amendment) Act"), ("Kerala", "Amendment of Y")], "state string, description string")
    states = spark.createDataFrame([("Goa",), ("Kerala",), ("Assam",)], "state string")
    assert {r.state: r.availability for r in listings.statute_availability(acts, states).collect()} == {"Goa": "principal_present", "Kerala": "amendment_only", "Assam": "absent"}
    tables = spark.createDataFrame([("pc11_vd",), ("pc11_td",), ("ec13",)], "name string")
    patterns = spark.createDataFrame([(0, "^ec"), (1, "^pc11"), (2, "^none")], "position int, pattern string")
    got = sorted((r.position, r.name, r.error) for r in listings.preset_tables(tables, patterns).collect())
    assert [g[:2] for g in got] == [(0, "ec13"), (1, "pc11_td"), (1, "pc11_vd"), (2, None)] and got[-1][2]
    prior = spark.createDataFrame([("a", "ok", "1"), ("b", "ok", "2"), ("c", "failed", None)], "key string, status string, path string")
    files = spark.createDataFrame([("1",)], "path string")
    assert {r.key: r.settled for r in listings.settled_documents(prior, files).collect()} == {"a": True, "b": False, "c": True}
    assert {r.key: r.settled for r in listings.settled_documents(prior, files, True).collect()} == {"a": True, "b": False, "c": False}
