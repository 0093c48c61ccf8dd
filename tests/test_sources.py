import datetime
import gzip
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from rollbook.sources import files, payloads
from rollbook.sources.corpus import Corpus


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    qa = lambda k, **x: {"key": k, "kind": "qa", "house": "ls", "title": f"title {k}", "date": "2024-01-02", "ministry": "Mines", "askers": ["A", "B"], "asker_entity_ids": ["P1", None], "pdf_path": "a.pdf", **x}
    report = lambda k, t, **x: {"key": k, "kind": "committee_report", "house": "ls", "report_type": t, "committee_slug": "coal", "report_no": 3, "loksabha_no": 17, "title": "", **x}
    write(
        d / "manifest.jsonl",
        [
            qa("q1"), "", "{broken", qa("q2", extra=1, date="", ministry="mines "), qa("q3", ministry="Coal", pdf_path=None, asker_entity_ids=None),
            report("LS|coal|3|17", "subject"), report("LS|coal|9|17", "action_taken", title="9th Report on Action Taken on recommendations contained in the Third Report"),
            report("LS|coal|10|17", "action_taken", title="contained in the 99th Report"), report("LS|coal|11|17", "action_taken", title="nothing"),
        ],
    )
    answer = lambda k, t: {"key": k, "kind": "qa_response", "confidence": 0.85, "answer_text": t, "question_text": "q"}
    write(d / "answers.jsonl", [answer("q1", "first royalty"), answer("q1", "second"), {"key": "LS|coal|9|17", "kind": "atr_response", "recommendation_no": 1}, {"key": "LS|coal|3|17", "kind": "observation", "recommendation_no": 2}, {"key": "LS|coal|99|17", "kind": "dfg_recommendation", "recommendation_no": 7}])
    link = lambda a, r: {"atr_key": a, "references_report_key": r}
    write(d / "atr_linkages.jsonl", [link("LS|coal|9|17", "LS|coal|1|17"), link("LS|coal|9|17", "LS|coal|3|17"), link("LS|coal|10|17", "LS|coal|99|17")])
    return Corpus(spark, f"file://{d}")


def test_streams(corpus):
    assert corpus.stream("manifest_qa").count() == 3 and corpus.manifest_committee_reports().count() == 4
    assert corpus.stream("people").collect() == []
    assert [r.report_no for r in corpus.stream("manifest_committee_reports").collect()] == ["3"] * 4
    with pytest.raises(ValueError, match="manifest_qa"):
        corpus.to_dataframe("nothing")
    assert len(corpus.to_dataframe("answers_qa")) == 2


def test_join_qa(corpus):
    got = {r.key: [a.answer_text for a in r.answers] for r in corpus.join_qa().collect()}
    assert got == {"q1": ["first royalty", "second"], "q2": [], "q3": []}


def test_report_chain(corpus):
    got = {r.key: (r.original and r.original.key, len(r.answers), [o.recommendation_no for o in r.observations]) for r in corpus.join_atr_chain().collect()}
    assert got == {"LS|coal|9|17": ("LS|coal|3|17", 1, [2]), "LS|coal|10|17": (None, 0, [7]), "LS|coal|11|17": (None, 0, [])}
    links = {r.atr_key: r.references_report_key for r in corpus.link_reports().collect()}
    assert links == {"LS|coal|9|17": "LS|coal|3|17", "LS|coal|10|17": "LS|coal|99|17"}


def test_stats_and_counts(corpus):
    s = corpus.stats().first()
    assert (s.questions, s.with_pdf, s.first_date, s.askers, s.resolved_askers, s.answers) == (3, 2, "2024-01-02", 6, 2, 2)
    assert (s.answer_coverage, s.resolution_rate, s.linkage_rate) == (1.0, 0.333, 0.667)
    assert [tuple(r) for r in corpus.counts("ministry").collect()] == [("MINES", 2), ("COAL", 1)]
    assert [tuple(r) for r in corpus.counts("year").collect()] == [("2024", 2)]
    assert {r.key for r in corpus.evidence("mines", ["Royalty"]).collect()} == {"q1"}


def test_validate(corpus):
    got = {(r.stream, r.rule): (r.checked, r.failed) for r in corpus.validate().collect()}
    assert got["manifest_qa", "key"] == (3, 0) and got["answers_atr", "recommendation_no"] == (1, 0)
    assert got["answers_qa", "confidence"] == (2, 0) and got["runs", "status"] == (0, 0)


def test_extract_answers(spark, corpus):
    letter = "GOVERNMENT OF INDIA\nMINISTRY OF MINES\nANSWERED ON: 02.01.2024\nROYALTY RATES\n12. SHRI A B:\nWill the Minister of MINES be pleased to state:\n(a) rates?\n12\nANSWER\nMINISTER OF STATE IN THE MINISTRY OF MINES (SHRI X YADAV):\nThe rates are set out. (Para 2.1) More."
    r = corpus.extract_answers(spark.createDataFrame([("q1", letter), ("q2", "no boundary"), ("zz", letter)], "key string, text string")).collect()
    assert len(r) == 1
    assert (r[0].boundary_marker, r[0].question_subject, r[0].question_stem, r[0].question_body) == ("ANSWER", "ROYALTY RATES", "Will the Minister of MINES be pleased to state:", "(a) rates?")
    assert (r[0].answer_minister_name, r[0].answer_body) == ("SHRI X YADAV", "The rates are set out. More.")


def test_strict_lines(spark, tmp_path):
    write(tmp_path / "x.jsonl", ['{"a": 1}', "", "{no", "[1]"])
    assert sorted(r.error or "" for r in files.read_jsonl_strict(spark, f"file://{tmp_path}/x.jsonl").collect()) == ["", "not JSON", "not an object"]


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name , Amount\n x ,1\n , \n\"y, z\",2\n", encoding="utf-8")
    assert [tuple(r) for r in files.read_csv(spark, f"file://{tmp_path}/a.csv").collect()] == [("x", "1"), ("y, z", "2")]
    (tmp_path / "a.tsv").write_text("\"State Name\"\tCode\n\"Goa\"\t30\n", encoding="utf-8")
    assert [r.asDict() for r in files.read_tsv(spark, f"file://{tmp_path}/a.tsv").collect()] == [{"State Name": "Goa", "Code": "30"}]
    assert files.located(["Total  Amount", "State"], {"amount": "total amount", "state": "state"}) == {"amount": "Total  Amount", "state": "State"}
    with pytest.raises(ValueError):
        files.located(["A", "B"], {"x": "c"})


def workbook(rows):
    cell = lambda ref, v: f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>' if not isinstance(v, int) else f'<c r="{ref}" t="s"><v>{v}</v></c>'
    body = "".join(f"<row>{''.join(cell(f'{chr(65 + j)}{i + 1}', v) for j, v in enumerate(r))}</row>" for i, r in enumerate(rows))
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>shared</t></si></sst>")
    return out.getvalue()


def test_workbooks(spark, tmp_path, monkeypatch):
    (tmp_path / "a.xlsx").write_bytes(workbook([["x", 0], ["Rampur(67)"]]))
    (tmp_path / "b.xlsx").write_bytes(b"not a workbook")
    got = files.read_workbooks(spark, f"file://{tmp_path}/*.xlsx").collect()
    assert [r.cells for r in got if r.cells] == [{"A": "x", "B": "shared"}, {"A": "Rampur(67)"}]
    assert [r.error for r in got if r.error][0].startswith("BadZipFile")
    monkeypatch.setattr(files, "CEILING", 10)
    with pytest.raises(ValueError, match="unpacks"):
        files.sheet_rows(workbook([["x"]]))


def test_sinks_and_manifest(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "id int, t string")
    files.write_parts(rows.coalesce(1), out)
    part = next((tmp_path / "out").glob("*.gz"))
    assert len(gzip.open(part).read().splitlines()) == 3
    check = files.verify_outputs(spark, out, "id int, t string", "id").first()
    assert (check.files, check.rows, check.corrupt, check.duplicate_ids) == (1, 3, 0, 1)
    files.append_jsonl(rows, f"file://{tmp_path}/log")
    files.append_jsonl(rows, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 6
    (tmp_path / "mirror" / "d").mkdir(parents=True)
    (tmp_path / "mirror" / "d" / "f.txt").write_bytes(b"abc")
    good = hashlib.sha256(b"abc").hexdigest()
    manifest = spark.createDataFrame([("d/f.txt", good, 3), ("d/f.txt", "0", 3), ("d/f.txt", good, 4), ("gone", good, 3)], "path string, sha256 string, size long")
    assert sorted(r.verdict for r in files.verify_manifest(spark, manifest, f"file://{tmp_path}/mirror").collect()) == ["missing", "ok", "sha_differs", "size_differs"]
    assert json.loads(files.report(rows.limit(1))) == {"id": 1, "t": "a"}


def body(spark, payload, **more):
    return spark.createDataFrame([(json.dumps(payload), *more.values())], "body string" + "".join(f", {k} string" for k in more))


def test_captures(spark):
    answer = [["original", "timestamp", "statuscode", "length", "digest"], ["http://a", "20240102030405", "200", "12", "D"], ["http://a", "bad", "", "-", ""], ["resume"]]
    got = [(r.key, r.captured_at, r.http_status, r.digest, r.length) for r in payloads.captures(body(spark, answer)).collect()]
    assert got == [("WAYBACK|http://a|20240102030405", "2024-01-02T03:04:05Z", "200", "D", 12), ("WAYBACK|http://a|bad", None, None, None, None)]


def blocks(wrapper, rows, data="data"):
    return {wrapper: [{"districts": [{"district": "D", **({data: rows} if isinstance(data, str) else data)}]}]}


def flat(df):
    return {r.field: r.value for r in df.collect()}


def test_dashboards(spark):
    assert flat(payloads.registration(body(spark, blocks("registrationPTdata", [{"title": "Project", "count": 5}, {"title": "Else", "count": 1}])))) == {"projects": 5}
    rows = [{"title": "Stunting", "title1": "0 - 6 Years", "percent": "22"}, {"title": "Stunting", "title1": "0 - 5 Years", "percent": "21"}, {"title": "Children Measured", "title2": "0m_5y", "count": 9, "percentage": "80"}]
    assert flat(payloads.growth(body(spark, blocks("growthmonitoring", rows)))) == {"stunting_pct_0m_6y": 22, "stunting_pct_0m_5y": 21, "children_measured_0m_5y": 9, "children_measured_pct_0m_5y": 80}
    assert flat(payloads.home_visits(body(spark, blocks("homevisit", [{"title": "Pregnant Women &", "title1": "Lactating Mother", "count": 3}])))) == {"home_visit_pregnant_women_lactating_mother": 3}
    rows = [{"snp_Given_for_21_days": "7", "thr_per": "60", "hcm_per": "39"}, {"snp_Given_for_15_days": "8", "thr_per": "50"}, {"total": "9", "_id": "1"}]
    assert flat(payloads.key_services(body(spark, blocks("keyservices", rows)))) == {"snp_given_21d": 7, "thr_per_21d": 60, "hcm_per_21d": 39, "snp_given_15d": 8, "thr_per_15d": 50, "total": 9}
    rows = {"monthWiseActiveBeneficiaries": [{"districts": [{"district": "D", "activeBeneficiaries": [{"title": "Children", "title1": "(0-6 Months)", "count": 1}, {"title": "Children", "title1": "(3 - 6 Years)", "count": 2}], "aadharHealthData": [{"title": "Health ID", "count": 4, "percent": 50}]}]}]}
    got = flat(payloads.beneficiaries(body(spark, rows)))
    assert got["health_id_count"] == 4 and got["health_id_pct"] == 50 and len(got) == 4
    assert flat(payloads.titled(body(spark, blocks("awcInfrastructureCount", [{"title": "Toilet", "count": 6}])), "awcInfrastructureCount")) == {"Toilet": 6}


def test_bills_and_spend(spark):
    raw = [{"billNumber": "4", "billYear": "2024", "billName": "A Bill", "billIntroducedDate": "05/02/2024"}, {"billNumber": "", "billName": "B", "billIntroducedDate": "31/02/2024"}]
    got = {r.bill_no: r for r in payloads.bills(body(spark, raw, house="ls")).collect()}
    assert got["4"].key == "BILL|ls|2024|4" and got["4"].introduced_date == datetime.date(2024, 2, 5) and not got["4"].unreadable
    assert got[None].key.startswith("BILL|ls|") and got[None].unreadable and len(got[None].fingerprint) == 12
    cols = ["Company Name", "Financial Year", "PSU/Non-PSU", "CSR State", "CSR Development Sector", "CSR Sub Development Sector", "Project Amount Spent (In INR Cr.)"]
    rows = [(" X ", "2020-21", "", "", "", "", "1.5"), ("X", "2020-21", "", "", "", "", "junk"), ("", "2020-21", "", "", "", "", "9"), ("X", "2021-22", "", "", "", "", None)]
    spent = payloads.spend(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in cols)))
    assert sorted(tuple(r) for r in payloads.spend_by_company(spent).collect()) == [("X", "2020-21", 1.5), ("X", "2021-22", 0.0)]


def test_search_plans_and_boxes(spark):
    answer = {"result": {"found": "2", "rows": [{"idno": "S1", "title": "T", "year_start": "2001"}]}}
    assert [(r.found, r.idno, r.year_start) for r in payloads.study_search(body(spark, answer)).collect()] == [(2, "S1", 2001)]
    houses = spark.sql("select 'ls' house, date'2024-01-20' low, date'2024-03-05' high")
    assert [r.window_id for r in payloads.month_plan(houses).collect()] == ["ls|2024-01-20|2024-01-31", "ls|2024-02-01|2024-02-29", "ls|2024-03-01|2024-03-05"]
    shapes = spark.sql("select named_struct('type', t, 'points', p) g from values ('Point', array(array(1D, 1D))), ('Point', array(array(9D, 1D))), ('Polygon', array(array(1D, 1D))) v(t, p)")
    assert [r[0] for r in shapes.select(payloads.in_box(F.col("g"), 0, 0, 2, 2)).collect()] == [True, False, None]
    boxes = spark.sql("select 0D west, 0D south, 2D east, 2D north, true capped")
    assert sorted(tuple(r) for r in payloads.tiles(boxes).collect()) == [(0, 0, 1, 1), (0, 1, 1, 2), (1, 0, 2, 1), (1, 1, 2, 2)]
    dates_ = spark.sql("select 'rs' house, cast(null as int) loksabha, 5 session, cast(null as array<string>) periods, array('03/02/2024', 'x', '01-Feb-2024') dates")
    r = payloads.session_catalogue(dates_).first()
    assert (r.periods, r.sittings, str(r.first_sitting), str(r.last_sitting)) == ([], 2, "2024-02-01", "2024-02-03")
