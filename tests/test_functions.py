import datetime

import pytest
from pyspark.sql import functions as F

from rollbook.functions import dates, names, numbers, text, web


def run(spark, column, *values, kind="string"):
    """The values of a Column over a column `x`."""
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}").orderBy("i").select(column).collect()]


X = None


@pytest.fixture(autouse=True)
def column(spark):
    global X
    X = F.col("x")


def test_bill_dates(spark):
    got = run(spark, dates.bill_date(X), "05/02/2024", "2024-02-05", "2024-02-05 10:00:00", "2024-02-05 10:00:00.5", "2024-02-05T23:59:60Z", "2024-02-05T99:99:99Z", "2024-02-30", "5 Feb", "", None)
    day = datetime.date(2024, 2, 5)
    assert [(r.day, bool(r.unreadable)) for r in got] == [(day, False)] * 5 + [(None, True)] * 3 + [(None, False)] * 2


def test_other_dates(spark):
    assert run(spark, dates.http_date(X), "Wed, 21 Oct 2015 07:28:00 GMT", "yesterday") == ["2015-10-21T07:28:00Z", "yesterday"]
    assert run(spark, dates.archive_stamp(X), "20240102030405", "2024", "20241399000000") == ["2024-01-02T03:04:05Z", None, None]
    assert run(spark, dates.or_ten(X, "dd-MMM-yyyy"), "02-Jan-2024", "not a date at all") == ["2024-01-02", "not a date"]
    assert run(spark, dates.or_empty(X, "dd/MM/yyyy"), "02/01/2024", "x", None) == ["2024-01-02", "", ""]
    assert run(spark, dates.register_date(X), "2024-01-02", "02-01-2024", "02/01/2024") == ["02-01-2024", "02-01-2024", None]
    assert run(spark, dates.in_range(X, "2024-01-01", "2024-01-31"), "2024-01-31T09", "2024-02-01", None, "") == [True, False, True, True]
    assert run(spark, dates.as_on(X), "as on 1.4.2023", "none") == ["2023-04-01", None]
    assert run(spark, dates.deadline(X, 2024), "last date 05/03/2019, extended: last date is 7-3-2024", "apply on or before March 5, 2024", "nothing") == ["7-3-2024", "March 5, 2024", None]
    assert run(spark, dates.deadline_iso(X), "March 5, 2024", "7-3-2024", "7.3.2024.", "x", None) == ["2024-03-05", "2024-03-07", "2024-03-07", None, None]
    assert run(spark, dates.year_bucket(X), "2024-01-01", " ") == ["2024", None]


def test_names(spark):
    assert run(spark, names.normal_person(X), "Joshi, Shri P.V.", "P V Joshi", "", "Ven'ble A,B,C") == ["joshi p v", "joshi p v", "", "a b c"]
    assert run(spark, names.normal_member(X), "Joshi, Dr. Murli-Manohar", "A,B,C") == ["joshi murlimanohar", "abc"]
    assert run(spark, names.slug(X), "Shri P.V. Joshi") == ["p_v_joshi"]
    assert run(spark, names.entity_id(X, F.lit("LS")), " A B ")[0].startswith("PERSON_") and run(spark, names.entity_id(X), "A B")[0].endswith("_a_b")
    assert run(spark, names.words_to_int(X), "three hundred and sixty sixth", "one hundred", "third", "zero", "xyz", "") == [366, 100, 3, None, None, None]
    assert run(spark, names.referenced_number(X), "374th Report on Action Taken contained in the Three Hundred And Sixty Sixth Report", "contained in the 24th Report", "Report No. 7", "12th Report", "none") == [366, 24, 7, 12, None]
    assert run(spark, names.referenced_key(X, F.lit("17"), F.lit("coal"), F.lit(3)), "Lok Sabha", "rs", "x") == ["LS|coal|3|17", "RS|coal|3", None]
    assert run(spark, names.fold(X), "Núápada  (East)", "Āgra", None) == ["nuapadaeast", "agra", None]
    assert run(spark, names.state_key(X), "07", "West Bengal") == ["7", "westbengal"]
    assert run(spark, names.house_short(X), "Lok Sabha", "RAJYA SABHA", "Other") == ["LS", "RS", "other"]
    assert [tuple(r) for r in run(spark, names.name_and_seat(X), "A B (North)", "C")] == [("A B", "North"), ("C", None)]
    assert [tuple(r) for r in run(spark, names.labelled_code(X), "Dahod (12)", "Plain")] == [("Dahod", "12"), ("Plain", None)]
    assert run(spark, names.sessions(X), "1-3,7") == [[1, 2, 3, 7]]
    assert [r and tuple(r) for r in run(spark, names.school_code(X), "12345678901", "12")] == [("12", "34", "56", "78901"), None]


def test_numbers(spark):
    assert run(spark, numbers.integers(X), "1,234 and 5") == [[1234, 5]]
    assert [tuple(r) for r in run(spark, numbers.number_or_text(X), "12", "N/A", "few")] == [(12.0, None), (None, None), (None, "few")]
    assert run(spark, numbers.safe_int(X), "12.0", "1.5", "x") == [12, None, None]
    assert [tuple(r) for r in run(spark, numbers.facility(X), "GANGTOK(67)", "3", "", "few")] == [(0, "GANGTOK", 67.0), (3, None, None), (None, None, None), (None, None, None)]
    assert [float(v) if v is not None else None for v in run(spark, numbers.rupees(X), "Rs. 4.5 crore", "12 lakhs", "none")] == [45_000_000, 1_200_000, None]
    assert run(spark, numbers.excerpt(X, 10), "one two three four", "short") == ["one two...", "short"]
    assert run(spark, numbers.padded(X, 3), "7", "1234", "x") == ["007", "1234", "x"]
    assert run(spark, numbers.count_or_status(F.lit(None).cast("long"), X), "not_available", None) == [0, None]
    assert run(spark, numbers.halved(X, F.lit(100)), 1000, 150, 100, kind="long") == [500, 100, 100]


def test_letters(spark):
    r = run(spark, text.split_qa(X), "(TO BE ANSWERED ON 1.1.2024)\nbody of it\nANSWER\nthe reply", "no boundary", "ANSWER\nonly one side", "q\nReply by the Minister:\nr")
    assert (r[0].question, r[0].answer, r[0].marker, r[0].confidence) == ("(TO BE ANSWERED ON 1.1.2024)\nbody of it", "the reply", "ANSWER", 0.5)
    assert r[1] is None and r[2] is None and r[3].marker == "Reply by the Minister:"
    good = "GOVERNMENT OF INDIA\nANSWER\n" + "words " * 40
    assert run(spark, text.looks_like_answer(X), good, "TO BE ANSWERED ON\nGOVERNMENT OF INDIA " + "words " * 40, "short", None) == [True, False, False, False]
    assert run(spark, text.clean(X), "a  b\n 12 \n\n\n\nc (Para 2.15)") == ["a b\n\nc"]
    assert run(spark, text.report_type(X), "Action-Taken on Demands for Grants", "Demand for Grants", "The X Bill, 2025", "Functioning of Y", "billboard", None) == ["action_taken", "demands_for_grants", "bill", "subject", "other", "other"]
    assert run(spark, text.presented(X, F.lit("1"), F.lit("")), "2", " ", None) == ["both_houses", "rs_only", "rs_only"]
    assert run(spark, text.source_class(X, F.lit("other")), "qa", "committee_report", "x") == ["qa", "observations", "skip"]
    assert run(spark, text.number_verdict(F.lit("07"), X), "7", "8", None) == ["verified", "mismatch", "unreadable"]
    assert run(spark, text.volume(X), "Vol-II", "Volume I", "x") == ["II", "I", None]
    assert run(spark, text.transliterate_digits(X), "૧૨૩") == ["123"]
    assert run(spark, text.stated_totals(X), "Total Number of Questions - 20 Total number of questions: 5") == [[20, 5]]


def test_advertisements(spark):
    assert run(spark, text.post_type(X), "Post-doctoral fellow", "Assistant Professor", "JRF", "Project Officer", "x") == ["Postdoc", "Faculty", "Scientific", "NonFaculty", "Unknown"]
    assert run(spark, text.contract_status(X), "Guest faculty", "adhoc", "on contract basis", "tenure track", "permanent", "") == ["Guest", "AdHoc", "Contractual", "TenureTrack", "Regular", "Unknown"]
    assert run(spark, text.department(X), "Professor, Department of Physics, IIT X", "Faculty positions in Civil Engineering - 2024", "x") == ["Physics", "Civil Engineering", None]
    assert run(spark, text.publications(X), "a minimum of THREE papers in refereed\n journals. At least 4 papers in good conferences.", "none") == ["minimum of THREE papers in refereed journals. | At least 4 papers in good conferences.", None]
    assert run(spark, text.reservation_note(X), "SC-15%, ST-7.5%, OBC-27%.", "none")[1] is None


def test_web(spark):
    assert run(spark, web.canonical(X), "HTTP://WWW.Host.in:80/A/b/?q=1#f", "https://host.in:443/", "host.in/x", "http://host.in:8080/x") == ["host.in/A/b?q=1", "host.in", "host.in/x", "host.in:8080/x"]
    assert run(spark, web.safe_segment(X), "../../e vil", "", None, "..") == ["_.._e_vil", "unknown", "unknown", "unknown"]
    assert run(spark, web.destination(X), "https://h/a/b.pdf", "https://h/", "https://h/dir", "https://h/a.pdf?p=1")[:3] == ["a/b.pdf", "index.html", "dir/index.html"]
    assert run(spark, web.public_url(X), "https://h/a?api-key=S&x=1", "https://h/a?x=1&token=S") == ["https://h/a?x=1", "https://h/a?x=1"]
    assert run(spark, web.strip_tags(X), "<p>a<b>b</b>\n c</p>") == ["a b c"]
    assert run(spark, web.frameworks(X), '<div id="root"></div>__NEXT_DATA__', "") == [["Next.js", "React root element"], []]
    assert [[tuple(p) for p in r] for r in run(spark, web.order_rows(X), "download('1','go');download('1','go');download('2','x')")] == [[("1", "go"), ("2", "x")]]
    assert run(spark, web.magic(X), b"%PDF-1 %%EOF", b"%PDF-1", b"PK\x03\x04z", b"", kind="binary") == ["pdf", "truncated_pdf", "zip", "unknown"]
    assert run(spark, web.redact(X), {"apiKey": "s", "page": "1"}, kind="map<string,string>") == [{"apiKey": "[redacted]", "page": "1"}]
    r = run(spark, web.rendered(X, F.lit("Visible"), 400, ("absent",)), "<html>")[0]
    assert (r.rendered, r.reason, r.missing) == (False, "required", ["absent"])


@pytest.mark.parametrize("bad", ["2024-03-01"])
def test_reversed_range_is_an_error(spark, bad):
    with pytest.raises(Exception, match="reversed"):
        spark.sql(f"select date'{bad}' a, date'2024-02-01' b").select(dates.day_range(F.col("a"), F.col("b"))).collect()
