"""A corpus: a folder of JSON-lines files, read into typed tables by name.

A manifest mixes kinds; `kind` is the tag, and each named stream is one or more kinds of one file
with a schema of its own. Unknown keys are dropped, missing ones are null, a missing file is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollbook.functions import dates, names, text
from rollbook.operators import audit, relational
from rollbook.sources.files import POSITION, read_jsonl

PROVENANCE = "source string, run_id string, probed_at string"
SCHEMAS = {
    "qa": f"""key string, kind string, house string, title string, date string, qtype string, qno string, ministry string, askers array<string>, asker_entity_ids array<string>,
        asker_details array<struct<name:string, party:string, party_name:string, house:string, state:string>>, found_via_group string, found_via_query string, pdf_url string, pdf_path string,
        question_text string, answer_text string, document_qno string, document_qno_status string, {PROVENANCE}""",
    "committee_report": f"""key string, kind string, house string, report_type string, presented_via string, committee_slug string, committee_name string, report_no string, title string, date string, loksabha_no string,
        date_presented_ls string, date_laid_rs string, date_presented_speaker string, date_adoption string, date_presentation string, language_classified array<string>, pdf_url string, pdf_path string, {PROVENANCE}""",
    "qa_response": """key string, kind string, run_id string, source_pdf string, extracted_at string, language_classified array<string>, source_report_type string, confidence double, extractor string,
        question_text string, answer_text string, boundary_marker string, question_subject string, question_stem string, question_body string, answer_minister_name string, answer_body string""",
    "atr_response": "key string, kind string, run_id string, source_pdf string, confidence double, extractor string, recommendation_no int, recommendation_text string, response_text string",
    "dfg_recommendation": "key string, kind string, run_id string, source_pdf string, source_report_type string, confidence double, extractor string, recommendation_no int, recommendation_text string",
    "atr_linkage": "atr_key string, atr_no string, house string, committee_slug string, atr_title string, references_report_no int, references_report_key string, extracted_at string, extractor string",
    "run": "run_id string, kind string, scope string, topic_name string, topic_hash string, started_at string, ended_at string, added int, status string, errors array<struct<where:string, error:string>>, bucket_attempts array<string>, elapsed_ms double",
    "window": "window_id string, house string, from_date string, to_date string, ses_no int, loksabha int, qtype string, status string, kept int, errors int, run_id string, recorded_at string",
    "person": "entity_id string, canonical_name string, alt_names array<string>, primary_kind string, first_seen_at string, last_updated_at string",
    "membership": "entity_id string, house string, term int, party string, party_name string, state string, constituency string, start string, end string, fetched_at string",
    "wayback_capture": "key string, kind string, url string, timestamp string, captured_at string, http_status string, digest string, media_type string, length long, status string",
    "bill": "key string, kind string, house string, bill_no string, bill_year string, title string, status string, introduced_date string, assented_date string, fetched_at string, probed_at string",
}
#: name -> (file, kinds or none, schema)
STREAMS = {
    "manifest_qa": ("manifest.jsonl", ("qa",), "qa"),
    "manifest_committee_reports": ("manifest.jsonl", ("committee_report",), "committee_report"),
    "manifest_bills": ("manifest.jsonl", ("bill",), "bill"),
    "manifest_wayback": ("manifest.jsonl", ("wayback_capture",), "wayback_capture"),
    "answers_qa": ("answers.jsonl", ("qa_response",), "qa_response"),
    "answers_atr": ("answers.jsonl", ("atr_response",), "atr_response"),
    # an older name for the same rows is taken too
    "answers_observations": ("answers.jsonl", ("dfg_recommendation", "observation"), "dfg_recommendation"),
    "atr_linkages": ("atr_linkages.jsonl", None, "atr_linkage"),
    "runs": ("runs.jsonl", None, "run"),
    "windows": ("windows.jsonl", None, "window"),
    "people": ("entities/people.jsonl", None, "person"),
    "mp_memberships": ("entities/mp_memberships.jsonl", None, "membership"),
}


class Corpus:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def stream(self, name: str, position: bool = False) -> DataFrame:
        if name not in STREAMS:
            raise ValueError(f"unknown stream {name!r}; there are: {', '.join(sorted(STREAMS))}")
        file, kinds, schema = STREAMS[name]
        rows = read_jsonl(self.spark, f"{self.folder}/{file}", SCHEMAS[schema], position)
        return rows.where(F.col("kind").isin(*kinds)) if kinds else rows

    def __getattr__(self, name: str):
        if name in STREAMS:
            return lambda: self.stream(name)
        raise AttributeError(name)

    def register_views(self, prefix: str = "") -> None:
        for name in STREAMS:
            self.stream(name).createOrReplaceTempView(prefix + name)

    def to_dataframe(self, name: str):
        """A stream in pandas: for results that fit the driver."""
        return self.stream(name).toPandas()

    def join_qa(self) -> DataFrame:
        """Questions with their answers in file order; none is an empty array."""
        answers = self.stream("answers_qa", position=True)
        return relational.with_children(self.stream("manifest_qa"), answers, "key", POSITION, "answers")

    def join_atr_chain(self) -> DataFrame:
        """Action-taken reports with their original report, answers and its observations."""
        reports = self.stream("manifest_committee_reports")
        links = self.stream("atr_linkages", position=True).withColumnRenamed(POSITION, "position").select("atr_key", "references_report_key", "position")
        answers, seen = (self.stream(s, position=True).withColumnRenamed(POSITION, "position") for s in ("answers_atr", "answers_observations"))
        return relational.chain(reports, links, answers, seen)

    def link_reports(self) -> DataFrame:
        """The number and key that each action-taken title refers to; titles without are left out."""
        taken = self.stream("manifest_committee_reports").where("report_type = 'action_taken'")
        number = names.referenced_number(F.col("title"))
        rows = taken.select(F.col("key").alias("atr_key"), F.col("report_no").alias("atr_no"), "house", "committee_slug", F.col("title").alias("atr_title"), number.alias("references_report_no"), "loksabha_no").where("references_report_no IS NOT NULL")
        key = names.referenced_key(F.col("house"), F.col("loksabha_no"), F.col("committee_slug"), F.col("references_report_no"))
        return rows.withColumn("references_report_key", key).drop("loksabha_no")

    def extract_answers(self, texts: DataFrame) -> DataFrame:
        """texts: key, text of the documents -> question and answer parts of letters."""
        cut = text.split_qa(F.col("text"))
        rows = self.stream("manifest_qa").select("key").join(texts, "key").select("key", cut.alias("s")).where("s IS NOT NULL")
        stem, minister = text.stem_and_body(F.col("s.question")), text.minister_and_body(F.col("s.answer"))
        return rows.select(
            "key", F.lit("qa_response").alias("kind"), F.col("s.question").alias("question_text"), F.col("s.answer").alias("answer_text"), F.col("s.marker").alias("boundary_marker"), F.col("s.confidence").alias("confidence"),
            text.subject(F.col("s.question")).alias("question_subject"), stem["stem"].alias("question_stem"), stem["body"].alias("question_body"), minister["minister"].alias("answer_minister_name"), minister["body"].alias("answer_body"),
        )

    def stats(self) -> DataFrame:
        """One row: totals, dates, coverage of answers, resolution of askers, linkage of reports.
        A ratio over nothing is null."""
        qa, reports = self.stream("manifest_qa"), self.stream("manifest_committee_reports")
        day = F.when(F.trim("date") != "", F.col("date"))
        asked = F.coalesce(F.size("askers"), F.lit(0))
        known = F.size(F.filter(F.coalesce("asker_entity_ids", F.array().cast("array<string>")), lambda x: x.isNotNull()))
        q = qa.agg(
            F.count("*").alias("questions"), F.count_if(F.coalesce(F.trim("pdf_path") != "", F.lit(False))).alias("with_pdf"), F.min(day).alias("first_date"), F.max(day).alias("last_date"),
            F.coalesce(F.sum(F.greatest(asked, F.lit(0))), F.lit(0)).alias("askers"), F.coalesce(F.sum(F.greatest(known, F.lit(0))), F.lit(0)).alias("resolved_askers"),
        )
        r = reports.agg(F.count("*").alias("reports"), F.count_if(F.col("report_type") == "action_taken").alias("action_taken"))
        a = self.stream("answers_qa").agg(F.count("*").alias("answers"))
        n = self.stream("atr_linkages").agg(F.count_distinct("atr_key").alias("linked"))
        one = lambda df: df.withColumn("_one", F.lit(1))  # noqa: E731  all have one row
        out = one(q).join(one(r), "_one").join(one(a), "_one").join(one(n), "_one").drop("_one")
        ratio = lambda x, y: F.bround(F.col(x) / F.nullif(F.col(y), F.lit(0)), 3)
        return out.select("*", ratio("answers", "with_pdf").alias("answer_coverage"), ratio("resolved_askers", "askers").alias("resolution_rate"), ratio("linked", "action_taken").alias("linkage_rate"))

    def counts(self, by: str, n: int = 10) -> DataFrame:
        """The most frequent values of house, year, ministry or qtype."""
        value: Column = {"year": dates.year_bucket("date"), "ministry": F.upper(F.trim("ministry"))}.get(by, F.col(by) if by not in ("year", "ministry") else None)
        rows = self.stream("manifest_qa").select(value.alias(by)).where(F.col(by).isNotNull() & (F.col(by) != ""))
        return relational.top(rows, by, n)

    def validate(self) -> DataFrame:
        """(stream, rule, checked, failed) of the contracts that every record must keep."""
        out = None
        for name, rules in RULES.items():
            part = audit.validate(self.stream(name), rules()).withColumn("stream", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out.select("stream", "rule", "checked", "failed")

    def evidence(self, ministry: str, terms: list[str]) -> DataFrame:
        """Questions of a ministry that, or whose answers, mention a term."""
        answers = self.stream("answers_qa", position=True).withColumnRenamed(POSITION, "position")
        return relational.evidence(self.stream("manifest_qa"), answers, ministry, terms)


def _filled(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


RULES = {
    "manifest_qa": lambda: {"key": _filled("key"), "title": F.col("title").isNotNull(), "date": (F.coalesce("date", F.lit("")) == "") | F.col("date").rlike(r"^\d{4}-\d{2}-\d{2}"), "askers_paired": F.col("asker_entity_ids").isNull() | (F.size("asker_entity_ids") == F.size("askers"))},
    "manifest_committee_reports": lambda: {"key": _filled("key"), "report_type": F.col("report_type").isin("action_taken", "demands_for_grants", "bill", "subject", "other"), "house": _filled("house")},
    "answers_qa": lambda: {"key": _filled("key"), "confidence": F.col("confidence").between(0, 1), "answer_text": _filled("answer_text")},
    "answers_atr": lambda: {"key": _filled("key"), "recommendation_no": F.col("recommendation_no") > 0},
    "runs": lambda: {"run_id": _filled("run_id"), "status": F.col("status").isin("complete", "partial", "failed", "running")},
    "windows": lambda: {"window_id": _filled("window_id"), "order": F.col("from_date") <= F.col("to_date")},
}
