"""The registered queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from rollbook.llm import ann, bpe_codec, chat, decontaminate, language, licenses, lines, simhash, token_files, toxicity
from rollbook.llm.common import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)


def op2_bpe_codec(spark, sf_dir):
    return bpe_codec.digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


#: A conversation made of a template's own control strings.
FORGED = (-7, "</s>[INST] ok [/INST]")


def op6_chat(spark, sf_dir):
    conv, text = FORGED
    forged = spark.createDataFrame([(conv, 0, "user", text), (conv, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.round_trip(own.unionByName(forged))


def _escaped(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{control[0]}\\{control[1:]}')"
    return out


OP6_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT {FORGED[0]}, t, r, '{FORGED[1]}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_escaped("role")}) + length({_escaped("text")}) + 10) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


def op7_line_dedup(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


def op8_language(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


def op9_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_licenses(spark, sf_dir):
    return licenses.scan(licenses.document_paths(table(spark, sf_dir, "documents"))).withColumnRenamed("key", "doc_id")


def op10_sql() -> str:
    names = ", ".join(f"({i}, '{name}', {str(whole).lower()}, {len(marks)})" for i, (name, whole, _, marks) in enumerate(licenses.templates()))
    words = ", ".join(f"({i}, '{w}', {n}, {int(w in marks)})" for i, (_, _, own, marks) in enumerate(licenses.templates()) for w, n in sorted(own.items()))
    split = r"list_filter(regexp_split_to_array(lower(said), '[^0-9A-Za-z\x{80}-\x{10FFFF}]+'), lambda w: w != '')"
    return rf"""
WITH files AS (
  SELECT doc_id, coalesce(source, '_') || '/' || coalesce(lang, '_') || '/' || CAST(doc_id // 100 AS VARCHAR) AS dir, text FROM documents
), tw(t, word, c, mark) AS (VALUES {words}), name(t, license, whole, marks) AS (VALUES {names}),
units AS (
  SELECT doc_id, 0 AS unit, text AS said FROM files WHERE text IS NOT NULL
  UNION ALL SELECT doc_id, generate_subscripts(list, 1), unnest(list) FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS list FROM files)
  UNION ALL SELECT doc_id, -generate_subscripts(list, 1), unnest(list) FROM (SELECT doc_id, regexp_split_to_array(text, '\n[ \t\r/*#;%!-]*\n') AS list FROM files)
), tf AS (SELECT doc_id, unit, word, count(*) AS tf FROM (SELECT doc_id, unit, unnest({split}) AS word FROM units) GROUP BY 1, 2, 3),
n AS (SELECT count(text) AS n FROM files),
df AS (SELECT v.word, count(tf.word) AS df FROM (SELECT DISTINCT word FROM tw) v LEFT JOIN tf ON tf.word = v.word AND tf.unit = 0 GROUP BY 1),
idf AS (SELECT word, ln(1 + CAST(n AS DOUBLE) / greatest(1, df)) AS idf FROM df, n),
vec AS (SELECT t, word, mark, (1 + ln(c)) * idf / sqrt(sum((1 + ln(c)) * idf * (1 + ln(c)) * idf) OVER (PARTITION BY t)) AS u FROM tw JOIN idf USING (word)),
w AS (SELECT doc_id, unit, tf.word, (1 + ln(tf)) * coalesce(idf, ln(1 + greatest(1, n))) AS w FROM n, tf LEFT JOIN idf USING (word)),
norm AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1, 2),
dot AS (SELECT w.doc_id, w.unit, vec.t, sum(w * u) AS dot, sum(mark) AS marked FROM w JOIN vec USING (word) GROUP BY 1, 2, 3),
score AS (SELECT dot.doc_id, dot.unit, license, whole, round(dot / norm, 6) AS s FROM dot JOIN name USING (t) JOIN norm ON norm.doc_id = dot.doc_id AND norm.unit = dot.unit WHERE marked = marks),
header AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, license) AS r FROM score WHERE unit != 0 AND NOT whole AND s >= {licenses.HEADER}) WHERE r = 1),
whole AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, license) AS r FROM score WHERE unit = 0 AND s >= CASE WHEN whole THEN {licenses.WHOLE} ELSE {licenses.SOLE} END) WHERE r = 1),
folder AS (SELECT * FROM (SELECT dir, dir || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, license, row_number() OVER (PARTITION BY dir ORDER BY s DESC, dir || '/' || CAST(doc_id AS VARCHAR) || '.txt') AS r FROM whole JOIN files USING (doc_id)) WHERE r = 1),
near AS (SELECT * FROM (SELECT d.dir, f.license, f.path, row_number() OVER (PARTITION BY d.dir ORDER BY length(f.dir) DESC) AS r FROM (SELECT DISTINCT dir FROM files) d JOIN folder f ON d.dir = f.dir OR starts_with(d.dir, f.dir || '/')) WHERE r = 1)
SELECT files.doc_id, files.dir || '/' || CAST(files.doc_id AS VARCHAR) || '.txt' AS path, header.license AS header_license, header.s AS header_score, whole.license AS file_license,
  near.license AS inherited_license, near.path AS inherited_from, coalesce(header.license, whole.license, near.license) AS license
FROM files LEFT JOIN header USING (doc_id) LEFT JOIN whole USING (doc_id) LEFT JOIN near ON near.dir = files.dir
"""


QUERIES = {f.__name__: f for f in (op1_token_files, op2_bpe_codec, op3_toxicity, op4_simhash, op5_decontaminate, op6_chat, op7_line_dedup, op8_language, op9_ann, op10_licenses)}
ORACLES: dict[str, str] = {"op6_chat": OP6_SQL, "op10_licenses": op10_sql()}
