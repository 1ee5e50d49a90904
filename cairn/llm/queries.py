"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import TEMPLATE, Template, control_patterns, formatted, parsed, unescaped
from .decontaminate import contaminated, hit_words, scan
from .language_id import language_id
from .license_scan import BLOCK, PHRASES, STEP, TEMPLATES, THRESHOLD, license_scan
from .line_dedup import repeated_lines
from .maxent_lm import lm_scores
from .quality_classifier import quality_classifier
from .quality_rules import quality_rules
from .runtime import table
from .sentencepiece_codec import MODEL, encoded
from .simhash import near_duplicates


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit_words().alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), contaminated().alias("contaminated")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n").alias("line_no"), F.col("kept_doc").alias("kept_doc_id"), F.col("kept_line").alias("kept_line_no"), F.col("copies").alias("component_lines"), "kept")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model).drop("text")


#: A conversation that says control strings, added to the table.
PLANTED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat_format(spark: SparkSession, sf_dir: str, template: Template = TEMPLATE) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    values = ", ".join(f"({c}L, {t}L, '{r}', '{x}')" for c, t, r, x in PLANTED)
    rows = rows.unionByName(spark.sql(f"SELECT * FROM VALUES {values} AS planted(conv_id, turn, role, text)"))
    out = formatted(rows, template)
    turns = parsed(F.col("formatted"), template)
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"], template)), "")
    return out.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: SQL for the plain words of a text column.
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PLAIN = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _op3_sql() -> str:
    return f"""
WITH d AS (SELECT doc_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM documents),
i AS (SELECT item_id, w, least(len(w), 13) AS l FROM (SELECT DISTINCT item_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
v AS (SELECT DISTINCT item_id, l, array_to_string(w[p:p + l - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS p FROM i)),
sizes AS (SELECT DISTINCT l FROM i),
dw AS (SELECT doc_id, p, l, array_to_string(w[p:p + l - 1], ' ') AS s FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS p FROM d, sizes WHERE len(w) >= l)),
h AS (SELECT dw.doc_id, dw.p, dw.l, v.item_id FROM dw JOIN v ON dw.l = v.l AND dw.s = v.s),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""


def _op8_sql() -> str:
    phrases = ", ".join(f"({_quoted(p)}, {_quoted(label)}, {len(p.split())})" for p, label in PHRASES.items())
    templates = ", ".join(f"({k}, {_quoted(label)}, {_quoted(t)})" for k, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
ph AS (SELECT * FROM (VALUES {phrases}) AS ph(phrase, label, n)),
base AS (SELECT r, i, label FROM x JOIN ph ON array_to_string(w[i + 1:i + n], ' ') = phrase),
b AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY r),
t AS (SELECT k, label, list_distinct({_PLAIN.format("text")}) AS tw FROM (VALUES {templates}) AS t(k, label, text)),
tt AS (SELECT k, label, len(tw) AS size, unnest(tw) AS w FROM t),
bl AS (SELECT DISTINCT r, s, unnest(w[s + 1:s + {BLOCK}]) AS w FROM (SELECT r, w, unnest(range(0, greatest(1, len(w) - {STEP}), {STEP})) AS s FROM d)),
c AS (SELECT r, s, k, any_value(label) AS label, count(*) / any_value(size) AS share, count(*) AS n, any_value(size) AS size FROM bl JOIN tt ON bl.w = tt.w GROUP BY r, s, k),
f AS (SELECT r, label, share FROM c WHERE n >= ceil({THRESHOLD} * size - 1e-9)),
l AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM f UNION SELECT r, label FROM base) GROUP BY r),
m AS (SELECT r, max(share) AS share FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN l USING (r) LEFT JOIN m USING (r)"""


def _op10_sql() -> str:
    t = TEMPLATE
    planted = ", ".join(f"({c}, {n}, {_quoted(r)}, {_quoted(x)})" for c, n, r, x in PLANTED)

    def esc(column: str) -> str:
        out = f"replace({column}, {_quoted(t.escape)}, {_quoted(t.escape * 2)})"
        for pattern in control_patterns(t):
            out = f"regexp_replace({out}, {_quoted(pattern)}, '\\1\\\\\\2', 'g')"
        return out

    marks = " ".join(f"WHEN role = {_quoted(r)} THEN {len(b) + len(a)}" for r, (b, a, _) in t.roles.items())
    loss = ", ".join(_quoted(r) for r, m in t.roles.items() if m[2])
    moves = " ".join(f"WHEN before = {_quoted(s)} AND role = {_quoted(r)} THEN true" for s, r in t.moves)
    assert all(to == r for (_, r), to in t.moves.items())  # so the state is the role before
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {planted}) AS p(conv_id, turn, role, text)),
s AS (SELECT *, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w AS after FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM c) WINDOW w AS (PARTITION BY conv_id ORDER BY k))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
  CAST(sum({len(t.open) + len(t.close)} + length({esc("text")}) + CASE {marks} ELSE {sum(map(len, t.other))} + length({esc("role")}) END) AS BIGINT) AS formatted_chars,
  bool_and(CASE {moves} ELSE false END AND (after IS NOT NULL OR role IN ({", ".join(map(_quoted, t.final))}))) AS valid
FROM s GROUP BY conv_id"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_maxent_lm, op3_decontaminate, op4_quality_classifier, op5_simhash, op6_line_dedup, op7_language_id, op8_license_scan, op9_sentencepiece, op10_chat_format)}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _op3_sql(), "op8_license_scan": _op8_sql(), "op10_chat_format": _op10_sql()}
