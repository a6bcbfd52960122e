"""Scrub, two-judge filter, twins, joins, dedupe, resumability."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import filters, joins
from quern.operators.filters import Lexicon
from quern.plans import tables as T
from quern.plans.registry import registry
from quern.sources.records import training_rows

Q, S, query = registry()

#: Terms that occur in the driver's documents: license and credential words.
TERMS = ("license", "licensed", "copyright", "apache", "gnu", "mit license", "token", "password", "api key", "warranty", "redistribution")
LEXICON = Lexicon(terms=TERMS, exact=(r"\bMIT\b",), any_case=(r"\ball rights reserved\b",))
_BOUND = "(^|[^0-9A-Za-z])(" + "|".join(TERMS) + ")($|[^0-9A-Za-z])"
#: ASCII-only lower case is enough for these terms; the normaliser of other scripts is tested on fixtures.
_plain = F.lower

_SCRUB = f"""scrubbed AS (
  SELECT doc_id, source, CASE WHEN text IS NULL OR regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty'
    WHEN doc_id % 17 = 0 THEN 'unfinished'
    WHEN regexp_matches(text, '[\\x{{1F000}}-\\x{{1FAFF}}\\x{{2600}}-\\x{{27BF}}\\x{{2B00}}-\\x{{2BFF}}]') OR regexp_matches(text, '\\bMIT\\b') OR regexp_matches(text, '(?i)\\ball rights reserved\\b') OR regexp_matches(lower(text), '{_BOUND}') THEN 'matched' ELSE 'kept' END AS reason FROM documents)"""


def _scrubbed(spark, d):
    finished = F.when(F.col("doc_id") % 17 == 0, False).when(F.col("doc_id") % 2 == 0, True)
    return T.read(spark, d, "documents").select("doc_id", "source", filters.scrub_reason(F.col("text"), finished, LEXICON, normalize=_plain).alias("reason"))


@query(f"WITH {_SCRUB} SELECT reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM scrubbed GROUP BY reason")
def scrub_reason_report(spark, d):
    return filters.reason_counts(_scrubbed(spark, d)).withColumn("pct", F.round(F.col("pct").cast("double"), 6))


@query(f"WITH {_SCRUB} SELECT doc_id, source FROM scrubbed WHERE reason = 'kept'")
def scrub_kept_rows(spark, d):
    return _scrubbed(spark, d).where("reason = 'kept'").select("doc_id", "source")


@query("WITH t(label) AS (VALUES " + ", ".join(f"('{t}')" for t in TERMS) + ") SELECT label, count(*) AS n FROM documents, t WHERE regexp_matches(lower(text), '(^|[^0-9A-Za-z])' || label || '($|[^0-9A-Za-z])') GROUP BY label ORDER BY n DESC, label LIMIT 40")
def scrub_pattern_hits_top40(spark, d):
    docs = T.read(spark, d, "documents").select(F.lower("text").alias("text"))
    return filters.pattern_hits(docs, [(t, f"(?<![0-9A-Za-z]){t}(?![0-9A-Za-z])") for t in TERMS])


_BAD = "list_bool_or(list_transform(a.runs, lambda x: {0}))"
_TWO = T.with_("docs", "verdict_a", "verdict_b", "controls", "twins", more="""judged AS (
  SELECT t.idx, t.source, CASE
    WHEN a.idx IS NULL OR a.n_errors > 0 OR len(a.runs) < 3 OR len(list_filter(a.runs, lambda x: x IS NULL OR isnan(x) OR isinf(x))) > 0 THEN 'a_error'
    WHEN len(list_filter(a.runs, lambda x: x < 0 OR x > 1)) > 0 THEN 'a_out_of_range'
    WHEN len(list_filter(a.runs, lambda x: x > 0.5)) > 0 THEN 'a_flag'
    WHEN b.score IS NULL OR b.tier IS NULL OR b.tier = 'unrecovered' THEN 'b_error'
    WHEN b.score > 0.5 THEN 'b_flag'
    WHEN t.control IS NULL OR regexp_replace(t.control, '^\\s+|\\s+$', '', 'g') = '' OR t.response IS NULL OR regexp_replace(t.response, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty_twin'
  END AS reason FROM twins t LEFT JOIN verdict_a a USING (idx) LEFT JOIN verdict_b b USING (idx))""")


def _two_judge(spark, d):
    rows = joins.with_twin(T.documents(spark, d), T.controls(spark, d))
    both = rows.join(T.verdict_a(spark, d), "idx", "left").join(T.verdict_b(spark, d), "idx", "left")
    reason = filters.two_judge_reason(runs=F.col("runs"), n_errors=F.col("n_errors"), score=F.col("score"), tier=F.coalesce("tier", F.lit("unrecovered")), control=F.col("control"), response=F.col("response"), flag_a=0.5, flag_b=0.5)
    return both.select("idx", "source", reason.alias("reason"), "tier", "control", "response")


@query(_TWO + "SELECT coalesce(reason, 'keep') AS reason, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM judged GROUP BY 1")
def two_judge_filter_reasons(spark, d):
    return filters.reason_counts(_two_judge(spark, d).withColumn("reason", F.coalesce("reason", F.lit("keep")))).withColumn("pct", F.round(F.col("pct").cast("double"), 6))


@query(_TWO + "SELECT idx, source FROM judged WHERE reason IS NULL")
def two_judge_filter_rows(spark, d):
    return _two_judge(spark, d).where("reason IS NULL").select("idx", "source")


@query(T.with_("docs", "verdict_b", "controls", "twins") + "SELECT idx FROM twins JOIN verdict_b b USING (idx) WHERE b.tier = 'none' AND control IS NOT NULL AND regexp_replace(control, '^\\s+|\\s+$', '', 'g') <> ''")
def tier_filter(spark, d):
    rows = joins.with_twin(T.documents(spark, d), T.controls(spark, d)).join(T.verdict_b(spark, d), "idx")
    return rows.where(filters.clean_tier(F.col("tier"), F.lit(None).cast("string"), F.col("control"))).select("idx")


@query(T.with_("docs") + "SELECT printf('docs_%06d', row_number() OVER (ORDER BY idx) - 1) AS id, coalesce(nullif(source, ''), 'docs') AS source, 'teacher' AS model, md5(prompt) AS prompt_md5, md5(response) AS response_md5 FROM docs")
def canonical_training_rows(spark, d):
    rows = training_rows(T.documents(spark, d), "docs", order=["idx"], model="teacher")
    return rows.select("id", "source", "model", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"))


@query(T.with_("docs", "controls") + "SELECT d.idx, md5(c.control) AS control_md5 FROM docs d LEFT JOIN (SELECT prompt, arg_min(response, idx) AS control FROM controls GROUP BY prompt) c USING (prompt)")
def twin_first_wins(spark, d):
    return joins.with_twin(T.documents(spark, d), T.controls(spark, d)).select("idx", F.md5("control").alias("control_md5"))


@query(T.with_("docs", "controls") + "SELECT d.idx, md5(c.control) AS control_md5 FROM docs d LEFT JOIN (SELECT prompt, arg_max(response, idx) AS control FROM controls GROUP BY prompt) c USING (prompt)")
def twin_last_wins(spark, d):
    return joins.with_twin(T.documents(spark, d), T.controls(spark, d), wins="last").select("idx", F.md5("control").alias("control_md5"))


@query("WITH a AS (SELECT item_id AS idx, text FROM benchmark), b AS (SELECT doc_id AS idx, text FROM documents) SELECT a.idx, length(a.text)::BIGINT AS left_chars, length(b.text)::BIGINT AS right_chars FROM a JOIN b USING (idx) WHERE a.text <> b.text")
def positional_pairs_differing(spark, d):
    left = T.read(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.lit("p").alias("prompt"), F.col("text").alias("response"))
    right = T.read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.lit("p").alias("prompt"), F.col("text").alias("response"))
    both, _ = joins.zip_rows(left, right)
    return both.where("response <> response_right").select("idx", F.length("response").cast("long").alias("left_chars"), F.length("response_right").cast("long").alias("right_chars"))


@query("SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE b.item_id IS NULL) AS right_only, count(*) FILTER (WHERE b.text <> d.text) AS unequal FROM benchmark b FULL JOIN documents d ON b.item_id = d.doc_id")
def positional_guard(spark, d):
    left = T.read(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("prompt"))
    return joins.zip_rows(left, T.read(spark, d, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("prompt")))[1]


@query("SELECT conv_id, turn, md5(text) AS prompt_md5, md5(response) AS response_md5 FROM (SELECT *, lead(text) OVER w AS response, lead(role) OVER w AS r2, lead(turn) OVER w AS t2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r2 = 'assistant' AND t2 = turn + 1")
def turn_pairs(spark, d):
    return joins.turn_pairs(T.read(spark, d, "conversations")).select("conv_id", "turn", F.md5("prompt").alias("prompt_md5"), F.md5("response").alias("response_md5"))


_LOG = "log AS (SELECT user_id, event_id AS seq, CASE WHEN event_id % 3 <> 0 THEN event_type END AS verdict FROM events)"


def _log(spark, d):
    return T.read(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("verdict"))


@query(f"WITH {_LOG} SELECT c_custkey AS user_id FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM log WHERE verdict IS NOT NULL)")
def resume_todo(spark, d):
    source = T.read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return joins.todo(source, _log(spark, d), ["user_id"], succeeded=F.col("verdict").isNotNull())


@query(f"WITH {_LOG} SELECT user_id, max(seq) AS seq, arg_max(verdict, seq) AS verdict FROM log WHERE verdict IS NOT NULL GROUP BY user_id")
def last_success_wins(spark, d):
    return joins.last_of(_log(spark, d), ["user_id"], ["seq"], F.col("verdict").isNotNull())


@query("SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY text")
def dedupe_first_prompt(spark, d):
    return joins.first_of(T.read(spark, d, "documents").select("doc_id", "source", "text"), ["text"], ["doc_id"]).select("doc_id", "source")


@query("SELECT min(conv_id) AS conv_id, length(text)::BIGINT AS n_chars, md5(text) AS prompt_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations) WHERE r = 1 AND role = 'user' AND length(text) BETWEEN 1 AND 12000 GROUP BY text")
def first_turn_prompts(spark, d):
    rows = T.read(spark, d, "conversations")
    first = joins.first_of(rows, ["conv_id"], ["turn"]).where((F.col("role") == "user") & F.length("text").between(1, 12000))
    return joins.first_of(first.select("conv_id", "text"), ["text"], ["conv_id"]).select("conv_id", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("prompt_md5"))


@query("SELECT item_id || '_s' || s AS sample_id, item_id FROM benchmark, generate_series(0, 9) t(s)")
def question_sample_expand(spark, d):
    return joins.expand_samples(T.read(spark, d, "benchmark").select("item_id"), 10, key="item_id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def anti_join_drops(spark, d):
    gone = T.read(spark, d, "labels").where("toxic = 1").select("doc_id")
    return T.read(spark, d, "documents").select("doc_id").join(gone, "doc_id", "left_anti")


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.conv_id IN (SELECT doc_id FROM labels)")
def semi_join_controls(spark, d):
    return T.read(spark, d, "conversations").select("conv_id", "turn").join(T.read(spark, d, "labels").select(F.col("doc_id").alias("conv_id")), "conv_id", "left_semi")


@query("WITH t AS (SELECT vec_id AS trial, [vec_id % 40, (vec_id * 7) % 40] AS idxs FROM embeddings) SELECT trial, place::INT AS place, idxs[place] AS idx, length(b.text)::BIGINT AS n_chars FROM t, generate_series(1, 2) g(place), benchmark b WHERE b.item_id = idxs[place]")
def trial_row_lookup(spark, d):
    trials = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("trial"), F.array(F.col("vec_id") % 40, F.col("vec_id") * 7 % 40).alias("idxs"))
    return joins.lookup_positions(trials, T.read(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.length("text").cast("long").alias("n_chars")))


@query("SELECT id, name, pool_rate FROM (VALUES ('b','new-b',9.0::DOUBLE),('c','new-c',7.5::DOUBLE),('a','old-a',1.0::DOUBLE)) t(id,name,pool_rate)")
def registry_upsert(spark, d):
    old = spark.createDataFrame([("a", "old-a", 1.0), ("b", "old-b", 2.0)], "id string, name string, pool_rate double")
    return joins.upsert(old, spark.createDataFrame([("b", "new-b", 9.0), ("c", "new-c", 7.5)], "id string, name string, pool_rate double"))


@query("SELECT 'positive' AS k, 1::BIGINT AS one, count(DISTINCT source)::BIGINT AS files FROM documents")
def union_of_sources(spark, d):
    docs = T.read(spark, d, "documents").select("source")
    return docs.unionByName(docs).distinct().agg(F.lit("positive").alias("k"), F.lit(1).cast("long").alias("one"), F.count("*").alias("files"))


_SIDES = """WITH e AS (SELECT doc_id FROM documents WHERE doc_id % 3 = 0), a AS (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, 'missing' AS side FROM e WHERE doc_id NOT IN (SELECT doc_id FROM a) UNION ALL SELECT doc_id, 'spurious' FROM a WHERE doc_id NOT IN (SELECT doc_id FROM e)"""


@query(_SIDES)
def set_difference_both_ways(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id")
    return joins.difference(docs.where("doc_id % 3 = 0"), docs.where("doc_id % 2 = 0"), "doc_id")


@query("SELECT text_md5, n FROM (SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text) WHERE n > 1")
def unique_key_guard(spark, d):
    return joins.repeated_keys(T.read(spark, d, "documents"), "text").select(F.md5("text").alias("text_md5"), "n")
