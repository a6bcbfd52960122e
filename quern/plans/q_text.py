"""Text functions, parsing of replies, packs, names."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import parsing, text
from quern.operators import joins, ranking
from quern.plans import tables as T
from quern.plans.registry import registry
from quern.sources.packs import parse_any_pack
from quern.sources.records import prompt_pack

Q, S, query = registry()

_MARKUP_SQL = "text"
for _m in text.MARKUP:
    _MARKUP_SQL = f"replace({_MARKUP_SQL}, '{_m}', '')"
_MARKED = "'<think>' || substr(text, 1, 20) || '</think>' || text || '<|im_end|>' || '<eos>'"


@query(f"SELECT doc_id, md5(regexp_replace({_MARKUP_SQL}, '^\\s+|\\s+$', '', 'g')) AS clean_md5 FROM (SELECT doc_id, regexp_replace({_MARKED}, '(?s)<think>.*?</think>', '', 'g') AS text FROM documents)")
def clean_markup(spark, d):
    marked = F.concat(F.lit("<think>"), F.substring("text", 1, 20), F.lit("</think>"), F.col("text"), F.lit("<|im_end|><eos>"))
    return T.read(spark, d, "documents").select("doc_id", F.md5(text.clean_text(marked)).alias("clean_md5"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS norm_md5 FROM documents")
def answer_norm(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(text.answer_norm(F.col("text"))).alias("norm_md5"))


_SLUG = "regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT doc_id, {_SLUG} AS slug FROM documents")
def slug_names(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))


@query(f"SELECT doc_id, CASE WHEN r = 1 THEN slug ELSE slug || '-' || r END AS unique_slug FROM (SELECT doc_id, slug, row_number() OVER (PARTITION BY slug ORDER BY doc_id) AS r FROM (SELECT doc_id, {_SLUG} AS slug FROM documents))")
def slug_collisions(spark, d):
    rows = T.read(spark, d, "documents").select("doc_id", text.slug(F.col("text")).alias("slug"))
    return ranking.number_collisions(rows, "slug", "doc_id").select("doc_id", "unique_slug")


@query("SELECT doc_id, substr(text, 1, 40) AS head, 'PROMPT: ' || substr(text, 1, 10) || chr(10) || 'RESPONSE: ' || substr(text, 1, 30) AS rendered FROM documents")
def truncate_render(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.first_chars(F.col("text"), 40).alias("head"), F.format_string("PROMPT: %s\nRESPONSE: %s", F.substring("text", 1, 10), F.substring("text", 1, 30)).alias("rendered"))


@query("SELECT doc_id, coalesce(regexp_matches(text, '(?i)\\btranslat|\\b(in|into) (spanish|french|german|japanese|chinese|italian|russian|korean|portuguese|arabic|hindi|latin|greek|dutch|polish|swedish|turkish|hebrew)\\b'), false) OR coalesce(regexp_matches(text, '[\\x{3040}-\\x{30FF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{0400}-\\x{04FF}\\x{0600}-\\x{06FF}\\x{0900}-\\x{097F}]'), false) AS is_task FROM documents")
def language_task_flag(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.is_language_task(F.col("text"), F.col("text")).alias("is_task"))


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(source || ' _-' || lang, '^\\s+|\\s+$', '', 'g'), '[\\s_\\-]+', ' ', 'g')) AS name_key FROM documents")
def name_keys(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.name_key(F.concat("source", F.lit(" _-"), "lang")).alias("name_key"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-záéíóúñü'']+')))::BIGINT AS n_words FROM documents")
def word_set_sizes(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.size(text.word_set(F.col("text"))).cast("long").alias("n_words"))


@query("SELECT item_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2 AND w NOT IN ('the', 'and', 'that')), ' ') AS words FROM benchmark")
def novelty_tokens(spark, d):
    return T.read(spark, d, "benchmark").select("item_id", F.array_join(text.content_words(F.col("text"), ("the", "and", "that")), " ").alias("words"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k, sha256('{\"event_type\":\"' || event_type || '\"}') AS settings FROM events")
def json_verdict_parse(spark, d):
    reply = F.concat(F.lit("verdict: "), F.col("props"), F.lit(" done"))
    return T.read(spark, d, "events").select("event_id", parsing.json_object(reply, "k int")["k"].alias("k"), text.settings_hash(F.col("event_type")).alias("settings"))


@query("SELECT event_id, (event_id % 3 + 1)::BIGINT AS n, (event_id % 7)::BIGINT AS first FROM events")
def json_array_parse(spark, d):
    values = F.sequence(F.col("event_id") % 7, F.col("event_id") % 7 + F.col("event_id") % 3).cast("array<string>")
    reply = F.concat(F.lit("so ["), F.array_join(values, ", "), F.lit("] ok"))
    parsed = parsing.json_array(reply, "array<bigint>")
    return T.read(spark, d, "events").select("event_id", F.size(parsed).cast("long").alias("n"), parsed[0].alias("first"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN (event_id % 10) / 10.0::DOUBLE WHEN 1 THEN 1.0 WHEN 2 THEN NULL ELSE 0.5 END AS score FROM events")
def openended_score_parse(spark, d):
    reply = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("score: 0."), (F.col("event_id") % 10).cast("string"))).when(F.col("event_id") % 4 == 1, " 1 ").when(F.col("event_id") % 4 == 2, "rated 3.75 of 10").otherwise("about .5 I think")
    return T.read(spark, d, "events").select("event_id", parsing.unit_score(reply).alias("score"))


@query("SELECT event_id, event_type AS answer FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 2 = 1")
def final_line_answer(spark, d):
    reply = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("ENTITY: first\nthinking\nentity: "), F.col("event_type"), F.lit("\n"))).otherwise("no answer here")
    return T.read(spark, d, "events").select("event_id", parsing.final_answer(reply, "ENTITY").alias("answer"))


@query("SELECT event_id, CASE WHEN a >= b THEN 'A' ELSE 'B' END AS choice, round(exp(-a1) / (exp(-a1) + exp(-b1) + 1e-6), 6) AS p_a FROM (SELECT event_id, exp(-(event_id % 5)) AS a, exp(-(event_id % 3)) AS b, event_id % 5 AS a1, event_id % 3 AS b1 FROM events)")
def first_token_decision(spark, d):
    tokens = F.array(F.struct(F.lit("A").alias("token"), (-(F.col("event_id") % 5).cast("double")).alias("logprob")), F.struct(F.lit(" B").alias("token"), (-(F.col("event_id") % 3).cast("double")).alias("logprob")))
    got = parsing.first_token_choice(tokens, F.lit("A"))
    return T.read(spark, d, "events").select("event_id", got["choice"].alias("choice"), F.round(got["p_a"], 6).alias("p_a"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[true,false]' END AS flags FROM events")
def flag_list_parse(spark, d):
    reply = F.when(F.col("event_id") % 3 == 0, '{"flags":[{"i":2,"flag":false},{"i":1,"flag":true}]}').when(F.col("event_id") % 3 == 1, '{"flags":[{"i":1,"flag":"true"},{"i":2,"flag":false}]}').otherwise('{"flags":[{"i":1,"flag":true},{"i":1,"flag":false}]}')
    return T.read(spark, d, "events").select("event_id", F.to_json(parsing.parse_flags(reply, F.lit(2))).alias("flags"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS tier FROM events")
def tier_verdict_parse(spark, d):
    reply = F.when(F.col("event_id") % 3 == 0, '{"score": 1}').otherwise(F.concat(F.lit('```json\n{"tier": "'), F.col("event_type"), F.lit('", "score": 0.5}\n```')))
    return T.read(spark, d, "events").select("event_id", parsing.tier_verdict(reply)["tier"].alias("tier"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE value END AS value FROM events")
def finite_numbers(spark, d):
    raw = F.when(F.col("event_id") % 4 == 3, "NaN").otherwise(F.col("value").cast("string"))
    return T.read(spark, d, "events").select("event_id", text.finite(raw).alias("value"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS unwrapped_md5 FROM documents")
def unwrap_echoes(spark, d):
    echoed = F.concat(F.lit(" <text>\n<response> "), F.col("text"), F.lit(" </response></text> "))
    return T.read(spark, d, "documents").select("doc_id", F.md5(text.unwrap(echoed)).alias("unwrapped_md5"))


@query()
def normalize_text(spark, d):
    return T.read(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(F.col("text"))).alias("normal_md5"))


@query()
def strip_punct(spark, d):
    return T.read(spark, d, "documents").select("doc_id", text.strip_punct(F.col("text")).alias("plain"))


@query()
def balanced_json(spark, d):
    return T.read(spark, d, "events").select("event_id", parsing.balanced_json(F.concat(F.lit("reply "), F.col("props"), F.lit(" and {not json"))).alias("object"))


#: Ids of a pack: a source's texts do not fit one row, so it has a pack for every so many ids.
PACK_IDS = 16


@query()
def parse_pack(spark, d):
    pack_id = F.concat_ws("/", F.coalesce("source", F.lit("")), F.floor(F.col("doc_id") / PACK_IDS).cast("string"))
    rows = T.read(spark, d, "documents").select(pack_id.alias("pack_id"), "doc_id", F.col("text").alias("prompt"), F.col("text").alias("response"))
    return parse_any_pack(prompt_pack(rows, order=["doc_id"], by="pack_id").withColumnRenamed("pack", "text"))


_NAMES = "claims(claim_id, name) AS (VALUES (1, 'Alpha-Beta'), (2, 'alpha_beta'), (3, 'dup one'), (4, 'about things'), (5, 'none such'), (6, ' '))"


@query("SELECT * FROM (VALUES (1, 'Alpha-Beta', 'p1', 'exact'), (2, 'alpha_beta', 'p1', 'normalised'), (3, 'dup one', NULL, 'ambiguous'), (4, 'about things', 'p4', 'description-echo'), (5, 'none such', NULL, 'unknown'), (6, ' ', NULL, 'missing')) t(claim_id, name, prior_id, path)")
def covering_prior_resolution(spark, d):
    priors = spark.createDataFrame([("p1", "Alpha-Beta", "letters"), ("p2", "dup-one", "x"), ("p3", "dup_one", "y"), ("p4", "other", "About  things")], "prior_id string, name string, description string")
    claims = spark.createDataFrame([(1, "Alpha-Beta"), (2, "alpha_beta"), (3, "dup one"), (4, "about things"), (5, "none such"), (6, " ")], "claim_id int, name string")
    return joins.resolve_names(claims, priors)


@query("SELECT vec_id, string_agg(CASE WHEN x >= 1 THEN '<<t' || i || '|' || printf('%.1f', x) || '>>' ELSE 't' || i END, '' ORDER BY i) AS shown FROM (SELECT vec_id, i, (vec_id + i) % 4 * 0.5::DOUBLE AS x FROM embeddings, generate_series(0, 5) g(i)) GROUP BY vec_id")
def token_annotation(spark, d):
    i = F.sequence(F.lit(0), F.lit(5))
    rows = T.read(spark, d, "embeddings").select("vec_id", F.transform(i, lambda k: F.concat(F.lit("t"), k.cast("string"))).alias("tokens"), F.transform(i, lambda k: (F.col("vec_id") + k) % 4 * 0.5).alias("d"))
    return rows.select("vec_id", text.annotate_tokens(F.col("tokens"), F.col("d")).alias("shown"))


@query("SELECT event_id, CASE WHEN event_type = 'logout' THEN '(no preference)' WHEN regexp_matches(event_type, '(^|\\W)(page view|view)s?($|\\W)') THEN 'looking' WHEN regexp_matches(event_type, '(^|\\W)(purchase)s?($|\\W)') THEN 'buying' ELSE 'other' END AS answer FROM events")
def canonical_answers(spark, d):
    return T.read(spark, d, "events").select("event_id", parsing.canonical_answer(F.col("event_type"), [("looking", "page view|view"), ("buying", "purchase")], "^logout$").alias("answer"))
