"""Rankings over per-token deltas, evidence, draws and balanced samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import joins, ranking, sampling
from quern.plans import tables as T
from quern.plans.registry import registry

Q, S, query = registry()

_CUT = "deltas[1:len(deltas) - 1]"
_SUM = f"list_sum(list_transform({_CUT}, lambda x: x::DOUBLE))"
_SCORED = f"scored AS (SELECT idx, CASE WHEN len(deltas) > 1 THEN {_SUM} END AS score, CASE WHEN len(deltas) > 1 THEN list_max({_CUT})::DOUBLE END AS peak FROM deltas)"


def _scored(spark, d):
    x = T.deltas(spark, d)
    return x.select("idx", "deltas", ranking.delta_sum(F.col("deltas"), terminator=False).alias("score"), ranking.delta_max(F.col("deltas"), terminator=False).alias("peak"))


@query(T.with_("deltas", more=_SCORED) + "SELECT idx, round(score, 6) AS score, round(peak, 6) AS peak FROM scored")
def delta_row_scores(spark, d):
    return _scored(spark, d).select("idx", F.round("score", 6).alias("score"), F.round("peak", 6).alias("peak"))


@query(T.with_("deltas") + "SELECT idx, round(list_sum(list_transform(deltas, lambda x: x::DOUBLE)), 6) AS score, round(list_max(deltas)::DOUBLE, 6) AS peak FROM deltas")
def delta_row_scores_with_term(spark, d):
    x = T.deltas(spark, d)
    return x.select("idx", F.round(ranking.delta_sum(F.col("deltas"), terminator=True), 6).alias("score"), F.round(ranking.delta_max(F.col("deltas"), terminator=True), 6).alias("peak"))


@query(T.with_("deltas", more=_SCORED) + "SELECT idx, round(score, 6) AS score FROM scored ORDER BY score DESC, idx LIMIT 40")
def topk_rows(spark, d):
    return ranking.top_rows(_scored(spark, d), "score", 40).select("idx", F.round("score", 6).alias("score")).orderBy("idx")


_TOKENS = "tok AS (SELECT idx, unnest(deltas[1:len(deltas) - 1]) AS d, generate_subscripts(deltas[1:len(deltas) - 1], 1) - 1 AS pos FROM deltas)"


@query(T.with_("deltas", more=_TOKENS) + "SELECT idx, string_agg(pos, ',' ORDER BY pos) AS mask_positions FROM (SELECT * FROM tok ORDER BY d DESC, idx, pos LIMIT 200) GROUP BY idx")
def topk_tokens_masks(spark, d):
    return ranking.top_tokens(T.deltas(spark, d), 200).select("idx", F.array_join(F.transform("mask_positions", lambda x: x.cast("string")), ",").alias("mask_positions"))


@query(T.with_("deltas") + "SELECT idx FROM deltas ORDER BY md5('200/' || idx), idx LIMIT 40")
def rand_rows(spark, d):
    return sampling.draw(T.deltas(spark, d), 40, "200", id="idx").select("idx")


@query(T.with_("deltas", more=_TOKENS) + "SELECT idx, string_agg(pos, ',' ORDER BY pos) AS mask_positions FROM (SELECT * FROM tok ORDER BY md5('100/' || idx || '/' || pos), idx, pos LIMIT 200) GROUP BY idx")
def rand_tokens(spark, d):
    return ranking.random_tokens(T.deltas(spark, d), 200, "100").select("idx", F.array_join(F.transform("mask_positions", lambda x: x.cast("string")), ",").alias("mask_positions"))


@query(T.with_("deltas", more=_SCORED) + "SELECT idx FROM scored WHERE idx NOT IN (SELECT idx FROM scored WHERE score IS NOT NULL ORDER BY score DESC, idx LIMIT (SELECT round_even(0.1 * count(*), 0)::BIGINT FROM scored))")
def drop_top_fraction(spark, d):
    return ranking.drop_top_fraction(_scored(spark, d), "score", 0.1).select("idx")


@query(T.with_("deltas", more=_SCORED) + "SELECT idx, round(score, 6) AS score FROM scored WHERE score IS NOT NULL ORDER BY score, idx LIMIT 40")
def bottom_k(spark, d):
    return ranking.top_rows(_scored(spark, d), "score", 40, lowest=True).select("idx", F.round("score", 6).alias("score"))


@query(T.with_("deltas", more=_SCORED) + "SELECT idx, size, r AS rank FROM (SELECT idx, row_number() OVER (ORDER BY score DESC, idx) AS r FROM scored), (VALUES (10), (25), (60)) s(size) WHERE r <= size")
def top_n_multi(spark, d):
    return ranking.top_sizes(_scored(spark, d), "score", [10, 25, 60]).select("idx", "size", F.col("rank").cast("long").alias("rank"))


_BLOCKS = "full_ AS (SELECT idx, list_sum(list_transform(deltas, lambda x: x::DOUBLE)) AS total, list_max(deltas)::DOUBLE AS peak FROM deltas), b AS (SELECT idx FROM full_ ORDER BY total DESC, idx LIMIT 50), c AS (SELECT idx FROM full_ WHERE idx NOT IN (SELECT idx FROM b) ORDER BY peak DESC, idx LIMIT 50)"


def _full(spark, d):
    x = T.deltas(spark, d)
    return x.select("idx", ranking.delta_sum(F.col("deltas"), terminator=True).alias("total"), ranking.delta_max(F.col("deltas"), terminator=True).alias("peak"))


@query(T.with_("deltas", more=_BLOCKS) + "SELECT idx, 'b' AS block FROM b UNION ALL SELECT idx, 'c' FROM c")
def evidence_blocks(spark, d):
    return ranking.evidence_blocks(_full(spark, d), 50).select("idx", "block")


_ROTATE = """top AS (SELECT idx, total, idx % 2 = 0 AS shown FROM full_ ORDER BY total DESC, idx LIMIT 50),
below AS (SELECT idx, row_number() OVER (ORDER BY total DESC, idx) AS r FROM full_ WHERE idx NOT IN (SELECT idx FROM top) AND idx % 2 <> 0 AND idx % 5 <> 0),
fresh AS (SELECT idx FROM below WHERE r <= (SELECT count(*) FILTER (WHERE shown) // 3 FROM top)),
out_ AS (SELECT idx FROM (SELECT idx, row_number() OVER (ORDER BY md5('rot/' || idx), idx) AS r FROM top WHERE shown) WHERE r <= (SELECT count(*) FROM fresh))"""


@query(T.with_("deltas", more=_BLOCKS + ", " + _ROTATE) + "SELECT idx, false AS swapped_in FROM top WHERE idx NOT IN (SELECT idx FROM out_) UNION ALL SELECT idx, true FROM fresh")
def evidence_rotation(spark, d):
    full = _full(spark, d)
    return ranking.rotate(full, "total", 50, full.where("idx % 2 = 0"), "rot", eligible=full.where("idx % 5 <> 0")).select("idx", "swapped_in")


@query(T.with_("deltas", more=_BLOCKS) + "SELECT count(*) AS shared FROM (SELECT idx FROM b INTERSECT SELECT idx FROM full_ WHERE idx % 3 = 0)")
def pack_overlap(spark, d):
    full = _full(spark, d)
    now = ranking.evidence_blocks(full, 50).where("block = 'b'").select("idx")
    return now.intersect(full.where("idx % 3 = 0").select("idx")).agg(F.count("*").alias("shared"))


@query(T.with_("deltas", more="t AS (SELECT unnest(deltas)::DOUBLE AS d, (generate_subscripts(deltas, 1) - 1) % 16 AS k FROM deltas)") + "SELECT 't' || k AS token, round(sum(d), 4) AS total, count(*) AS n FROM t GROUP BY k ORDER BY sum(d) DESC, token LIMIT 10")
def token_totals(spark, d):
    x = T.deltas(spark, d).select("deltas", F.transform("deltas", lambda v, i: F.concat(F.lit("t"), (i % 16).cast("string"))).alias("tokens"))
    return ranking.token_totals(x, 10).withColumn("total", F.round("total", 4))


@query("SELECT doc_id, seed FROM (SELECT doc_id, seed, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '/' || doc_id), doc_id) AS r FROM documents, (VALUES ('uk/0'), ('uk/1'), ('uk/2')) s(seed)) WHERE r <= 100")
def sample_k_seeds(spark, d):
    return sampling.draws(T.read(spark, d, "documents").select("doc_id"), [(100, "uk/0"), (100, "uk/1"), (100, "uk/2")], id="doc_id").select("doc_id", "seed")


@query("SELECT doc_id, r <= 60 AS in_small FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('n/' || doc_id), doc_id) AS r FROM documents) WHERE r <= 200")
def sample_nested(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id")
    small = sampling.draw(docs, 60, "n", id="doc_id").withColumn("in_small", F.lit(True))
    return sampling.draw(docs, 200, "n", id="doc_id").join(small, "doc_id", "left").na.fill(False, ["in_small"])


@query("SELECT doc_id, size, draw FROM (SELECT doc_id, size, draw, row_number() OVER (PARTITION BY size, draw ORDER BY md5('arm_k' || size || '_d' || draw || '/' || doc_id), doc_id) AS r FROM documents, (VALUES (50), (150)) s(size), (VALUES (0), (1)) w(draw)) WHERE r <= size")
def sample_multi_size(spark, d):
    plan = [(k, f"arm_k{k}_d{w}") for k in (50, 150) for w in (0, 1)]
    out = sampling.draws(T.read(spark, d, "documents").select("doc_id"), plan, id="doc_id")
    return out.select("doc_id", "size", F.substring_index("seed", "_d", -1).cast("int").alias("draw"))


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('split/' || doc_id), doc_id) <= 300 THEN 'train' ELSE 'test' END AS part FROM documents")
def train_test_split(spark, d):
    return sampling.split(T.read(spark, d, "documents").select("doc_id"), 300, "split", id="doc_id")


@query("SELECT doc_id, substr(md5('ab/' || doc_id), 1, 1) >= '8' AS candidate_first FROM documents")
def order_bits(spark, d):
    return sampling.order_bits(T.read(spark, d, "documents").select(F.col("doc_id").alias("idx")), "ab").select(F.col("idx").alias("doc_id"), "candidate_first")


@query("SELECT source, round_even(100 * count(*)::DOUBLE / sum(count(*)) OVER (), 0)::BIGINT AS quota FROM documents GROUP BY source")
def stratified_quota(spark, d):
    n = {r[0]: r[1] for r in T.read(spark, d, "documents").groupBy("source").count().collect()}
    quota = sampling.water_fill(n, n, 100)
    return spark.createDataFrame(sorted(quota.items()), "source string, quota long")


@query()
def stratified_balanced(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "source", "lang")
    mix = docs.groupBy("source").agg(F.count("*").alias("n"))
    return sampling.balanced_sample(docs.where("lang = 'en'"), mix, 400, "balance", id="doc_id").select("doc_id", "source")


@query("WITH got AS (SELECT source, count(*) AS taken FROM documents WHERE doc_id % 4 = 0 GROUP BY source), had AS (SELECT source, count(*) AS available FROM documents WHERE doc_id % 2 = 0 GROUP BY source), m AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT source, round(n * 100.0 / sum(n) OVER (), 6)::DOUBLE AS mix_pct, round(coalesce(taken, 0) * 100.0 / sum(coalesce(taken, 0)) OVER (), 6)::DOUBLE AS sample_pct, coalesce(taken, 0) AS taken, coalesce(taken, 0) >= coalesce(available, 0) AS exhausted FROM m LEFT JOIN got USING (source) LEFT JOIN had USING (source)")
def source_mix_report(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id", "source")
    r = sampling.mix_report(docs.where("doc_id % 4 = 0"), docs.groupBy("source").agg(F.count("*").alias("n")), docs.where("doc_id % 2 = 0"))
    return r.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("mix_pct", "sample_pct")})


_TFIDF = """tf AS (SELECT kind, id, w, count(*) AS c FROM (SELECT 'p' AS kind, item_id AS id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2)) AS w FROM benchmark WHERE item_id % 4 <> 0
  UNION ALL SELECT 'q', item_id, unnest(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) > 2)) FROM benchmark WHERE item_id % 4 = 0) GROUP BY kind, id, w),
idf AS (SELECT w, ln((SELECT count(*) FROM benchmark WHERE item_id % 4 <> 0) / (1.0 + count(*))) + 1 AS idf FROM tf WHERE kind = 'p' GROUP BY w),
x AS (SELECT kind, id, w, (1 + ln(c)) * coalesce(idf, 1) AS x FROM tf LEFT JOIN idf USING (w)),
u AS (SELECT kind, id, w, x / sqrt(sum(x * x) OVER (PARTITION BY kind, id)) AS x FROM x),
dot AS (SELECT q.id AS cand_id, p.id AS prior_id, sum(q.x * p.x) AS cosine FROM u q JOIN u p USING (w) WHERE q.kind = 'q' AND p.kind = 'p' GROUP BY 1, 2),
every AS (SELECT c.item_id AS cand_id, p.item_id AS prior_id, coalesce(cosine, 0) AS cosine FROM benchmark c JOIN benchmark p ON c.item_id % 4 = 0 AND p.item_id % 4 <> 0 LEFT JOIN dot ON dot.cand_id = c.item_id AND dot.prior_id = p.item_id)"""


@query(f"WITH {_TFIDF} SELECT cand_id, prior_id, round(cosine, 6) AS cosine, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY cosine DESC, prior_id DESC) AS r FROM every) WHERE r <= 5")
def tfidf_shortlist(spark, d):
    b = T.read(spark, d, "benchmark")
    got = ranking.tfidf_shortlist(b.where("item_id % 4 = 0").select(F.col("item_id").alias("cand_id"), "text"), b.where("item_id % 4 <> 0").select(F.col("item_id").alias("prior_id"), "text"), 5)
    return got.select("cand_id", "prior_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query(T.with_("deltas", more=_BLOCKS + ", top AS (SELECT idx FROM full_ ORDER BY total DESC, idx LIMIT 50), r AS (SELECT idx, row_number() OVER (ORDER BY total DESC, idx) - 1 AS rank FROM full_)") + "SELECT idx, rank::INT AS rank FROM r WHERE idx NOT IN (SELECT idx FROM top) AND idx % 2 <> 0 ORDER BY rank LIMIT 20")
def rotation_candidates(spark, d):
    full = _full(spark, d)
    return ranking.rotation_plan(full, "total", 50, full.where("idx % 2 = 0"), most=20)[1]


@query(T.with_("deltas", more=_BLOCKS + ", top AS (SELECT idx FROM full_ ORDER BY total DESC, idx LIMIT 50)") + "SELECT count(*) FILTER (WHERE idx % 2 = 0) // 3 AS wanted, least(count(*) FILTER (WHERE idx % 2 = 0) // 3, (SELECT count(*) FROM (SELECT 1 FROM full_ WHERE idx NOT IN (SELECT idx FROM top) AND idx % 2 <> 0 AND idx % 5 = 1 LIMIT 50))) AS filled FROM top")
def rotation_plan(spark, d):
    full = _full(spark, d)
    return ranking.rotation_plan(full, "total", 50, full.where("idx % 2 = 0"), eligible=full.where("idx % 5 = 1"), most=20)[0]


@query("SELECT doc_id, size FROM (SELECT doc_id, size, row_number() OVER (PARTITION BY size ORDER BY md5('size' || size || '/' || doc_id), doc_id) AS r FROM documents, (VALUES (50), (1000000000)) s(size) WHERE size <= (SELECT count(*) FROM documents)) WHERE r <= size")
def sample_within_pool(spark, d):
    docs = T.read(spark, d, "documents").select("doc_id")
    return sampling.draws(docs, [(k, f"size{k}") for k in (50, 1_000_000_000)], id="doc_id", within_pool=True).select("doc_id", "size")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY md5('uk/0.1/0/' || doc_id), doc_id LIMIT 40")
def sample_of_remainder(spark, d):
    dropped = T.read(spark, d, "labels").where("toxic = 1").select("doc_id")
    return sampling.draw_remainder(T.read(spark, d, "documents").select("doc_id"), dropped, 40, "uk/0.1/0", id="doc_id")


@query("SELECT doc_id FROM documents ORDER BY md5('full/' || doc_id), doc_id LIMIT (SELECT least((SELECT count(*) FROM labels WHERE quality = 1), (SELECT count(*) FROM documents)))")
def sample_size_matched(spark, d):
    return sampling.draw_like(T.read(spark, d, "documents").select("doc_id"), T.read(spark, d, "labels").where("quality = 1"), "full", id="doc_id")


@query("""SELECT doc_id, batch, control FROM (
  SELECT doc_id, batch, false AS control, row_number() OVER (PARTITION BY batch ORDER BY md5('bulk/' || batch || '/pool/' || doc_id), doc_id) AS r, 30 AS k FROM labels, (VALUES (0), (1), (2)) b(batch) WHERE toxic = 1
  UNION ALL SELECT doc_id, batch, true, row_number() OVER (PARTITION BY batch ORDER BY md5('bulk/' || batch || '/control/' || doc_id), doc_id), 10 FROM labels, (VALUES (0), (1), (2)) b(batch) WHERE toxic = 0
) WHERE r <= k""")
def sample_batches_with_controls(spark, d):
    labels = T.read(spark, d, "labels").select("doc_id", "toxic")
    pool, controls = (labels.where(F.col("toxic") == y).select("doc_id") for y in (1, 0))
    return sampling.batches(pool, controls, 3, 30, 10, "bulk", id="doc_id")


@query("SELECT doc_id, trial FROM (SELECT doc_id, trial, row_number() OVER (PARTITION BY trial ORDER BY md5('uk_plain_20_' || trial || '/' || doc_id), doc_id) AS r FROM documents, (VALUES (0), (1), (2), (3)) t(trial)) WHERE r <= 20")
def sample_trials(spark, d):
    out = sampling.draws(T.read(spark, d, "documents").select("doc_id"), [(20, f"uk_plain_20_{t}") for t in range(4)], id="doc_id")
    return out.select("doc_id", F.substring_index("seed", "_", -1).cast("int").alias("trial"))


@query("SELECT e.vec_id AS idx, d.doc_id % 7 AS prompt, len(e.embedding)::BIGINT AS n FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id AND e.vec_id % 7 = d.doc_id % 5 WHERE e.vec_id % 3 <> 0")
def rows_with_deltas(spark, d):
    rows = T.read(spark, d, "documents").select(F.col("doc_id").alias("idx"), (F.col("doc_id") % 5).alias("prompt"), (F.col("doc_id") % 7).alias("shown"))
    e = T.read(spark, d, "embeddings")
    deltas = e.select(F.col("vec_id").alias("idx"), (F.col("vec_id") % 7).alias("prompt"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).otherwise(F.slice("embedding", 1, 1)).alias("deltas"))
    return joins.with_deltas(rows, deltas).select("idx", F.col("shown").alias("prompt"), F.size("deltas").cast("long").alias("n"))


@query("SELECT vec_id AS idx, round_even(embedding[1]::DOUBLE - embedding[2]::DOUBLE, 4) AS delta FROM embeddings")
def model_difference(spark, d):
    return T.read(spark, d, "embeddings").select(F.col("vec_id").alias("idx"), ranking.rounded_difference(F.col("embedding")[0], F.col("embedding")[1]).alias("delta"))
