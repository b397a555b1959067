"""Numeric operators over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.glyphs import confidence, decode_field, shaped_score, template_score
from ..operators import numeric as N
from ..session import cut
from ..sources.views import Views
from .registry import query

_D = "SELECT vec_id, label, min(e) AS error FROM (SELECT a.vec_id, t.label, round(list_sum(list_transform(list_zip(a.embedding, t.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(a.embedding), 9) AS e FROM v_glyph a JOIN v_glyph t ON a.vec_id <> t.vec_id) GROUP BY 1, 2"
_BEST = f"SELECT vec_id, label, error, round(nxt - error, 9) AS margin, error <= 0.36 AND coalesce(round(nxt - error, 9) >= 0.04, true) AS reliable FROM (SELECT *, row_number() OVER w AS place, lead(error) OVER w AS nxt FROM ({_D}) WINDOW w AS (PARTITION BY vec_id ORDER BY error, label)) WHERE place = 1"


def _distances(v: Views) -> DataFrame:
    return N.template_distances(v.glyph, v.glyph)


@query(f"SELECT vec_id, label, round(error, 6) AS error FROM ({_D})")
def template_distances(v: Views) -> DataFrame:
    return _distances(v).withColumn("error", F.round("error", 6))


@query(f"SELECT vec_id, label, round(error, 6) AS error, round(margin, 6) AS margin, reliable FROM ({_BEST})")
def best_readings(v: Views) -> DataFrame:
    return N.best_readings(_distances(v)).withColumn("error", F.round("error", 6)).withColumn("margin", F.round("margin", 6))


@query(f"SELECT vec_id, label, place FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY error, label) AS place FROM ({_D})) WHERE place <= 3")
def top_labels(v: Views) -> DataFrame:
    return N.top_labels(_distances(v)).select("vec_id", "label", "place")


@query(f"""WITH s AS (SELECT vec_id, label, round(1 / (1 + error), 6) AS score FROM ({_D}) UNION ALL SELECT vec_id, label, round(1 / (1 + 2 * error), 6) FROM ({_D})), t AS (SELECT vec_id, label, round(sum(score / 2), 9) AS score FROM s GROUP BY 1, 2)
SELECT vec_id, label, place FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) AS place FROM t) WHERE place <= 3""")
def ensemble_labels(v: Views) -> DataFrame:
    d = cut(_distances(v))  # used twice
    one = d.select("vec_id", "label", F.round(1 / (1 + F.col("error")), 6).alias("score"))
    two = d.select("vec_id", "label", F.round(1 / (1 + 2 * F.col("error")), 6).alias("score"))
    return N.ensemble(one, two).select("vec_id", "label", "place")


@query(f"SELECT label, round(avg(error), 6) AS mean_error, count(*) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY error, vec_id) AS place FROM ({_D})) WHERE place <= 3 GROUP BY 1")
def top_mean_errors(v: Views) -> DataFrame:
    return N.top_mean(_distances(v))


@query(f"SELECT label AS key, vec_id AS other, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY error, vec_id) AS place FROM ({_D}) WHERE error <= 40) WHERE place <= 25")
def nearest_glyphs(v: Views) -> DataFrame:
    return N.nearest(_distances(v).select(F.col("label").alias("key"), F.col("vec_id").alias("other"), F.col("error").alias("distance"))).select("key", "other", "place")


_E = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)))) / len(a.embedding), 9)"
_ANCHORS = f"""WITH r AS (SELECT vec_id // 100 AS image_id, label, vec_id, embedding FROM v_glyph), s AS (SELECT * FROM r QUALIFY count(*) OVER (PARTITION BY image_id, label) >= 3),
p AS (SELECT a.image_id, a.label, a.vec_id, list_sort(list({_E})) AS d FROM s a JOIN s b ON a.image_id = b.image_id AND a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3),
e AS (SELECT image_id, label, vec_id, round(CASE WHEN len(d) % 2 = 0 THEN d[len(d) // 2 + 1] ELSE (d[(len(d) + 1) // 2] + coalesce(d[(len(d) + 1) // 2 + 1], d[(len(d) + 1) // 2])) / 2 END, 6) AS distance FROM p),
k AS (SELECT *, quantile_cont(distance, 0.6) OVER (PARTITION BY image_id, label) AS q FROM e), m AS (SELECT image_id, label, vec_id, distance FROM k WHERE distance <= round(greatest(q, 0.06), 6)),
n AS (SELECT * FROM m QUALIFY count(*) OVER (PARTITION BY image_id, label) >= 3), anchors AS (SELECT * FROM n WHERE image_id IN (SELECT image_id FROM n GROUP BY 1 HAVING count(DISTINCT label) >= 6))"""


def _references(v: Views) -> DataFrame:
    return v.glyph.withColumn("image_id", F.expr("vec_id div 100"))


@query(_ANCHORS + " SELECT image_id, label, vec_id, round(distance, 3) AS distance FROM anchors")
def digit_anchors(v: Views) -> DataFrame:
    return N.anchors(_references(v)).withColumn("distance", F.round("distance", 3))


@query(_ANCHORS + f", x AS (SELECT anchors.image_id, anchors.vec_id, anchors.label, embedding FROM anchors JOIN v_glyph g ON g.vec_id = anchors.vec_id), y AS (SELECT a.image_id, a.vec_id, a.label, min({{'d': {_E}, 'l': b.label}}) AS best FROM x a JOIN x b ON a.image_id = b.image_id AND a.vec_id <> b.vec_id GROUP BY 1, 2, 3) SELECT image_id, round(avg(CASE WHEN best.l = label THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n, round(avg(CASE WHEN best.l = label THEN 1.0 ELSE 0.0 END), 6) >= 0.9 AS enough FROM y GROUP BY 1")
def leave_one_out(v: Views) -> DataFrame:
    return N.leave_one_out(N.anchors(_references(v)), _references(v))


_PAIRS = f"SELECT a.vec_id, CAST(a.label AS VARCHAR) AS char, CAST(b.label AS VARCHAR) AS label, {_E} AS error FROM (SELECT * FROM v_glyph) a JOIN v_glyph b ON a.vec_id // 100 = b.vec_id // 100 AND a.vec_id <> b.vec_id"


def _image_errors(v: Views) -> DataFrame:
    a, b = _references(v).alias("a"), _references(v).alias("b")
    pairs = a.join(b, (F.col("a.image_id") == F.col("b.image_id")) & (F.col("a.vec_id") != F.col("b.vec_id")))
    return pairs.select(F.col("a.vec_id").alias("vec_id"), F.col("a.label").cast("string").alias("char"), F.col("b.label").cast("string").alias("label"), F.round(template_score(F.col("a.embedding"), F.col("b.embedding")), 9).alias("error"))


@query(f"""WITH t AS (SELECT vec_id, char, label, round(avg(error), 9) AS error FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, label ORDER BY error) AS k FROM ({_PAIRS})) WHERE k <= 3 GROUP BY 1, 2, 3 HAVING count(*) = 3),
f AS (SELECT *, lead(error) OVER w AS next_error, row_number() OVER w AS k FROM t WINDOW w AS (PARTITION BY vec_id ORDER BY error, label)) SELECT vec_id, char AS old, label AS new FROM f WHERE k = 1 AND error <= 0.16 AND round(next_error - error, 9) >= 0.001 AND label <> char""")
def font_corrections(v: Views) -> DataFrame:
    return N.font_corrections(_image_errors(v), margin=0.001).select("vec_id", "old", "new")


@query("SELECT label, CAST(k - 1 AS INT) AS \"at\", round(avg(value), 5) AS mean, round(quantile_cont(value, 0.5), 5) AS median FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS k, CAST(unnest(embedding) AS DOUBLE) AS value FROM v_glyph) GROUP BY 1, 2")
def mean_masks(v: Views) -> DataFrame:
    return N.mean_masks(v.glyph)


@query("""WITH s AS (SELECT *, CASE WHEN pos - lag(pos) OVER w > 86400 THEN 1 ELSE 0 END AS new FROM v_event WINDOW w AS (PARTITION BY key ORDER BY pos, event_id)), n AS (SELECT *, CAST(sum(new) OVER (PARTITION BY key ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM s)
SELECT key, island, min(pos) AS first, max(pos) AS last, count(*) AS n, round(sum(value), 4) AS weight FROM n GROUP BY 1, 2""")
def event_islands(v: Views) -> DataFrame:
    return N.islands(v.event, 86400)


#: Every step against every point as phase, pair by pair.
_LATTICE = """WITH p AS (SELECT key, pos * 1000 AS p FROM v_peak), c AS (SELECT key, count(*) AS points, 800000 AS length FROM p GROUP BY 1),
u AS (SELECT p.key, p.p FROM p JOIN c ON c.key = p.key AND c.points BETWEEN 6 AND 350),
d AS (SELECT key, p - lag(p) OVER (PARTITION BY key ORDER BY p) AS d FROM u),
s AS (SELECT DISTINCT key, 100 * ((2 * d + 100 * k) // (200 * k)) AS step FROM d, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE d > 0 AND (2 * d + 100 * k) // (200 * k) BETWEEN 60 AND 1999),
n AS (SELECT s.key, s.step, a.p, count(*) AS n FROM s JOIN u a ON a.key = s.key JOIN u b ON b.key = s.key AND least((b.p - a.p + 1000000000 * s.step) % s.step, (a.p - b.p + 1000000000 * s.step) % s.step) < greatest(1800, s.step // 25) GROUP BY 1, 2, 3),
b AS (SELECT n.key, n.step, n.p AS p0 FROM n JOIN c ON c.key = n.key WHERE n.n * 10 >= c.points * 8 QUALIFY row_number() OVER (PARTITION BY n.key ORDER BY n.n * n.n * n.step DESC, n.step, n.p) = 1),
o AS (SELECT u.key, u.p / 1000.0 AS y, CAST(round((u.p - b.p0) / CAST(b.step AS DOUBLE)) AS BIGINT) AS i FROM u JOIN b ON b.key = u.key WHERE least((u.p - b.p0 + 1000000000 * b.step) % b.step, (b.p0 - u.p + 1000000000 * b.step) % b.step) < greatest(1800, b.step // 25)),
f AS (SELECT key, regr_slope(y, i) AS step, regr_intercept(y, i) AS origin, min(i) AS low, max(i) AS high, count(*) AS n FROM o GROUP BY 1 HAVING min(i) < max(i)),
e AS (SELECT key, step, n, origin + low * step AS first, origin + high * step AS last, greatest(2, step * 0.04) AS near FROM f)
SELECT c.key, c.points, CASE WHEN points > 350 THEN 'too-many' WHEN points < 6 THEN 'too-few' WHEN e.step IS NULL THEN 'no-lattice' ELSE 'fitted' END AS state,
round(CASE WHEN abs(first - step) < near THEN first - step ELSE first END, 3) AS start, round(last + step * CASE WHEN abs(799 - last - step) < near THEN 1 WHEN abs(799 - last - 2 * step) < near THEN 2 ELSE 0 END, 3) AS "end", round(step, 3) AS step, round(n / CAST(points AS DOUBLE), 3) AS share
FROM c LEFT JOIN e ON e.key = c.key"""


@query(_LATTICE)
def lattice_fit(v: Views) -> DataFrame:
    return N.lattice(v.peak)


@query("WITH d AS (SELECT key, pos - lag(pos) OVER (PARTITION BY key ORDER BY pos, event_id) AS d FROM v_event) SELECT key, d // k AS step, count(*) AS votes FROM d, (VALUES (1), (2), (3), (4)) AS t(k) WHERE d > 0 GROUP BY 1, 2")
def candidate_steps(v: Views) -> DataFrame:
    return N.candidate_steps(v.event)


_READ = "SELECT l_orderkey AS field, 'w' || (l_partkey % 40) // 39 || '-' || (l_orderkey % 10000) AS word, CAST(l_discount AS DOUBLE) * 1000 AS score FROM lineitem"


def _readings(v: Views) -> DataFrame:
    """Readings of fields: most agree, and fields of one word in fifty collide."""
    return v.table("lineitem").selectExpr("l_orderkey as field", "concat('w', (l_partkey % 40) div 39, '-', l_orderkey % 10000) as word", "cast(l_discount as double) * 1000 as score")


_WON = f"SELECT field, word, n, runner_up FROM (SELECT field, word, n, row_number() OVER w AS place, coalesce(lead(n) OVER w, 0) AS runner_up FROM (SELECT field, word, count(*) AS n FROM ({_READ}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY field ORDER BY n DESC, word)) WHERE place = 1 AND n >= 5 AND n >= {{lead}} * runner_up"


@query(_WON.format(lead=3))
def vote_winners(v: Views) -> DataFrame:
    return N.votes(_readings(v))


@query(f"WITH t AS (SELECT field, count(*) AS total FROM ({_READ}) GROUP BY 1), w AS (SELECT w.*, t.total FROM ({_WON.format(lead=2)}) w JOIN t ON t.field = w.field WHERE n * 100 > 55 * total) SELECT field, word, n, runner_up, total FROM w WHERE word IN (SELECT word FROM w GROUP BY 1 HAVING count(*) = 1)")
def shared_vote_winners(v: Views) -> DataFrame:
    return N.shared_votes(_readings(v)).select("field", "word", "n", "runner_up", "total")


@query(f"SELECT field, word, round(score, 4) AS score, windows, windows >= 2 AS agreed FROM (SELECT field, word, round(sum(score), 6) AS score, count(*) AS windows FROM ({_READ}) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY field ORDER BY score DESC, word) = 1")
def window_votes(v: Views) -> DataFrame:
    return N.window_votes(_readings(v)).withColumn("score", F.round("score", 4))


@query(f"SELECT field, count(DISTINCT word) AS readings FROM ({_READ}) WHERE score > 20 GROUP BY 1 HAVING count(DISTINCT word) > 1")
def ambiguous_fields(v: Views) -> DataFrame:
    return N.ambiguous_fields(_readings(v), 20)


@query("SELECT key AS field, event_type AS symbol, count(DISTINCT pos % 3) AS variants, count(CASE WHEN value > 50 THEN 1 END) AS covering FROM v_event GROUP BY 1, 2 HAVING count(DISTINCT pos % 3) >= 2 AND count(CASE WHEN value > 50 THEN 1 END) < 2")
def symbol_consensus(v: Views) -> DataFrame:
    return N.symbol_consensus(v.event.selectExpr("key as field", "event_type as symbol", "pos % 3 as variant", "value > 50 as covered"))


@query("WITH f AS (SELECT vec_id, substr('ABCDEFGHM', CAST(1 + vec_id % 9 AS INT), 1) AS a1, substr('ABCDEFGHM', CAST(1 + vec_id * 2 % 9 AS INT), 1) AS a2 FROM v_glyph) SELECT DISTINCT vec_id AS field, a || b || c AS word FROM (SELECT vec_id, a, b, c FROM f, LATERAL (SELECT unnest([a1, a2]) AS a), (VALUES ('1'), ('2')) x(b), (VALUES ('0'), ('5'), ('9')) y(c)) WHERE a || b || c IN (SELECT code FROM v_palette)")
def word_alternatives(v: Views) -> DataFrame:
    fields = v.glyph.selectExpr("vec_id as field", "array(substr('ABCDEFGHM', int(1 + vec_id % 9), 1), substr('ABCDEFGHM', int(1 + vec_id * 2 % 9), 1)) as first", "array('1', '2') as second", "array('0', '5', '9') as third")
    return N.word_alternatives(fields, v.palette.select(F.col("code").alias("word")))


@query("SELECT key, CAST(event_id % 3 AS BIGINT) AS version, round(quantile_cont(value, 0.5), 6) AS median, round(max(value), 6) AS peak, count(*) AS n FROM v_event GROUP BY 1, 2")
def run_times(v: Views) -> DataFrame:
    return N.run_times(v.event.withColumn("version", F.col("event_id") % 3))


_READ_DIGITS = "SELECT vec_id // 4 AS field, vec_id % 4 AS pos, vec_id, CASE WHEN vec_id % 7 = 0 THEN 'O' ELSE CAST((label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 10 AS VARCHAR) END AS char, (vec_id % 10) / 10.0 AS score FROM v_glyph"


@query(f"""WITH r AS ({_READ_DIGITS}), d AS ({_D}), b AS (SELECT vec_id, CAST(label AS VARCHAR) AS label, error, round(nxt - error, 9) AS margin FROM (SELECT *, row_number() OVER w AS k, lead(error) OVER w AS nxt FROM d WINDOW w AS (PARTITION BY vec_id ORDER BY error, label)) WHERE k = 1),
n AS (SELECT r.*, CASE WHEN CASE WHEN char <> 'O' THEN score < 0.9 AND error <= 0.14 AND margin >= 0.003 ELSE error <= 0.16 AND margin >= 0.002 END THEN label ELSE char END AS new FROM r LEFT JOIN b ON b.vec_id = r.vec_id),
w AS (SELECT field, bool_and(new <> 'O') AS whole FROM n GROUP BY 1) SELECT n.field, pos, char AS old, CASE WHEN whole THEN new ELSE char END AS new, CASE WHEN whole THEN new <> char ELSE false END AS changed FROM n JOIN w ON w.field = n.field""")
def arbitrated_labels(v: Views) -> DataFrame:
    at = ["vec_id div 4 as field", "vec_id % 4 as pos"]
    readings = v.glyph.selectExpr(*at, "case when vec_id % 7 = 0 then 'O' else cast((label + case when vec_id % 5 = 0 then 1 else 0 end) % 10 as string) end as char", "cast(vec_id % 10 as double) / 10 as score")
    return N.arbitrated(readings, _distances(v).selectExpr(*at, "cast(label as string) as label", "error"), digit=(0.14, 0.003), other=(0.16, 0.002))


_VARIANTS = "SELECT l_orderkey AS field, CAST(l_linenumber AS BIGINT) AS id, CASE WHEN l_tax > 0 THEN 'A' || l_partkey % 3 END AS decoded, CAST(l_discount AS DOUBLE) + 0.01 AS score, CAST(l_quantity AS DOUBLE) / 50 AS coverage, l_suppkey % 5 = 0 AS tiny FROM lineitem"


@query(f"SELECT field, id, decoded, round(value, 6) AS value FROM (SELECT *, round(pow(coverage, 0.15) * score * (1 + CASE WHEN decoded IS NULL OR tiny THEN 0 ELSE sum(score) OVER (PARTITION BY field, decoded) END * 0.1), 9) AS value FROM ({_VARIANTS})) QUALIFY row_number() OVER (PARTITION BY field ORDER BY value DESC, id) = 1")
def best_variants(v: Views) -> DataFrame:
    rows = v.table("lineitem").selectExpr("l_orderkey as field", "cast(l_linenumber as bigint) as id", "case when l_tax > 0 then concat('A', l_partkey % 3) end as decoded", "cast(l_discount as double) + 0.01 as score", "cast(l_quantity as double) / 50 as coverage", "l_suppkey % 5 = 0 as tiny")
    return N.best_variants(rows).withColumn("value", F.round("value", 6))


@query("""WITH i AS (SELECT l_orderkey AS field, min('Z' || l_partkey % 9) AS code FROM lineitem GROUP BY 1), l AS (SELECT l_orderkey AS field, substr('ABCDEFGHM', CAST(1 + l_partkey % 9 AS INT), 1) AS letter, min(CAST(l_discount AS DOUBLE)) AS error FROM lineitem GROUP BY 1, 2),
b AS (SELECT field, letter FROM (SELECT *, row_number() OVER w AS k, lead(error) OVER w AS nxt FROM l WINDOW w AS (PARTITION BY field ORDER BY error, letter)) WHERE k = 1 AND error <= 0.18 AND coalesce(round(nxt - error, 9) >= 0.01, true)),
x AS (SELECT i.field, i.code, b.letter, b.letter || substr(i.code, 2) AS word FROM i JOIN b ON b.field = i.field), v AS (SELECT DISTINCT l_orderkey AS field, substr('ABCDEFGHM', CAST(1 + l_partkey % 9 AS INT), 1) || l_suppkey % 4 AS word FROM lineitem WHERE l_tax > 0.03),
n AS (SELECT l_orderkey AS field, substr('ABCDEFGHM', CAST(1 + l_partkey % 9 AS INT), 1) || (1 + l_partkey % 5) AS word, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT field, substr(word, 1, 1) AS letter, max(n) AS most, arg_min(word, -n * 1000 + CAST(substr(word, 2) AS BIGINT)) AS top FROM n WHERE word IN (SELECT code FROM v_palette) GROUP BY 1, 2)
SELECT field, old, new FROM (SELECT x.field, x.code AS old, CASE WHEN x.word IN (SELECT code FROM v_palette) AND (x.field, x.word) IN (SELECT field, word FROM v) THEN x.word WHEN t.most >= 2 THEN t.top END AS new FROM x LEFT JOIN t ON t.field = x.field AND t.letter = x.letter) WHERE new IS NOT NULL""")
def repaired_prefixes(v: Views) -> DataFrame:
    rows = v.table("lineitem").withColumn("letter", F.expr("substr('ABCDEFGHM', int(1 + l_partkey % 9), 1)")).withColumnRenamed("l_orderkey", "field")
    items = rows.groupBy("field").agg(F.min(F.expr("concat('Z', l_partkey % 9)")).alias("code"))
    letters = rows.groupBy("field", "letter").agg(F.min(F.col("l_discount").cast("double")).alias("error"))
    variants = rows.selectExpr("field", "concat(letter, l_suppkey % 4) as word", "case when l_tax > 0.03 then 0.5 else 0.1 end as score")
    votes = rows.groupBy("field", F.expr("concat(letter, 1 + l_partkey % 5)").alias("word")).agg(F.sum("l_quantity").cast("long").alias("n"))
    return N.repaired_prefixes(items, letters, variants, votes, v.palette.select(F.col("code").alias("word")), margin=0.01)


@query("""WITH a AS (SELECT l_orderkey AS field, 'A' || min(l_partkey % 5) AS mean, 'A' || min(l_suppkey % 5) AS median FROM lineitem GROUP BY 1), n AS (SELECT l_orderkey AS field, 'A' || l_partkey % 5 AS word, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT a.field, a.mean AS word FROM a JOIN n ON n.field = a.field AND n.word = a.mean WHERE mean = median AND n >= 2 AND mean IN (SELECT code FROM v_palette)""")
def agreed_words(v: Views) -> DataFrame:
    rows = v.table("lineitem")
    means = rows.groupBy(F.col("l_orderkey").alias("field")).agg(F.concat(F.lit("A"), F.min(F.expr("l_partkey % 5"))).alias("mean"), F.concat(F.lit("A"), F.min(F.expr("l_suppkey % 5"))).alias("median"))
    averages = means.selectExpr("field", "stack(2, 'mean', mean, 'median', median) as (by, word)")
    votes = rows.groupBy(F.col("l_orderkey").alias("field"), F.expr("concat('A', l_partkey % 5)").alias("word")).agg(F.count("*").alias("n"))
    return N.agreed_words(averages, votes, v.palette.select(F.col("code").alias("word")))


@query("""WITH t AS (SELECT event_id, code || '(' || qty || ')' AS text, length(code) AS n FROM v_cmd WHERE qty >= 0),
m AS (SELECT event_id, text, count(CASE WHEN i <> n AND i < length(text) - 1 AND (event_id + i) % 5 = 0 THEN 1 END) AS wrong, count(CASE WHEN i <> n AND i < length(text) - 1 AND (event_id + i) % 5 = 0 AND event_id % 7 = 0 THEN 1 END) AS lost
FROM (SELECT event_id, text, n, unnest(range(0, length(text))) AS i FROM t) GROUP BY 1, 2)
SELECT event_id, CASE WHEN ok THEN text END AS text, CASE WHEN ok THEN round(exp((wrong * ln(0.4) + (length(text) - wrong) * ln(0.9)) / length(text)), 6) END AS score, CASE WHEN ok THEN CAST(wrong AS INT) END AS changes FROM (SELECT *, lost = 0 AND regexp_full_match(text, '[A-Z][0-9]+[(][0-9]+[)]') AS ok FROM m)""")
def decoded_fields(v: Views) -> DataFrame:
    """Every fifth character of a code and its quantity misread, the right one among the alternatives; in some fields with too low a score."""
    text = F.concat("code", F.lit("("), F.col("qty").cast("string"), F.lit(")"))
    rows = v.cmd.filter("qty >= 0").select("event_id", text.alias("text"), F.length("code").alias("n"))

    def reading(c: Column, i: Column) -> Column:
        wrong = (i != F.col("n")) & (i < F.length("text") - 1) & ((F.col("event_id") + i) % 5 == 0)
        other = F.struct(c.alias("char"), F.when(F.col("event_id") % 7 == 0, 0.01).otherwise(0.4).alias("score"))
        return F.struct(F.when(wrong, "#").otherwise(c).alias("char"), F.when(wrong, 0.8).otherwise(0.9).alias("score"), F.when(wrong, F.array(F.struct(F.lit("*").alias("char"), F.lit(0.9).alias("score")), other)).otherwise(F.array().cast("array<struct<char:string,score:double>>")).alias("alternatives"))

    fields = rows.withColumn("c", F.transform(F.filter(F.split("text", ""), lambda c: c != ""), reading))
    return fields.select("event_id", decode_field(F.col("c"), "item").alias("d")).select("event_id", "d.text", F.round("d.score", 6).alias("score"), "d.changes")


@query("SELECT vec_id, round(exp(list_sum(list_transform(embedding, lambda x: ln(1 + abs(CAST(x AS DOUBLE))))) / len(embedding)), 6) AS score FROM v_glyph")
def glyph_confidence(v: Views) -> DataFrame:
    return v.glyph.select("vec_id", F.round(confidence(F.transform("embedding", lambda x: 1 + F.abs(x.cast("double")))), 6).alias("score"))


@query(f"SELECT a.vec_id, b.vec_id AS other, round({_E} + 0.18 * abs(ln((1.0 + a.vec_id % 3) / (1 + b.vec_id % 4))) + 0.15 * abs(a.vec_id % 2 - b.vec_id % 3), 3) AS score FROM v_glyph a JOIN v_glyph b ON b.vec_id = a.vec_id + 1")
def shaped_scores(v: Views) -> DataFrame:
    a, b = v.glyph.alias("a"), v.glyph.alias("b")
    pairs = a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1)
    score = shaped_score(F.col("a.embedding"), F.col("b.embedding"), F.expr("1.0D + a.vec_id % 3"), F.expr("1.0D + b.vec_id % 4"), F.expr("a.vec_id % 2"), F.expr("b.vec_id % 3"))
    return pairs.select(F.col("a.vec_id").alias("vec_id"), F.col("b.vec_id").alias("other"), F.round(score, 3).alias("score"))
