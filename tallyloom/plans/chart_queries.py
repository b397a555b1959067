"""Chart results over the derived views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import charts as C
from ..sources.views import Views
from .registry import query

_COUNTS = "SELECT c.image_id, c.text AS code, count(*) AS qty FROM v_cell c JOIN v_palette p ON p.code = c.text WHERE NOT c.blank GROUP BY 1, 2"
_SUMMARY = "SELECT image_id, count(CASE WHEN NOT blank AND p.code IS NOT NULL THEN 1 END) AS counted, count(CASE WHEN blank THEN 1 END) AS blanks, count(CASE WHEN NOT blank AND p.code IS NULL THEN 1 END) AS unknown, count(*) AS cells FROM v_cell c LEFT JOIN v_palette p ON p.code = c.text GROUP BY 1"
_OVER = "greatest(0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y)) * 10 > least({a}.w * {a}.h, {b}.w * {b}.h) * {t}"
_BOTH = "SELECT coalesce(a.pattern_id, e.pattern_id) AS pattern_id, coalesce(a.code, e.code) AS code, a.qty AS actual, e.qty AS expected FROM v_usage a FULL JOIN v_expected e ON e.pattern_id = a.pattern_id AND e.code = a.code"
_EVAL = f"""SELECT b.pattern_id, count(CASE WHEN actual IS NULL THEN 1 END) AS missing, count(CASE WHEN expected IS NULL THEN 1 END) AS extra, count(CASE WHEN abs(expected - actual) * 10 > greatest(30, expected) THEN 1 END) AS outside,
coalesce(bool_or(r.complete), false) AND count(expected) > 0 AS reference_complete FROM ({_BOTH}) b LEFT JOIN (SELECT pattern_id, pattern_id % 4 <> 0 AS complete FROM v_pattern) r ON r.pattern_id = b.pattern_id GROUP BY 1"""
_EVAL = f"SELECT *, reference_complete AND missing + extra + outside = 0 AS passed FROM ({_EVAL})"


@query(_COUNTS)
def cell_counts(v: Views) -> DataFrame:
    return C.cell_counts(v.cell, v.palette)


@query(f"SELECT *, unknown = 0 AND counted > 0 AS complete, counted + blanks + unknown = cells AS conserved FROM ({_SUMMARY})")
def cell_summary(v: Views) -> DataFrame:
    return C.cell_summary(v.cell, v.palette)


@query("SELECT image_id, row, count(*) AS cells, min(x) AS x, min(y) AS y, max(x + 10) - min(x) AS w, max(y + 10) - min(y) AS h, string_agg(col || ':' || text, '; ' ORDER BY col, text) AS raw FROM v_cell WHERE NOT blank AND text NOT IN (SELECT code FROM v_palette) GROUP BY 1, 2")
def row_doubts(v: Views) -> DataFrame:
    return C.row_doubts(v.cell, v.palette)


_CANDIDATES = "SELECT c.image_id, c.text AS code, count(*) AS quantity, min(c.row) AS first_row, min(c.col) FILTER (WHERE c.row = f.row) AS first_col, string_agg(c.row || ':' || c.col, ',' ORDER BY c.row, c.col) AS ids FROM v_cell c JOIN v_palette p ON p.code = c.text JOIN (SELECT image_id, text, min(row) AS row FROM v_cell WHERE NOT blank GROUP BY 1, 2) f ON f.image_id = c.image_id AND f.text = c.text WHERE NOT c.blank GROUP BY 1, 2"


@query(_CANDIDATES)
def cell_candidates(v: Views) -> DataFrame:
    return C.cell_candidates(v.cell, v.palette).withColumn("ids", F.array_join("evidence_ids", ",")).drop("evidence_ids")


_COMPACT = """WITH c AS (SELECT pattern_id AS image_id, code, CASE WHEN qty % 3 > 0 THEN 'grid' ELSE 'legend' END AS source, qty % 4 + 1 AS n FROM v_usage),
i AS (SELECT image_id, code, source, k, code || '-' || k AS id FROM c, (SELECT unnest(range(1, 5)) AS k) WHERE k <= n),
u AS (SELECT DISTINCT image_id, id FROM i WHERE source = 'legend' OR k = 1 OR (image_id % 2 = 0 AND k = 3) OR (image_id % 3 = 0 AND k = 4))"""


@query(_COMPACT + " SELECT c.image_id, c.code, coalesce(string_agg(i.id, ',' ORDER BY i.k), '') AS ids, (SELECT count(*) FROM i JOIN u ON u.image_id = i.image_id AND u.id = i.id WHERE i.image_id = c.image_id) AS published FROM c LEFT JOIN (SELECT i.* FROM i JOIN u ON u.image_id = i.image_id AND u.id = i.id) i ON i.image_id = c.image_id AND i.code = c.code GROUP BY 1, 2")
def compact_results(v: Views) -> DataFrame:
    """Doubts name the third piece of a code by itself and the fourth in a list."""
    ids = F.slice(F.array(*[F.concat("code", F.lit(f"-{k}")) for k in (1, 2, 3, 4)]), F.lit(1), F.greatest(F.lit(0), F.col("qty") % 4 + 1).cast("int"))
    lines = v.usage.repartition("pattern_id")  # dealt once for all that follows
    candidates = lines.select(F.col("pattern_id").alias("image_id"), "code", F.when(F.col("qty") % 3 > 0, "grid").otherwise("legend").alias("source"), ids.alias("evidence_ids"))
    evidence = candidates.select("image_id", "source", F.explode_outer("evidence_ids").alias("id")).filter("id is not null")
    doubts = candidates.select("image_id", F.when(F.col("image_id") % 2 == 0, F.get("evidence_ids", F.lit(2))).alias("evidence_id"), F.when(F.col("image_id") % 3 == 0, F.slice("evidence_ids", 4, 1)).alias("evidence_ids"))
    short, kept = C.compact_results(candidates, evidence, doubts)
    n = kept.groupBy("image_id").agg(F.count("*").alias("published"))
    return short.select("image_id", "code", F.array_join("evidence_ids", ",").alias("ids")).join(n, "image_id", "left").fillna(0, ["published"])


@query(f"SELECT image_id, max(qty) AS most, CAST(sum(qty) AS BIGINT) AS total, count(*) AS codes, max(qty) < 4 OR sum(qty) < 2 * count(*) AS sheet FROM ({_COUNTS}) GROUP BY 1")
def palette_sheets(v: Views) -> DataFrame:
    return C.palette_sheets(C.cell_counts(v.cell, v.palette))


@query("""WITH b AS (SELECT image_id, id, code, qty, score, id % 9 = 0 AS clipped FROM v_box)
SELECT b.image_id, b.id, CASE WHEN id % 7 <> 0 THEN b.code END AS code, CASE WHEN id % 7 <> 0 THEN qty END AS quantity, CASE WHEN id % 7 = 0 THEN 'no code' WHEN p.code IS NULL THEN 'unknown code' WHEN score <= 0.35 THEN 'unsure' WHEN clipped THEN 'clipped' END AS reason FROM b LEFT JOIN v_palette p ON p.code = b.code""")
def legend_items(v: Views) -> DataFrame:
    text = F.when(F.col("id") % 7 == 0, F.lit("?")).otherwise(F.concat("code", F.lit("("), F.col("qty").cast("string"), F.lit(")")))
    return C.legend_items(v.box.select("image_id", "id", text.alias("text"), "score", (F.col("id") % 9 == 0).alias("clipped")), v.palette)


@query(f"SELECT a.image_id, a.id AS first_id, b.id AS second_id FROM v_place a JOIN v_place b ON a.image_id = b.image_id AND a.code = b.code AND a.qty = b.qty AND a.id < b.id AND {_OVER.format(a='a', b='b', t=2)}")
def overlapping_pairs(v: Views) -> DataFrame:
    return C.overlapping_pairs(v.place, 2)


#: Boxes of a group in order, each kept unless it is the same as one kept before.
_GREEDY = """g AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY id) AS k FROM {boxes}),
f AS (SELECT {keys}, k, [id] AS kept_ids, [{{'x': x, 'y': y, 'w': w, 'h': h}}] AS kept FROM g WHERE k = 1
UNION ALL SELECT {g_keys}, g.k, CASE WHEN len(list_filter(f.kept, lambda o: {same})) > 0 THEN f.kept_ids ELSE list_append(f.kept_ids, g.id) END,
CASE WHEN len(list_filter(f.kept, lambda o: {same})) > 0 THEN f.kept ELSE list_append(f.kept, {{'x': g.x, 'y': g.y, 'w': g.w, 'h': g.h}}) END FROM f JOIN g ON g.k = f.k + 1 AND {on}),
kept AS (SELECT {keys}, unnest(kept_ids) AS id FROM f QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY k DESC) = 1)"""


def _greedy(boxes: str, keys: list[str], same: str) -> str:
    return _GREEDY.format(boxes=boxes, keys=", ".join(keys), g_keys=", ".join(f"g.{k}" for k in keys), same=same, on=" AND ".join(f"g.{k} = f.{k}" for k in keys))


_PLACES = _greedy("v_place", ["image_id", "code", "qty"], _OVER.format(a="g", b="o", t=2))


@query(f"WITH RECURSIVE {_PLACES} SELECT image_id, id, code, count(*) OVER (PARTITION BY image_id, code) > 1 AS repeated FROM kept")
def merged_repeats(v: Views) -> DataFrame:
    return C.merge_repeats(v.place, 2).select("image_id", "id", "code", "repeated")


@query(f"""WITH RECURSIVE {_PLACES}, m AS (SELECT p.*, count(*) OVER (PARTITION BY p.image_id, p.code) > 1 AS repeated FROM v_place p JOIN kept ON kept.image_id = p.image_id AND kept.id = p.id)
SELECT image_id, id, code, 'repeated-code' AS reason, code || '(' || qty || ')' AS raw, x, y, w, h FROM m WHERE repeated
UNION ALL SELECT DISTINCT a.image_id, a.id, a.code, 'shared-quantity', a.code || '(' || a.qty || ')', a.x, a.y, a.w, a.h FROM m a JOIN m b ON a.image_id = b.image_id AND a.id <> b.id AND NOT a.repeated AND NOT b.repeated AND {_OVER.format(a='a', b='b', t=8)}""")
def reading_doubts(v: Views) -> DataFrame:
    return C.counted_once(v.place.withColumn("raw", F.concat("code", F.lit("("), F.col("qty").cast("string"), F.lit(")"))), 2)[1]


@query(f"SELECT DISTINCT a.image_id, a.id FROM v_box a JOIN v_box b ON a.image_id = b.image_id AND a.id <> b.id AND {_OVER.format(a='a', b='b', t=8)}")
def shared_quantities(v: Views) -> DataFrame:
    return C.shared_quantities(v.box)


@query("SELECT b.image_id, b.id FROM v_box b WHERE b.id > 1 AND NOT EXISTS (SELECT 1 FROM v_box r WHERE r.id = 1 AND r.image_id = b.image_id AND " + _OVER.format(a="b", b="r", t=8) + ")")
def outside_grid(v: Views) -> DataFrame:
    return C.outside(v.box.filter("id > 1"), v.box.filter("id = 1")).select("image_id", "id")


@query("WITH RECURSIVE " + _greedy("v_box", ["image_id"], "greatest(abs(g.x - o.x), abs(g.y - o.y), abs(g.w - o.w), abs(g.h - o.h)) <= 12") + " SELECT image_id, id FROM kept")
def near_identical(v: Views) -> DataFrame:
    return C.near_identical(v.box, 12).select("image_id", "id")


@query(f"SELECT DISTINCT a.image_id, a.id, a.code FROM v_box a JOIN v_box b ON a.image_id = b.image_id AND a.code = b.code AND a.id <> b.id AND b.score <= 0.5 AND {_OVER.format(a='a', b='b', t=5)}")
def vetoed(v: Views) -> DataFrame:
    return C.vetoed(v.box, v.box.filter("score <= 0.5"))


@query("WITH c AS (SELECT DISTINCT r, g, b FROM v_cell), n AS (SELECT c.r, c.g, c.b, min({'d': (c.r - p.r) * (c.r - p.r) + (c.g - p.g) * (c.g - p.g) + (c.b - p.b) * (c.b - p.b), 'k': p.code}) AS best FROM c, v_palette p GROUP BY 1, 2, 3) SELECT image_id, row, col, x, n.best.d AS distance, n.best.k AS code FROM v_cell v JOIN n ON n.r = v.r AND n.g = v.g AND n.b = v.b")
def nearest_colours(v: Views) -> DataFrame:
    return C.nearest_colours(v.cell, v.palette)


_SWATCH = "SELECT r * 7 % 256 AS r, g, b * 31 % 256 AS b, min(code) AS swatch FROM v_palette GROUP BY 1, 2, 3"


_GROUNDS = "SELECT DISTINCT image_id, r, g, b FROM v_cell WHERE col % 8 = 0"


@query(f"SELECT c.image_id, CASE WHEN s.swatch IS NOT NULL THEN s.swatch WHEN EXISTS (SELECT 1 FROM ({_GROUNDS}) k WHERE k.image_id = c.image_id AND greatest(abs(c.r - k.r), abs(c.g - k.g), abs(c.b - k.b)) <= 60) THEN 'blank' ELSE 'unknown' END AS kind FROM v_cell c LEFT JOIN ({_SWATCH}) s ON s.r = c.r AND s.g = c.g AND s.b = c.b")
def exact_colours(v: Views) -> DataFrame:
    swatches = v.palette.selectExpr("code", "r * 7 % 256 as r", "g", "b * 31 % 256 as b")
    return C.exact_colours(v.cell, swatches, v.cell.filter("col % 8 = 0").select("image_id", "r", "g", "b"), 60)


_LEG = "SELECT pattern_id AS image_id, code, qty FROM v_usage WHERE pattern_id % 3 > 0 AND code IN (SELECT code FROM v_palette)"
_GRD = "SELECT pattern_id AS image_id, code, CASE WHEN pattern_id % 5 = 0 THEN qty + 1 ELSE qty END AS qty FROM v_usage WHERE code IN (SELECT code FROM v_palette)"


def _legend(v: Views) -> DataFrame:
    return v.usage.filter("pattern_id % 3 > 0").join(F.broadcast(v.palette.select("code")), "code").selectExpr("pattern_id as image_id", "code", "qty")


def _grid(v: Views) -> DataFrame:
    return v.usage.join(F.broadcast(v.palette.select("code")), "code").selectExpr("pattern_id as image_id", "code", "case when pattern_id % 5 = 0 then qty + 1 else qty end as qty")


@query(f"SELECT coalesce(l.image_id, g.image_id) AS image_id, coalesce(l.code, g.code) AS code, coalesce(l.qty, 0) AS legend_qty, coalesce(g.qty, 0) AS grid_qty FROM ({_LEG}) l FULL JOIN ({_GRD}) g ON g.image_id = l.image_id AND g.code = l.code WHERE coalesce(l.qty, 0) <> coalesce(g.qty, 0)")
def reconciled(v: Views) -> DataFrame:
    return C.reconcile(_legend(v), _grid(v))


_LEG2 = f"SELECT * FROM ({_LEG}) WHERE NOT (image_id % 7 = 0 AND qty % 2 = 0)"


@query(f"""WITH l AS ({_LEG2}), g AS ({_GRD}), s AS (SELECT image_id, unknown = 0 AND counted > 0 AS complete FROM ({_SUMMARY})),
p AS (SELECT coalesce(l.image_id, g.image_id) AS image_id, count(l.qty) AS lc, count(g.qty) AS gc, count(CASE WHEN l.qty IS DISTINCT FROM g.qty THEN 1 END) AS different, count(CASE WHEN l.qty IS NOT NULL AND l.qty IS DISTINCT FROM g.qty THEN 1 END) AS disagree, sum(l.qty) AS lt, sum(g.qty) AS gt FROM l FULL JOIN g ON g.image_id = l.image_id AND g.code = l.code GROUP BY 1),
x AS (SELECT o.pattern_id AS image_id, coalesce(lc, 0) AS lc, coalesce(gc, 0) AS gc, coalesce(different, 0) AS different, coalesce(disagree, 0) AS disagree, lt, gt, coalesce(complete, false) AS complete FROM v_pattern o LEFT JOIN p ON p.image_id = o.pattern_id LEFT JOIN s ON s.image_id = o.pattern_id),
y AS (SELECT *, CASE WHEN complete AND lc > 0 AND lc < gc AND disagree = 0 THEN 'grid' WHEN lc > 0 THEN 'legend' WHEN complete AND gc > 0 THEN 'grid' END AS source FROM x)
SELECT image_id, source, CASE WHEN source IS NULL THEN 'failed' WHEN source = 'legend' AND complete AND different = 0 THEN 'ready' WHEN source = 'grid' AND lc = 0 THEN 'ready' ELSE 'partial' END AS status, CAST(CASE source WHEN 'legend' THEN lt WHEN 'grid' THEN gt END AS BIGINT) AS total FROM y""")
def routed(v: Views) -> DataFrame:
    legend = _legend(v).filter("not (image_id % 7 = 0 and qty % 2 = 0)")
    return C.route(v.pattern.selectExpr("pattern_id as image_id"), legend, _grid(v), C.cell_summary(v.cell, v.palette))


@query(_EVAL)
def evaluated(v: Views) -> DataFrame:
    return C.evaluation(C.compared(v.usage, v.expected), v.pattern.selectExpr("pattern_id", "pattern_id % 4 <> 0 as complete"))


@query(f"SELECT pattern_id, count(*) AS differences, string_agg(code || '=' || coalesce(CAST(actual AS VARCHAR), '-') || '/' || coalesce(CAST(expected AS VARCHAR), '-'), ',' ORDER BY code || '=' || coalesce(CAST(actual AS VARCHAR), '-') || '/' || coalesce(CAST(expected AS VARCHAR), '-')) AS listed FROM ({_BOTH}) WHERE actual IS DISTINCT FROM expected GROUP BY 1")
def difference_lists(v: Views) -> DataFrame:
    return C.difference_lists(C.compared(v.usage, v.expected))


def _evaluated(v: Views) -> DataFrame:
    return evaluated(v).withColumn("grp", F.col("pattern_id") % 7)


@query(f"SELECT pattern_id % 7 AS grp, count(*) AS samples, count(CASE WHEN passed THEN 1 END) AS passes, CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(extra) AS BIGINT) AS extra FROM ({_EVAL}) GROUP BY 1")
def evaluation_report(v: Views) -> DataFrame:
    return C.report(_evaluated(v), ["grp"])


@query(f"SELECT pattern_id % 7 AS grp, bool_and(CASE WHEN reference_complete THEN passed ELSE pattern_id % 11 <> 0 END) AS gate, count(*) AS samples FROM ({_EVAL}) GROUP BY 1")
def report_gate(v: Views) -> DataFrame:
    return C.gate(_evaluated(v).withColumn("status", F.when(F.col("pattern_id") % 11 == 0, "ready").otherwise("partial")))


@query("WITH e AS (SELECT image_id, id FROM v_box), u AS (SELECT image_id, code, id FROM v_box WHERE id % 2 = 0 UNION ALL SELECT image_id, code, id - 1 FROM v_box WHERE id % 2 = 0) SELECT e.image_id, e.id, coalesce(string_agg(DISTINCT u.code, ',' ORDER BY u.code), '') AS codes FROM e LEFT JOIN u ON u.image_id = e.image_id AND u.id = e.id GROUP BY 1, 2")
def evidence_codes(v: Views) -> DataFrame:
    return C.evidence_codes(v.box.filter("id % 2 = 0").selectExpr("image_id", "code", "array(id, id - 1) as evidence_ids"), v.box.select("image_id", "id"))


@query("""WITH n AS (SELECT image_id, id, id + 1 AS proof FROM v_box UNION ALL SELECT image_id, id, id + 2 FROM v_box WHERE id % 2 = 0 UNION ALL SELECT image_id, id, id - 1 FROM v_box WHERE id % 2 = 0),
f AS (SELECT n.image_id, n.id, arg_max({'raw': e.code, 'x': e.x}, e.id) AS e FROM n JOIN v_box e ON e.image_id = n.image_id AND e.id = n.proof GROUP BY 1, 2)
SELECT d.image_id, d.id, coalesce(CASE WHEN d.id % 3 = 0 THEN 'own' END, f.e.raw, '') AS raw, CASE WHEN d.id % 5 = 0 THEN -1 ELSE f.e.x END AS x FROM v_box d LEFT JOIN f ON f.image_id = d.image_id AND f.id = d.id""")
def doubt_evidence(v: Views) -> DataFrame:
    """Evidence in falling order of its ids."""
    doubts = v.box.selectExpr("image_id", "id", "id + 1 as evidence_id", "if(id % 2 = 0, array(id + 2, id - 1), null) as evidence_ids", "case when id % 3 = 0 then 'own' end as raw", "case when id % 5 = 0 then array(-1L) end as region")
    evidence = v.box.selectExpr("image_id", "id", "code as raw", "array(cast(x as bigint)) as region", "-id as pos")
    return C.doubt_evidence(doubts, evidence).select("image_id", "id", "raw", F.get("region", F.lit(0)).alias("x"))


@query("SELECT image_id, id FROM v_box WHERE id % 2 = 0 OR id % 3 = 0")
def published_evidence(v: Views) -> DataFrame:
    rows = v.box.selectExpr("image_id", "id", "case when id % 2 = 0 then 'legend' else 'grid' end as source")
    return C.published(rows, v.box.filter("id % 3 = 0").select("image_id", "id")).select("image_id", "id")


_MARKS = "SELECT image_id, CASE WHEN code LIKE 'A%' AND id % 3 = 0 THEN 'HAMA' ELSE 'MARD' END AS brand, CASE WHEN id % 4 = 0 THEN CASE WHEN qty % 9 = 0 THEN '96' ELSE '221' END END AS palette FROM v_box"


@query(f"SELECT image_id, count(DISTINCT brand) AS brands, count(CASE WHEN brand <> 'MARD' OR palette <> '221' THEN 1 END) AS odd, count(DISTINCT brand) > 1 OR count(CASE WHEN brand <> 'MARD' OR palette <> '221' THEN 1 END) > 0 AS conflict FROM ({_MARKS}) GROUP BY 1")
def brand_conflicts(v: Views) -> DataFrame:
    return C.brand_conflicts(v.box.selectExpr("image_id", "case when code like 'A%' and id % 3 = 0 then 'HAMA' else 'MARD' end as brand", "case when id % 4 = 0 then case when qty % 9 = 0 then '96' else '221' end end as palette"))


@query("SELECT a.image_id, a.id, arg_min(b.id, (b.x - a.x - a.w) * 1000 + b.id) AS number_id FROM v_place a JOIN v_place b ON a.image_id = b.image_id AND a.id <> b.id AND b.x - a.x - a.w >= 0 AND (b.x - a.x - a.w) * 2 <= a.h * 3 AND abs(b.y - a.y) * 10 < a.h * 3 AND b.h * 10 >= a.h * 6 AND b.h * 2 <= a.h * 3 GROUP BY 1, 2")
def adjacent_numbers(v: Views) -> DataFrame:
    return C.adjacent_numbers(v.place, v.place)


_PROOF = "SELECT c.image_id, c.code, s.source, 'count-conflict' AS reason, c.code || ': ' || c.legend_qty || ' / ' || c.grid_qty AS raw, s.x, s.y FROM ({both}) c JOIN ({side}) s ON s.image_id = c.image_id AND s.code = c.code"
_CONFLICTS = f"SELECT coalesce(l.image_id, g.image_id) AS image_id, coalesce(l.code, g.code) AS code, coalesce(l.qty, 0) AS legend_qty, coalesce(g.qty, 0) AS grid_qty FROM ({_LEG}) l FULL JOIN ({_GRD}) g ON g.image_id = l.image_id AND g.code = l.code WHERE coalesce(l.qty, 0) <> coalesce(g.qty, 0)"


@query(_PROOF.format(both=_CONFLICTS, side="SELECT image_id, code, 'legend' AS source, arg_min(x, id) AS x, arg_min(y, id) AS y FROM v_box GROUP BY 1, 2") + " UNION ALL " + _PROOF.format(both=_CONFLICTS, side="SELECT image_id, code, 'grid' AS source, x, y FROM (SELECT image_id, text AS code, x, y, row_number() OVER (PARTITION BY image_id, text ORDER BY row, col, x, y) AS k FROM v_cell) WHERE k = 1"))
def conflict_doubts(v: Views) -> DataFrame:
    return C.conflict_doubts(_legend(v), _grid(v), v.box, v.cell)


def _brands(v: Views) -> DataFrame:
    return C.brand_conflicts(v.box.selectExpr("image_id", "case when code like 'A%' and id % 3 = 0 then 'HAMA' else 'MARD' end as brand", "case when id % 4 = 0 then case when qty % 9 = 0 then '96' else '221' end end as palette"))


_ODD = f"SELECT image_id FROM ({_MARKS}) GROUP BY 1 HAVING count(DISTINCT brand) > 1 OR count(CASE WHEN brand <> 'MARD' OR palette <> '221' THEN 1 END) > 0"


@query(f"SELECT pattern_id AS image_id, CASE WHEN pattern_id IN ({_ODD}) THEN 'failed' ELSE 'ready' END AS status, CASE WHEN pattern_id NOT IN ({_ODD}) THEN 'legend' END AS source FROM v_pattern")
def quarantined_results(v: Views) -> DataFrame:
    results = v.pattern.selectExpr("pattern_id as image_id", "'ready' as status", "'legend' as source")
    return C.quarantine(_legend(v), results, _brands(v))[0]


@query(f"SELECT image_id, code, 'source-conflict' AS reason, code || ' / ' || qty AS raw FROM ({_LEG}) WHERE image_id IN ({_ODD})")
def quarantine_doubts(v: Views) -> DataFrame:
    return C.quarantine(_legend(v), v.pattern.selectExpr("pattern_id as image_id", "'ready' as status", "'legend' as source"), _brands(v))[2]


@query("SELECT image_id, id, code, NULL AS row, 'legend' AS origin FROM v_box UNION ALL SELECT image_id, NULL, text, row, 'grid' FROM v_cell WHERE NOT blank")
def merged_evidence(v: Views) -> DataFrame:
    return C.merged_evidence(v.box.select("image_id", "id", "code"), v.cell.filter("not blank").select("image_id", F.col("text").alias("code"), "row"))


@query("SELECT image_id, id, kind FROM (SELECT *, CASE id % 3 WHEN 0 THEN 'legend' WHEN 1 THEN 'cell' ELSE 'brand' END AS kind FROM v_box) WHERE (kind = 'legend' AND score > 0.35) OR (kind = 'cell' AND score > 0.6) OR (kind = 'brand' AND score >= 0.65)")
def confident_readings(v: Views) -> DataFrame:
    return C.confident(v.box.selectExpr("image_id", "id", "score", "element_at(array('legend', 'cell', 'brand'), int(id % 3 + 1)) as kind"), "kind").select("image_id", "id", "kind")


@query("SELECT pattern_id AS sample, 'dev' AS split FROM v_pattern WHERE NOT archived AND name <> 'chart 1'")
def counted_samples(v: Views) -> DataFrame:
    samples = v.pattern.selectExpr("name as sample", "case when archived then 'acceptance' else 'dev' end as split", "pattern_id")
    return C.split_samples(samples, "dev", ("chart 1",)).select(F.col("pattern_id").alias("sample"), "split")


@query("WITH o AS (SELECT image_id, block_id, max(CASE WHEN status <> 'system' THEN 1 ELSE 0 END) AS ok, max(length(payload)) AS cells FROM v_block GROUP BY 1, 2) SELECT image_id, count(CASE WHEN ok = 1 THEN 1 END) AS read_blocks, count(*) AS blocks, CAST(coalesce(sum(CASE WHEN ok = 0 THEN cells END), 0) AS BIGINT) AS unread_cells FROM o GROUP BY 1")
def block_progress(v: Views) -> DataFrame:
    return C.block_progress(v.block)


@query("SELECT image_id, row % 2 AS side, bool_and(CAST(substr(text, 2) AS BIGINT) = col) AS holds FROM v_cell GROUP BY 1, 2")
def frame_checks(v: Views) -> DataFrame:
    return C.frame_holds(v.cell.selectExpr("image_id", "row % 2 as side", "substr(text, 2) as text", "col as index"))


@query("WITH s AS (SELECT image_id, w, h, count(*) AS n FROM v_box GROUP BY 1, 2, 3), m AS (SELECT image_id, w AS mw, h AS mh FROM s QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, w, h) = 1) SELECT b.image_id, b.id FROM v_box b JOIN m ON m.image_id = b.image_id WHERE abs(b.w - mw) <= 2 AND abs(b.h - mh) <= 2")
def modal_boxes(v: Views) -> DataFrame:
    return C.modal_boxes(v.box).select("image_id", "id")


@query("SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY y // 5, x, id) AS place FROM v_box")
def reading_order(v: Views) -> DataFrame:
    return C.line_order(v.box).select("image_id", "id", "place")


@query("SELECT image_id, id, place FROM (SELECT image_id, id, row_number() OVER (PARTITION BY image_id ORDER BY y // 5, x, id) AS place FROM v_box) WHERE place <= 3")
def first_words(v: Views) -> DataFrame:
    return C.first_per_image(v.box, 3).select("image_id", "id", "place")


@query("SELECT label, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM v_glyph) WHERE i % CAST(ceil(n / 8.0) AS BIGINT) = 0")
def stride_sample(v: Views) -> DataFrame:
    return C.stride_sample(v.glyph, "label", ["vec_id"], 8).select("label", "vec_id")


@query("SELECT image_id, n, r, g, b FROM (SELECT image_id, r, g, b, count(*) AS n FROM v_cell GROUP BY 1, 2, 3, 4) QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY n DESC, r, g, b) = 1")
def modal_colours(v: Views) -> DataFrame:
    return C.modal_colours(v.cell, ["image_id"])


@query("SELECT image_id, quantile_cont(r, 0.5) AS r_median, quantile_cont(g, 0.5) AS g_median, quantile_cont(b, 0.5) AS b_median FROM v_cell GROUP BY 1")
def median_background(v: Views) -> DataFrame:
    return C.median_background(v.cell, ["image_id"])


@query("SELECT image_id, code, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM v_box GROUP BY 1, 2")
def union_boxes(v: Views) -> DataFrame:
    return C.group_boxes(v.box, ["image_id", "code"])


@query("SELECT pattern_id AS image_id, CASE WHEN pattern_id % 3 = 0 THEN 'assisted' ELSE 'legend' END AS source, CASE WHEN pattern_id % 3 = 0 THEN 'failed' ELSE 'ready' END AS original_status, false AS modified, false AS risk_acknowledged, pattern_id % 3 = 0 OR NOT archived AS has_risk FROM v_pattern")
def adopted_results(v: Views) -> DataFrame:
    return C.adopted(v.pattern.selectExpr("pattern_id as image_id", "case when pattern_id % 3 <> 0 then 'legend' end as source", "case when pattern_id % 3 = 0 then 'failed' else 'ready' end as status", "array(named_struct('id', 1, 'resolved', true), named_struct('id', 2, 'resolved', archived)) as risks"))


@query("SELECT conv_id AS image_id, turn AS block_id FROM conversations WHERE turn % 3 = 0 AND conv_id % 2 = 0 AND NOT (turn % 2 = 1 AND conv_id % 5 = 0)")
def current_blocks(v: Views) -> DataFrame:
    """Six fields make an identity; of some images the confirmed version has moved on, where there is one."""
    from ..streaming.ledger_stream import IDENTITY, current_results

    blocks = v.block.selectExpr("image_id", "block_id", "concat('r', image_id) as request_id", "block_id as image_session", "cast(image_id as string) as pattern_id", "block_id % 3 as revision", "if(block_id % 2 = 0, null, block_id) as confirmed_version", "image_id % 2 as epoch")
    identities = blocks.filter("block_id % 3 = 0").withColumns({"confirmed_version": F.expr("if(image_id % 5 = 0, confirmed_version + 1, confirmed_version)"), "epoch": F.lit(0).cast("bigint")})
    return current_results(blocks, identities, list(IDENTITY)).select("image_id", "block_id")


@query("""WITH p AS (SELECT pattern_id, count(*) AS n, CAST(sum(qty) AS BIGINT) AS total, CAST(max(qty) AS BIGINT) AS most FROM v_usage WHERE code IN (SELECT code FROM v_palette) GROUP BY 1),
e AS (SELECT *, CASE WHEN pattern_id % 19 = 0 THEN 'invalid-format' WHEN pattern_id % 11 = 0 OR pattern_id % 13 = 0 THEN 'invalid-candidate' WHEN pattern_id % 7 = 0 THEN 'invalid-total' WHEN pattern_id % 17 = 0 THEN 'invalid-title' WHEN pattern_id % 23 = 0 THEN 'missing-size' END AS error FROM p)
SELECT pattern_id AS image_id, error, CASE WHEN error IS NULL THEN CASE WHEN pattern_id % 5 = 0 THEN 'partial' ELSE 'ready' END END AS status, CASE WHEN error IS NULL THEN n END AS lines, CASE WHEN error IS NULL THEN CASE WHEN pattern_id % 5 = 0 THEN 'coverage,risk-0' ELSE '' END END AS risks,
CASE WHEN error IS NULL AND pattern_id % 5 = 0 THEN 'seen ' || pattern_id END AS doubt, CASE WHEN error IS NULL THEN n END AS supported FROM e""")
def accepted_recognitions(v: Views) -> DataFrame:
    """Results as JSON texts, with odd ones by rule: broken text, an unknown code, a quantity as text, a wrong total, no title, no size."""
    from ..sources.recognition import accepted_results

    known = v.usage.join(F.broadcast(v.palette.select("code")), "code")
    quantity = F.when((F.col("pattern_id") % 13 == 0), F.concat(F.lit('"'), F.col("qty").cast("string"), F.lit('"'))).otherwise(F.col("qty").cast("string"))
    part = F.concat(F.lit('{"code":"'), F.col("code"), F.lit('","quantity":'), quantity, F.lit(',"evidenceIds":["e","'), F.col("code"), F.lit('"]}'))
    per = known.groupBy("pattern_id").agg(F.array_join(F.array_sort(F.collect_list(part)), ",").alias("parts"), F.sum("qty").alias("total"))
    rule = lambda n, yes, no: F.when(F.col("pattern_id") % n == 0, F.lit(yes)).otherwise(F.lit(no))
    texts = per.select(F.col("pattern_id").alias("image_id"), F.concat(
        rule(19, "", "{"), F.lit('"status":"ready","algorithm":"1","source":"legend","candidates":['), "parts", rule(11, ',{"code":"Z9","quantity":1}', ""), F.lit('],"evidence":[{"id":"e","rawText":"seen '), F.col("pattern_id").cast("string"), F.lit('","region":[0,0,5,5]}],"doubts":['),
        rule(5, '{"reason":"r","evidenceIds":["x","e"]}', ""), F.lit('],"total":'), (F.col("total") + F.when(F.col("pattern_id") % 7 == 0, 1).otherwise(0)).cast("string"), rule(17, "", ',"titleTotal":null'), rule(23, "", ',"image":{"width":10,"height":20}'), F.lit("}"),
    ).alias("json"))
    got = accepted_results(texts, v.palette)
    return got.select("image_id", "error", "status", F.size("lines").cast("bigint").alias("lines"), F.array_join(F.transform("risks", lambda r: r["id"]), ",").alias("risks"), F.get("risks", F.lit(1))["raw"].alias("doubt"), F.size(F.get("evidence", F.lit(0))["codes"]).cast("bigint").alias("supported"))
