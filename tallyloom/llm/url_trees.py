"""URL filter: rules by host and path first, gradient-boosted trees on lexical features for the rest.

URLs that a rule decides are the labelled ones; the trees learn from all of them and judge
the others.  Features: length, depth, digit ratio, entropy, numbers of parameters and
labels, and statistics of suffixes and other parts (last label, last two labels, host,
first label, first path segment): how many URLs share the part, and which share of its
labelled URLs is blocked.  Parts are hashed to ``BUCKETS`` buckets a kind, so the statistics have a
bounded size whatever the number of hosts, and no host is a hot key of a join.

Defined results: a null URL, or one without ``://``, has an empty host and path, no rule and
the trees' verdict; repeated URLs each count; an empty table gives an empty result; with no
labelled URL the verdict is allow, with one kind of label that kind; URLs of any length are
read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, lower_ascii

ALLOW, BLOCK = "allow", "block"
#: Host, start of the path, verdict.
RULES = (("com", "/", ALLOW), ("example.com", "/en/", BLOCK), ("www.example.com", "/en/", ALLOW), ("net", "/es/", BLOCK), ("net", "/fr/", BLOCK))
#: Rules are constants of the plan.
MOST_RULES = 1000
BUCKETS = 1 << 16
#: Labelled URLs that the share of all counts as, beside a part's own.
PRIOR = 5.0
KINDS = 5
TREES, DEPTH, RATE, SEED = 20, 5, 0.3, 7


def host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end, A to Z lower-cased."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """From the host's end up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: tuple, host: Column, path: Column) -> Column:
    """The longest rule that fits, a struct of ``rule`` and ``verdict``; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES}")
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a later one stands before the others
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        chosen = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def parts(host: Column, path: Column) -> Column:
    """Last label, last two labels, host, first label and first path segment."""
    return F.array(F.substring_index(host, ".", -1), F.substring_index(host, ".", -2), host, F.substring_index(host, ".", 1), F.regexp_extract(path, "^/([^/]*)", 1))


def marked(pages: DataFrame, rules: tuple, key: str = "page_id") -> DataFrame:
    """Key, url, host, path, rule, its verdict, ``label`` (1 for blocked, null without a rule) and ``buckets`` of the parts."""
    rows = pages.select(F.col(key), "url").withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    rows = rows.withColumn("_rule", longest_rule(rules, F.col("host"), F.col("path"))).select("*", "_rule.rule", F.col("_rule.verdict").alias("ruled")).drop("_rule")
    bucket = F.transform(parts(F.col("host"), F.col("path")), lambda part, kind: F.pmod(F.xxhash64(kind, part), F.lit(BUCKETS)).cast("int"))
    return rows.withColumn("label", F.when(F.col("ruled").isNotNull(), (F.col("ruled") == BLOCK).cast("double"))).withColumn("buckets", bucket)


def statistics(rows: DataFrame) -> np.ndarray:
    """Per kind of part and bucket: URLs, labelled ones, blocked ones.  At most ``KINDS * BUCKETS`` rows come to the driver."""
    out = np.zeros((KINDS, BUCKETS, 3))
    each = rows.select("label", F.posexplode("buckets").alias("kind", "bucket")).groupBy("kind", "bucket")
    for r in each.agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked")).toLocalIterator():
        out[r["kind"], r["bucket"]] = r["n"], r["labelled"], r["blocked"]
    return out


def lexical(url: str, host: str, path: str) -> list[float]:
    """Length, depth, digit ratio, entropy in bits, numbers of parameters, host labels and hyphens."""
    raw = url.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    share = counts[counts > 0] / n
    query = url.partition("?")[2].partition("#")[0] if "?" in url.partition("#")[0] else ""
    return [len(raw), path.count("/"), counts[48:58].sum() / n, float(-(share * np.log2(share)).sum()), query.count("&") + 1 if query else 0, host.count(".") + 1 if host else 0, counts[45]]


def with_features(rows: DataFrame, stats: np.ndarray) -> DataFrame:
    """``rows`` with ``features``; a labelled URL's own label doesn't count in its statistics."""
    share = rows.sparkSession.sparkContext.broadcast(stats)
    fields = rows.schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = share.value
        overall = (table[0, :, 2].sum() + 1) / (table[0, :, 1].sum() + 2)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            words = np.array([lexical(u.as_py() or "", h.as_py(), p.as_py()) for u, h, p in zip(column["url"], column["host"], column["path"])], dtype=float)
            of = table[np.arange(KINDS), column["buckets"].flatten().to_numpy(zero_copy_only=False).reshape(-1, KINDS)]
            label = column["label"].to_numpy(zero_copy_only=False)[:, None]
            own, known = np.nan_to_num(label), ~np.isnan(label)
            blocked = (of[..., 2] - own + PRIOR * overall) / (of[..., 1] - known + PRIOR)
            features = np.hstack([words, np.log1p(of[..., 0]), blocked])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(features) + 1, dtype=np.int32) * features.shape[1]), pa.array(features.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*fields, "features"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{kinds}, features array<double>")


def judge(pages: DataFrame, rules: tuple = RULES, key: str = "page_id") -> DataFrame:
    """Per row of ``pages``: key, ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``score`` (the trees' chance of block; null where they didn't judge)."""
    rows = marked(pages, rules, key)
    stats = statistics(rows)
    labelled, blocked = stats[0, :, 1].sum(), stats[0, :, 2].sum()
    if not 0 < blocked < labelled:  # nothing to tell apart
        only = F.lit(BLOCK if blocked else ALLOW)
        return rows.select(key, "host", "path", "rule", F.coalesce("ruled", only).alias("verdict"), F.lit(None).cast("double").alias("score"))
    ready = keep(with_features(rows, stats).drop("url", "buckets"), "url-features").withColumn("features", array_to_vector("features"))
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=SEED).fit(ready.filter("label is not null").select("features", "label"))
    score = F.when(F.col("ruled").isNull(), F.get(vector_to_array("probability"), F.lit(1)))
    judged = model.transform(ready).select(key, "host", "path", "rule", "ruled", score.alias("score"))
    return judged.select(key, "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
