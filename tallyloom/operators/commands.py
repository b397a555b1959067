"""Ledger commands in set-based forms, for one command per ledger and round; :mod:`.command_log` folds whole logs in order.

Rejections are rows with a code, never exceptions.  A batch succeeds or fails as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codes import colour_key, plain_code
from ..functions.quantities import LOW_PERCENT, MAX_QTY, parse_percent, parse_quantity, title_blocked
from ..functions.texts import canonical_items, canonical_json, has_risk, payload_key, rejected_items_hold
from ..session import cut
from .command_log import FIRST, FLAG, RESTOCK



def preview_lines(items: DataFrame, stock: DataFrame, palette: DataFrame) -> DataFrame:
    """Items of batch requests against stock, each with its own error.

    ``items``: ledger_id, request, pos, kind, code, qty (long, null if it could not be
    read), estimated (null keeps).  Precedence within an item is the order of checks.
    """
    known = F.broadcast(palette.select(F.col("code").alias("known")))
    have = stock.select("ledger_id", F.col("code").alias("plain"), F.col("qty").alias("qty_before"), F.col("estimated").alias("was_estimated"), F.col("baseline").alias("baseline_before"), F.col("entered").alias("was_entered"))
    rows = items.withColumn("plain", plain_code(F.col("code"))).join(known, F.col("plain") == F.col("known"), "left").join(have, ["ledger_id", "plain"], "left")
    rows = rows.withColumns({"qty_before": F.coalesce("qty_before", F.lit(0)), "was_estimated": F.coalesce("was_estimated", F.lit(True)), "was_entered": F.coalesce("was_entered", F.lit(False))})
    again = F.row_number().over(W.partitionBy("ledger_id", "request", "plain").orderBy("pos")) > 1
    first = F.col("kind") == FIRST
    error = (
        F.when(F.col("known").isNull(), "unknown-color").when(again, "duplicate-color").when(F.col("qty").isNull() | (F.col("qty") < 0) | (F.col("qty") > MAX_QTY), "invalid-number")
        .when(first & F.col("was_entered"), "already-entered").when((F.col("kind") == FLAG) & (F.col("qty") != F.col("qty_before")), "flag-qty-changed")
    )
    baseline = F.when(first | ((F.col("kind") == RESTOCK) & (F.col("qty") > F.col("qty_before"))), F.col("qty")).otherwise(F.col("baseline_before"))
    estimated = F.coalesce(F.col("estimated"), F.when(first & ~F.col("was_entered"), F.lit(True)).otherwise(F.col("was_estimated")))
    return rows.select("ledger_id", "request", "pos", "kind", F.coalesce("plain", "code").alias("code"), "qty_before", F.col("qty").alias("qty_after"), (F.col("qty") - F.col("qty_before")).alias("delta"), F.col("was_estimated").alias("estimated_before"), estimated.alias("estimated_after"), "baseline_before", baseline.alias("baseline_after"), error.alias("error"))


def meaningful() -> Column:
    """Whether a line changes anything, null-safe."""
    same = F.lit(True)
    for c in ("qty", "estimated", "baseline"):
        same &= F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_after"))
    return ~same


def batch_results(lines: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Per request: its first error by position, else restock decreases together, else ok or noop.

    With ``requests`` (ledger_id, request, kind), those that have no line at all are empty-batch.
    """
    decrease = (F.col("kind") == RESTOCK) & (F.col("qty_after") < F.col("qty_before"))
    found = lines.groupBy("ledger_id", "request").agg(
        F.min_by("error", F.when(F.col("error").isNotNull(), F.col("pos"))).alias("error"), F.count_if(decrease).alias("decreases"), F.count_if(meaningful()).alias("changes"), F.min_by("kind", "pos").alias("kind"), F.count("*").alias("items")
    )
    result = F.coalesce("error", F.when(F.col("decreases") > 0, "restock-decrease"), F.when((F.col("changes") == 0) & (F.col("kind") != FIRST), "noop"), F.lit("ok"))
    judged = found.select("ledger_id", "request", "kind", "items", result.alias("result"))
    if requests is None:
        return judged
    empty = requests.select("ledger_id", "request", "kind").join(judged, ["ledger_id", "request"], "left_anti")
    return judged.unionByName(empty.withColumns({"items": F.lit(0).cast("bigint"), "result": F.lit("empty-batch")}))


def committed_moves(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Movements of the requests that went through: changed lines only."""
    ok = results.filter("result = 'ok'").select("ledger_id", "request")
    return lines.join(ok, ["ledger_id", "request"], "left_semi").filter(meaningful()).select("ledger_id", "request", "code", "qty_before", "qty_after", "delta", "baseline_after")


def make_lines(requests: DataFrame, usage: DataFrame, stock: DataFrame) -> DataFrame:
    """Lines of make requests with what is there (``have``) and what is missing (``gap``)."""
    have = stock.select("ledger_id", "code", F.col("qty").alias("have"))
    lines = requests.join(usage, ["pattern_id", "version"], "left").join(have, ["ledger_id", "code"], "left").withColumn("have", F.coalesce("have", F.lit(0)))
    return lines.withColumn("gap", F.greatest(F.col("qty") - F.col("have"), F.lit(0)))


def make_results(requests: DataFrame, usage: DataFrame, stock: DataFrame) -> DataFrame:
    """Per make request, each by itself against the same stock: ok, unconfirmed, or insufficient with the number of short colours and beads.

    ``requests``: ledger_id, request, pattern_id, version (null if unconfirmed).  Requests of a
    ledger don't see each other; :func:`in_round` says which one goes through.
    """
    lines = make_lines(requests, usage, stock)
    found = lines.groupBy("ledger_id", "request", "pattern_id").agg(F.max("version").alias("version"), F.count_if(F.col("gap") > 0).alias("short_colours"), F.coalesce(F.sum("gap"), F.lit(0)).alias("missing"), F.coalesce(F.sum("qty"), F.lit(0)).alias("demand"))
    result = F.when(F.col("version").isNull(), "unconfirmed").when(F.col("short_colours") > 0, "insufficient").otherwise("ok")
    return found.select("ledger_id", "request", "pattern_id", "short_colours", "missing", "demand", result.alias("result"))


def make_gaps(requests: DataFrame, usage: DataFrame, stock: DataFrame) -> DataFrame:
    """The full gap list of each make request that is refused for it."""
    return make_lines(requests, usage, stock).filter("gap > 0").select("ledger_id", "request", "code", F.col("qty").alias("need"), "have", "gap")


def in_round(results: DataFrame) -> DataFrame:
    """The first request of each ledger that is ok: one command a ledger and round changes its stock; the others wait for the next."""
    return results.filter("result = 'ok'").groupBy("ledger_id").agg(F.min("request").alias("request"))


def make_moves(requests: DataFrame, usage: DataFrame, stock: DataFrame) -> DataFrame:
    """Movements of the makes that go through in this round: every colour of the pattern, or none."""
    going = in_round(make_results(requests, usage, stock))
    lines = make_lines(requests, usage, stock).join(going, ["ledger_id", "request"], "left_semi").filter("qty > 0")
    return lines.select("ledger_id", "request", "code", F.col("have").alias("qty_before"), (F.col("have") - F.col("qty")).alias("qty_after"), (-F.col("qty")).alias("delta"))


def void_results(requests: DataFrame, makes: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """Per void request: missing-make, already-voided, invalid-number if a balance would overflow, else ok; and whether it goes through now (C11).

    One void a ledger and round goes through, the first that can: balances are those after it
    for the next.  Later requests for the same make are already-voided then, and only then;
    other good ones wait for the next round (``goes`` is false).
    """
    back = lines.join(makes.select("make_id", "ledger_id"), "make_id").join(stock.select("ledger_id", "code", F.col("qty").alias("have")), ["ledger_id", "code"], "left")
    over = back.filter(F.coalesce("have", F.lit(0)) + F.col("qty") > MAX_QTY).select("make_id").distinct().withColumn("over", F.lit(True))
    rows = requests.join(makes.select("make_id", "ledger_id", "voided"), "make_id", "left").join(over, "make_id", "left")
    result = F.when(F.col("voided").isNull(), "missing-make").when(F.col("voided"), "already-voided").when(F.col("over"), "invalid-number").otherwise("ok")
    judged = rows.withColumn("result", result)
    going = judged.filter("result = 'ok'").groupBy("ledger_id").agg(F.min(F.struct("seq", "request", "make_id")).alias("_g"))
    judged = judged.join(going, "ledger_id", "left")
    first = (F.col("result") == "ok") & (F.col("seq") == F.col("_g.seq")) & (F.col("request") == F.col("_g.request"))
    late = (F.col("result") == "ok") & (F.col("make_id") == F.col("_g.make_id")) & ~first
    return judged.select("request", "make_id", F.when(late, "already-voided").otherwise(F.col("result")).alias("result"), F.coalesce(first, F.lit(False)).alias("goes"))


def settled_voids(requests: DataFrame, makes: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """All void requests that go through when each ledger's are taken one after another by ``seq``: request, make_id, ``goes`` (C11).

    Voids only add to balances, so a void that is refused once stays refused, and of a make's
    requests only the first counts.  A void goes through if it fits even after all before it
    that aren't decided, and is refused if it doesn't fit without them; each round decides at
    least the first open one of every ledger, so the last round leaves none.
    """
    first = requests.groupBy("make_id").agg(F.min(F.struct("seq", "request")).alias("_r")).select("make_id", "_r.*")
    open_ = first.join(makes.filter("not voided").select("make_id", "ledger_id"), "make_id")
    back = lines.filter("qty > 0").groupBy("make_id", "code").agg(F.sum("qty").alias("qty"))
    have = stock.select("ledger_id", "code", F.coalesce("qty", F.lit(0)).alias("have"))
    each = cut(open_.join(back, "make_id").join(have, ["ledger_id", "code"], "left").withColumns({"have": F.coalesce("have", F.lit(0)), "goes": F.lit(None).cast("boolean")}))
    before = W.partitionBy("ledger_id", "code").orderBy("seq", "request").rowsBetween(W.unboundedPreceding, -1)
    after = lambda counted: F.col("have") + F.col("qty") + F.coalesce(F.sum(F.when(counted, F.col("qty"))).over(before), F.lit(0))
    while not each.filter("goes is null").isEmpty():
        judged = each.withColumns({"_most": after(F.coalesce("goes", F.lit(True))), "_least": after(F.coalesce("goes", F.lit(False)))})
        verdicts = judged.filter("goes is null").groupBy("request", "make_id").agg(F.max("_most").alias("_most"), F.max("_least").alias("_least"))
        verdict = F.when(F.col("_most") <= MAX_QTY, True).when(F.col("_least") > MAX_QTY, False)
        each = cut(each.join(verdicts.select("request", "make_id", verdict.alias("_goes")), ["request", "make_id"], "left").withColumn("goes", F.coalesce("goes", "_goes")).drop("_goes"))
    return each.select("request", "make_id", "goes").distinct()


def void_moves(results: DataFrame, makes: DataFrame, lines: DataFrame, stock: DataFrame) -> DataFrame:
    """What the voids that go through add back to current balances, all of a ledger and colour together: the snapshot, not a rollback (C11)."""
    back = results.filter("goes").join(makes.select("make_id", "ledger_id"), "make_id").join(lines.filter("qty > 0"), "make_id").groupBy("ledger_id", "code").agg(F.sum("qty").alias("added"))
    return back.join(stock.select("ledger_id", "code", "qty"), ["ledger_id", "code"], "left").select("ledger_id", "code", "added", (F.coalesce("qty", F.lit(0)) + F.col("added")).alias("qty_after"))


def replays(commands: DataFrame) -> DataFrame:
    """Each command against the first of its request: first, replay (same payload) or request-conflict."""
    first = commands.groupBy("ledger_id", "request_id").agg(F.min("seq").alias("first_seq"), F.min_by("payload", "seq").alias("first_payload"))
    rows = commands.join(first, ["ledger_id", "request_id"])
    state = F.when(F.col("seq") == F.col("first_seq"), "first").when(F.col("payload").eqNullSafe(F.col("first_payload")), "replay").otherwise("request-conflict")
    return rows.select("ledger_id", "seq", "request_id", state.alias("state"))


def check_tokens(commands: DataFrame, heads: DataFrame) -> DataFrame:
    """Commands with ``stale``: their (epoch, seq) isn't the ledger's head (C14)."""
    return commands.join(heads.select("ledger_id", F.col("epoch").alias("head_epoch"), F.col("seq").alias("head_seq")), "ledger_id").withColumn("stale", (F.col("token_epoch") != F.col("head_epoch")) | (F.col("token_seq") != F.col("head_seq")))


def set_percent(settings: DataFrame, requests: DataFrame) -> DataFrame:
    """Settings after the last valid request of each ledger; an equal value is a noop."""
    last = requests.filter(F.col("percent").between(0, 100)).groupBy("ledger_id").agg(F.max_by("percent", "seq").alias("new"))
    return settings.join(last, "ledger_id", "full").select("ledger_id", F.coalesce("new", "low_stock_percent").alias("low_stock_percent"), (F.col("new").isNotNull() & ~F.col("new").eqNullSafe(F.col("low_stock_percent"))).alias("changed"))


def percent_results(settings: DataFrame, requests: DataFrame) -> DataFrame:
    """A row for each request to set the low-stock percentage, in order: invalid-number, noop if the value is there already, else ok.

    ``requests``: ledger_id, seq, percent as text or number; ``settings`` has the value before them all, 10 if none.
    """
    read = parse_percent(F.col("percent").cast("string"))["value"]
    rows = requests.join(settings.select("ledger_id", "low_stock_percent"), "ledger_id", "left").withColumn("_value", read)
    before = F.coalesce(F.last("_value", ignorenulls=True).over(W.partitionBy("ledger_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.col("low_stock_percent").cast("bigint"), F.lit(LOW_PERCENT).cast("bigint"))
    result = F.when(F.col("_value").isNull(), "invalid-number").when(F.col("_value") == before, "noop").otherwise("ok")
    return rows.select("ledger_id", "seq", before.alias("percent_before"), F.coalesce("_value", before).alias("percent_after"), result.alias("result"))


def replace_palette(live: DataFrame, new: DataFrame, key: str = "ledger_id") -> DataFrame:
    """Each ledger's new display palette if its codes are the live ones, else the live one (C4, U1).  221 rows a ledger."""
    codes = lambda rows: rows.groupBy(key).agg(F.array_sort(F.collect_set("code")))  # noqa: E731  at most a catalogue
    fits = codes(live).intersect(codes(new)).select(key)
    return new.join(fits, key, "left_semi").unionByName(live.join(fits, key, "left_anti"))


def create_patterns(manifest: DataFrame) -> DataFrame:
    """Manifest rows as patterns, or rejected with invalid-name or invalid-image."""
    error = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "invalid-name").when(~F.col("accepted"), "invalid-image")
    return manifest.select("*", F.coalesce(error, F.lit("ok")).alias("result"))


def appended_patterns(patterns: DataFrame, created: DataFrame) -> DataFrame:
    """The pattern table with the created rows that went through: unconfirmed, not archived, names trimmed."""
    new = created.filter("result = 'ok'").select("pattern_id", "ledger_id", F.lit(None).cast("int").alias("confirmed_version"), F.lit(False).alias("archived"), F.trim("name").alias("name"))
    return patterns.unionByName(new)


def update_meta(patterns: DataFrame, patches: DataFrame) -> DataFrame:
    """Patterns after patches: what a patch leaves null stays, a blank name is ignored, notes may become blank."""
    new = patches.select("pattern_id", F.nullif(F.trim("name"), F.lit("")).alias("_name"), *[F.trim(c).alias(f"_{c}") for c in ("source_note", "size_note")])
    rows = patterns.join(new, "pattern_id", "left")
    return rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("name", "source_note", "size_note")}).drop("_name", "_source_note", "_size_note")


def archive_results(patterns: DataFrame, requests: DataFrame) -> DataFrame:
    """Per archive request: ok once, then already-archived; the same request id replays."""
    first = requests.groupBy("pattern_id").agg(F.min_by("request_id", "seq").alias("first_request"))
    rows = requests.join(first, "pattern_id").join(patterns.select("pattern_id", "archived"), "pattern_id", "left")
    return rows.select("pattern_id", "seq", "request_id", F.when(F.col("archived").isNull(), "missing-pattern").when(F.col("archived") | (F.col("request_id") != F.col("first_request")), "already-archived").otherwise("ok").alias("result"))


def saved_drafts(drafts: DataFrame) -> DataFrame:
    """One draft a pattern, the last to arrive."""
    return drafts.groupBy("pattern_id").agg(F.max("arrival").alias("arrival"), F.max_by("body", "arrival").alias("body"))


def confirm_results(lines: DataFrame, titles: DataFrame, palette: DataFrame) -> DataFrame:
    """Per pattern: whether its usage can be confirmed, with the sum and the title's difference.

    The first bad line decides, by ``pos`` (without that column, in the order of the catalogue);
    in a line, an unknown colour comes before a repeat, a repeat before a bad quantity.
    """
    known = F.broadcast(palette.select(F.col("code").alias("known")))
    place = F.col("pos") if "pos" in lines.columns else F.struct(colour_key(F.col("code")), "qty")
    marked = lines.withColumn("plain", plain_code(F.col("code"))).withColumn("_pos", place).join(known, F.col("plain") == F.col("known"), "left")
    again = F.row_number().over(W.partitionBy("pattern_id", "plain").orderBy("_pos")) > 1
    error = F.when(F.col("known").isNull(), "unknown-color").when(again, "duplicate-color").when(~F.coalesce(F.col("qty").between(0, MAX_QTY), F.lit(False)), "invalid-number")
    sums = marked.withColumn("_error", error).groupBy("pattern_id").agg(F.sum("qty").alias("line_sum"), F.min_by("_error", F.when(F.col("_error").isNotNull(), F.col("_pos"))).alias("_error"))
    rows = sums.join(titles, "pattern_id", "left").withColumn("difference", F.col("title_total") - F.col("line_sum"))
    blocked = title_blocked(F.col("title_total"), F.col("line_sum"), F.coalesce("ack", F.lit(False)))
    return rows.select("pattern_id", "line_sum", "difference", F.coalesce("_error", F.when(blocked, "title-diff"), F.lit("ok")).alias("result"))


METHODS = ("legend", "grid", "assisted")


def confirm(requests: DataFrame, lines: DataFrame, patterns: DataFrame, palette: DataFrame) -> DataFrame:
    """Confirmations of usage, one a pattern and round, with their result and what a good one writes.

    ``requests``: pattern_id, title_total, ack, rejected (array of raw, qty, note), recognition
    (struct of source, status, risks array with resolved, acknowledged; null if by hand), and if
    the pattern's texts or image are replaced in the same step ``meta`` (struct of name,
    source_note, size_note, image: whether the new image can be read, null without one).
    Order: lines, meta, title, rejected items, recognition, pattern, image.  A request without
    lines confirms that nothing is used.  Good ones have the next ``version``,
    ``input_method``, ``title_diff``, ``title_acknowledged`` and the trimmed ``meta``.
    """
    given = "meta" in requests.columns
    meta = F.col("meta") if given else F.lit(None).cast("struct<name:string,source_note:string,size_note:string,image:boolean>")
    judged = confirm_results(lines, requests.select("pattern_id", "title_total", "ack"), palette).select("pattern_id", F.col("line_sum").alias("_sum"), F.col("result").alias("_lines"))
    known = patterns.select("pattern_id", F.lit(True).alias("_known"), F.coalesce("confirmed_version", F.lit(0)).alias("_version"))
    r = F.col("recognition")
    wrong = ~r["source"].isin(*METHODS) | ~r["status"].isin("ready", "partial", "failed") | r["acknowledged"].isNull()
    rows = requests.join(judged, "pattern_id", "left").join(known, "pattern_id", "left").withColumn("line_sum", F.coalesce("_sum", F.lit(0))).withColumn("difference", F.col("title_total") - F.col("line_sum"))
    blocked = title_blocked(F.col("title_total"), F.col("line_sum"), F.coalesce("ack", F.lit(False)))
    texts = F.when(meta["name"].isNull() | meta["source_note"].isNull() | meta["size_note"].isNull(), "invalid-meta").when(F.trim(meta["name"]) == "", "invalid-name")
    result = F.coalesce(
        F.when(~F.col("_lines").isin("ok", "title-diff"), F.col("_lines")), F.when(meta.isNotNull(), texts), F.when(blocked, "title-diff"), F.when(~rejected_items_hold(F.col("rejected")), "invalid-rejected-item"),
        F.when(r.isNotNull(), F.when(F.coalesce(wrong, F.lit(True)), "invalid-provenance").when(has_risk(r["status"], r["risks"]) & ~r["acknowledged"], "recognition-risk")),
        F.when(F.col("_known").isNull(), "missing-pattern"), F.when(~meta["image"], "invalid-image"), F.lit("ok"),
    )
    rows = rows.withColumn("result", result)
    good = F.col("result") == "ok"
    new = F.struct(*[F.trim(meta[c]).alias(c) for c in ("name", "source_note", "size_note")])
    return rows.select(
        "pattern_id", "line_sum", "result", F.when(good, F.col("_version") + 1).cast("long").alias("version"), F.when(good, F.coalesce(r["source"], F.lit("manual"))).alias("input_method"),
        F.when(good, F.col("difference")).alias("title_diff"), F.when(good, F.coalesce(F.col("difference") != 0, F.lit(False))).alias("title_acknowledged"), F.when(good & meta.isNotNull(), new).alias("meta"),
    )


def confirmed_tables(results: DataFrame, lines: DataFrame, patterns: DataFrame, drafts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New version lines, patterns that point at their new version, and the drafts that are left (C9): all of a good confirmation or nothing."""
    good = results.filter("result = 'ok'").select("pattern_id", F.col("version").alias("_new"), F.col("meta").alias("_meta"))
    usage = lines.join(good, "pattern_id").select("pattern_id", F.col("_new").alias("version"), plain_code(F.col("code")).alias("code"), "qty")
    texts = {c: F.coalesce(F.col("_meta")[c], F.col(c)) for c in ("name", "source_note", "size_note") if c in patterns.columns}
    moved = patterns.join(good, "pattern_id", "left").withColumns({"confirmed_version": F.coalesce("_new", "confirmed_version").cast("long")} | texts).drop("_new", "_meta")
    return usage, moved, drafts.join(good, "pattern_id", "left_anti")


def restore(live: DataFrame, backup: DataFrame, heads: DataFrame, accepted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and heads after replacing all rows of the accepted ledgers: epoch + 1, the backup's seq."""
    ids = accepted.select("ledger_id")
    rows = live.join(ids, "ledger_id", "left_anti").unionByName(backup.join(ids, "ledger_id", "left_semi"), allowMissingColumns=True)
    moved = heads.join(accepted.select("ledger_id", F.col("seq").alias("new_seq")), "ledger_id", "left")
    return rows, moved.select("ledger_id", (F.col("epoch") + F.col("new_seq").isNotNull().cast("long")).alias("epoch"), F.coalesce("new_seq", "seq").alias("seq"))


def restored_requests(live: DataFrame, backup: DataFrame, accepted: DataFrame) -> DataFrame:
    """The journals after a restore: the backup's for the accepted ledgers, each with the restore's own request appended (U4).

    ``accepted``: ledger_id, seq, request_id, exported_at; journals: ledger_id, request_id, payload.
    """
    kept = live.join(accepted, "ledger_id", "left_anti").unionByName(backup.join(accepted, "ledger_id", "left_semi"))
    own = accepted.select("ledger_id", "request_id", canonical_json(kind=F.lit("restore"), seq=F.col("seq"), exportedAt=F.col("exported_at")).alias("payload"))
    return kept.unionByName(own)


def selected_lines(lines: DataFrame) -> DataFrame:
    """Batch lines that are selected and not locked: a first entry locks colours that are entered (P10)."""
    return lines.filter(F.col("selected") & ~((F.col("kind") == FIRST) & F.col("entered")))


def previews_hold(previews: DataFrame, submitted: DataFrame) -> DataFrame:
    """Whether what is submitted is what was previewed: equal snapshots of its selected items."""
    def snapshots(rows: DataFrame, name: str) -> DataFrame:
        item = F.struct("code", F.col("qty").alias("qty"), F.col("estimated").alias("estimated"))
        return rows.groupBy("ledger_id", "request_id").agg(payload_key(canonical_items(F.collect_list(item))).alias(name))

    both = snapshots(previews, "_previewed").join(snapshots(submitted, "_submitted"), ["ledger_id", "request_id"], "left")
    return both.select("ledger_id", "request_id", F.col("_previewed").eqNullSafe(F.col("_submitted")).alias("holds"))


def line_errors(lines: DataFrame, palette: DataFrame) -> DataFrame:
    """Each form line's own error: none for a blank line, then bad-code, repeated-code, or why the quantity is bad.

    ``lines``: form, pos, code and qty as text.
    """
    known = F.broadcast(palette.select(F.col("code").alias("_known")))  # the catalogue
    rows = lines.withColumn("_plain", plain_code(F.col("code"))).join(known, F.col("_plain") == F.col("_known"), "left")
    often = rows.filter("_known is not null").groupBy("form", "_known").agg(F.count("*").alias("_n"))
    rows = rows.join(often, ["form", "_known"], "left")
    blank = (F.trim(F.coalesce("code", F.lit(""))) == "") & (F.coalesce("qty", F.lit("")) == "")
    error = F.when(blank, None).when(F.col("_known").isNull(), "bad-code").when(F.col("_n") > 1, "repeated-code").otherwise(parse_quantity(F.col("qty"))["reason"])
    return rows.select("form", "pos", error.alias("error"))


def valid_sums(lines: DataFrame) -> DataFrame:
    """Per form the sum of the quantities that can be read; others count nothing."""
    return lines.groupBy("form").agg(F.sum(F.coalesce(parse_quantity(F.col("qty"))["value"], F.lit(0))).alias("total"))
