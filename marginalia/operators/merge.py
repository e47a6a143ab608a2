"""Fragments of highlights to whole highlights, strokes to regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.geometry import axis_gap, column_side, overlap_ratio
from marginalia.operators.ordered import CHUNK, HOT_ROWS, OrderedGroups, same_keys, split_hot
from marginalia.operators.spatial import PAGE, with_side
from marginalia.session import durable, written

# When two fragments belong together, in page points and parts of a line.
SAME_LINE_OVERLAP = 0.5
SAME_LINE_GAP = 30.0
WRAP_GAP_LINES = 1.0
WRAP_INDENT = 20.0
SHADOW_GAP = 100.0

# Rows of a page that are compared with one another, and folded in one row; larger pages are cut up.
BUCKET_ROWS = 2_000
PIECE_ROWS = 4_096
GRAM = 3
FAN = 64

BOX = ["x", "y", "w", "h"]
RUN = ["doc", "page", "color"]


# --- fragments inside their neighbours -------------------------------------------------------------------------------


def _grams(text: Column, shortest: int) -> Column:
    """All runs of ``shortest`` to GRAM letters of ``text``, once each."""
    runs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda p: F.array(*[F.substring(text, p, F.lit(n)) for n in range(shortest, GRAM + 1)]),
    )
    return F.array_distinct(F.flatten(runs))


def _indexed(nodes: DataFrame, sizes: DataFrame, bucket_rows: int) -> DataFrame:
    """``nodes`` of large pages with ``bucket``, where a text is looked up, and ``buckets``, where it is found.

    A text has all runs of letters of a text that it contains, so it is enough to look for the shorter text's rarest
    run on the page.  ``sizes (doc, page, n)`` sets how many buckets a page's runs are dealt to: one for each
    ``bucket_rows`` rows.
    """
    known = nodes.join(sizes.withColumn("k", F.ceil(F.col("n") / bucket_rows).cast("int")).drop("n"), PAGE)
    place = lambda gram: F.pmod(F.xxhash64(gram), F.col("k")).cast("int")
    own = known.select(*PAGE, "seq", "text", F.explode(_grams(F.col("text"), 1)).alias("gram"))
    often = own.groupBy(*PAGE, "gram").agg(F.count(F.lit(1)).alias("often"))
    # Of a text shorter than GRAM the run is the text itself.
    whole = F.length("gram") == F.least(F.length("text"), F.lit(GRAM))
    rarest = own.filter(whole).join(often, PAGE + ["gram"]).groupBy(*PAGE, "seq").agg(F.min_by("gram", F.struct("often", "gram")).alias("gram"))
    found = F.array_distinct(F.transform(_grams(F.col("text"), 1), place))
    return known.join(rarest, PAGE + ["seq"], "left").withColumns({"bucket": place(F.coalesce("gram", F.lit(""))), "buckets": found}).drop("gram", "k")


def _inside(max_gap: float) -> Column:
    """Whether the node of the columns ``b_`` holds that of ``a_``: a longer text with the other's in it, in the same column, and near."""
    gap = axis_gap(F.col("a_x"), F.col("a_w"), F.col("b_x"), F.col("b_w")) + axis_gap(
        F.col("a_y"), F.col("a_h"), F.col("b_y"), F.col("b_h")
    )
    return (
        (F.col("a_side") == F.col("b_side"))
        & (F.length("a_text") >= 1)
        & (F.length("a_text") < F.length("b_text"))
        & F.contains("b_text", "a_text")
        & (gap <= max_gap)
    )


def _held(asked: DataFrame, nodes: DataFrame, max_gap: float, **found: Column) -> DataFrame:
    """Per node of ``asked`` that some of ``nodes`` hold, the aggregates ``found`` over these.

    Pairs are compared where they meet and never passed on.
    """
    left = asked.select(*PAGE, "bucket", *[F.col(c).alias(f"a_{c}") for c in ("seq", "side", "text", *BOX)])
    right = nodes.withColumn("bucket", F.explode("buckets"))
    right = right.select(*PAGE, "bucket", "waits", *[F.col(c).alias(f"b_{c}") for c in ("seq", "side", "text", *BOX)])
    # A small table of columns is many times as large in memory, so its size on disk must not have it broadcast.
    met = left.join(right.hint("merge"), PAGE + ["bucket"]).filter(_inside(max_gap))
    return met.groupBy(*PAGE, "bucket", F.col("a_seq").alias("seq")).agg(*[c.alias(n) for n, c in found.items()]).drop("bucket")


def _fates(nodes: DataFrame, max_gap: float) -> tuple[DataFrame, DataFrame]:
    """(the last holder of each node that has one, the nodes that are dropped).

    In order of ``seq`` a node goes when a later one holds it, or an earlier one that was itself kept.  So after one
    search only those wait whose holders all come before them.  Each round settles those of which some holder is known
    to be kept, or all are known to be dropped, and writes a row per node that waits, however many hold it.
    """
    node = PAGE + ["seq"]
    last = durable(_held(nodes, nodes.withColumn("waits", F.lit(False)), max_gap, holder=F.max("b_seq")))
    dropped = last.filter(F.col("holder") > F.col("seq")).select(*node)
    waiting = last.filter(F.col("holder") < F.col("seq")).select(*node)
    while not waiting.isEmpty():
        known = dropped.withColumn("waits", F.lit(False)).unionByName(waiting.withColumn("waits", F.lit(True)))
        marked = nodes.join(known, node, "left")
        left = marked.filter(F.col("waits").isNull() | F.col("waits")).withColumn("waits", F.col("waits").isNotNull())
        held = durable(_held(marked.filter("waits"), left, max_gap, kept=F.bool_or(~F.col("waits"))))
        dropped = dropped.unionByName(held.filter("kept").select(*node))
        waiting = held.filter(~F.col("kept")).select(*node)
    return last, dropped


def _drop_on_pages(fragments: DataFrame, gutters: DataFrame, max_gap: float) -> DataFrame:
    """``drop_shadowed`` on pages that are small enough to be one row each.

    Fragments are dealt by page once: those of a page are compared, settled and left out where they lie.
    """
    rest = [c for c in fragments.columns if c not in PAGE]
    # Set apart ahead of the exchange: where both readers of it ask for the same rows, Spark makes it once.
    known = F.col("doc").isNotNull() & F.col("page").isNotNull()
    placed, unplaced = fragments.filter(known), fragments.filter(~known)
    # The columns of a page a fragment lies in, a bit each: two gutters of one page may say different ones.
    lanes = gutters.groupBy(*PAGE).agg(F.collect_set(F.struct("gutter_x")).alias("_gutters"))
    sides = F.transform("_gutters", lambda g: column_side(F.col("x"), F.col("w"), g["gutter_x"]))
    bits = F.when(F.array_contains(sides, 0), 1).otherwise(0) + F.when(F.array_contains(sides, 1), 2).otherwise(0)
    row = F.struct(*rest, F.when(F.col("_gutters").isNull(), 1).otherwise(bits).alias("_side"))
    pages = placed.repartition(*PAGE).join(lanes, PAGE, "left").select(*PAGE, row.alias("_row")).groupBy(*PAGE).agg(F.collect_list("_row").alias("_rows"))
    pairs = pages.select(*PAGE, "_rows", F.explode("_rows").alias("a")).select(*PAGE, "a", F.explode("_rows").alias("b"))
    columns = {f"{s}_{c}": F.col(f"{s}.{c}") for s in "ab" for c in ("seq", "text", *BOX)}
    met = pairs.select(
        *PAGE, *[c.alias(n) for n, c in columns.items()], F.lit(0).alias("a_side"), F.when(F.col("a._side").bitwiseAND(F.col("b._side")) != 0, 0).alias("b_side")
    ).filter(F.col("a_x").isNotNull() & F.col("b_x").isNotNull() & _inside(max_gap))
    held = met.groupBy(*PAGE, F.col("a_seq").alias("seq")).agg(
        F.max("b_seq").alias("last"), F.collect_set(F.when(F.col("b_seq") < F.col("a_seq"), F.col("b_seq"))).alias("holders"), F.bool_or(F.col("b_seq").isNull()).alias("nameless")
    )
    # In order of ``seq`` a node goes when a later one holds it, or an earlier one that was itself kept.
    waits = F.col("last") < F.col("seq")
    node = F.struct("seq", (F.col("last") > F.col("seq")).alias("goes"), (waits & F.col("nameless")).alias("nameless"), F.when(waits, F.col("holders")).alias("holders"))
    none = F.array().cast(f"array<{fragments.schema['seq'].dataType.simpleString()}>")

    def step(dropped: Column, n: Column) -> Column:
        kept_before = n["nameless"] | (F.size(F.array_except(n["holders"], dropped)) > 0)
        return F.when(n["goes"] | kept_before, F.concat(dropped, F.array(n["seq"]))).otherwise(dropped)

    dropped = held.groupBy(*PAGE).agg(F.array_sort(F.collect_list(node)).alias("nodes")).select(*PAGE, F.aggregate("nodes", none, step).alias("_dropped"))
    stays = lambda r: ~F.coalesce(F.array_contains("_dropped", r["seq"]), F.lit(False))
    kept = pages.join(dropped.hint("merge"), PAGE, "left").select(*PAGE, F.inline_outer(F.filter("_rows", stays)))
    return kept.filter(F.col("_side").isNotNull()).select(*fragments.columns).unionByName(unplaced)


def _drop_on_large_pages(fragments: DataFrame, gutters: DataFrame, max_gap: float, bucket_rows: int) -> DataFrame:
    """``drop_shadowed`` on pages whose fragments meet in buckets of an index over runs of letters."""
    boxed = with_side(fragments.filter(F.col("x").isNotNull()), gutters)
    rows = written(boxed.select(*PAGE, "seq", "side", "text", *BOX))
    alike = PAGE + ["side", "text", *BOX]
    copies = durable(rows.groupBy(*alike).agg(F.max("seq").alias("seq")))
    sizes = durable(copies.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")))
    nodes = durable(_indexed(copies, sizes, bucket_rows))
    last, dropped = _fates(nodes, max_gap)
    fates = last.join(dropped.withColumn("dropped", F.lit(True)), PAGE + ["seq"], "left")
    side = copies.join(fates, PAGE + ["seq"]).select(*[F.col(c).alias(f"_n_{c}") for c in alike], "holder", "dropped")
    earlier = rows.join(side, same_keys(rows, side, alike, "_n_")).filter(F.col("dropped").isNotNull() | (F.col("seq") < F.col("holder"))).select(*PAGE, "seq")
    return fragments.join(dropped.unionByName(earlier), PAGE + ["seq"], "left_anti")


def drop_shadowed(fragments: DataFrame, gutters: DataFrame, max_gap: float = SHADOW_GAP, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Drop fragments whose text is part of a longer one near them in the same column; boxless ones stay.

    The fragments of a page are compared in one row.  Those of a page of more than ``bucket_rows`` rows meet in buckets
    of an index over runs of letters, as many as the page has multiples of that.  There copies, alike in text and box, are
    one node, known by its last ``seq``: their holders are the same, those before the last holder go, and the rest share one fate.
    """
    cold, hot, _ = split_hot(fragments, PAGE, bucket_rows)
    kept = _drop_on_pages(cold, gutters, max_gap)
    return kept if hot is None else kept.unionByName(_drop_on_large_pages(hot, gutters, max_gap, bucket_rows))


# --- fragments of one highlight --------------------------------------------------------------------------------------


def joined_text(left: Column, right: Column) -> Column:
    """One blank between the texts, unless an edge is blank already; an absent text is empty."""
    left, right = F.coalesce(left, F.lit("")), F.coalesce(right, F.lit(""))
    edge = left.endswith(" ") | right.startswith(" ")
    closed = F.replace(F.concat(left, right), F.lit("  "), F.lit(" "))
    return F.when(left == "", right).when(right == "", left).when(edge, closed).otherwise(F.concat(left, F.lit(" "), right))


def _continues(last: dict[str, Column], f: dict[str, Column]) -> tuple[Column, Column]:
    """(goes on along the line, may go on one line below); the second also depends on the run's left edge."""
    same_line = overlap_ratio(last["y"], last["h"], f["y"], f["h"]) >= SAME_LINE_OVERLAP
    along = f["x"] - (last["x"] + last["w"])
    below = f["y"] - (last["y"] + last["h"])
    wraps = ~same_line & (below > 0) & (below <= (last["h"] + f["h"]) / 2.0 * WRAP_GAP_LINES)
    return same_line & (along >= 0) & (along < SAME_LINE_GAP), wraps


def _fold_page(fragments: Column) -> Column:
    """Runs of an ordered array of fragments.  State: finished runs and the open one."""

    def opened(f: Column) -> Column:
        return F.struct(
            f["seq"].alias("seq"),
            f["text"].alias("text"),
            f["x"].alias("x"),
            f["y"].alias("y"),
            (f["x"] + f["w"]).alias("right"),
            (f["y"] + f["h"]).alias("bottom"),
            F.struct(*[f[c].alias(c) for c in BOX]).alias("last"),
            F.lit(1).alias("fragments"),
        )

    def step(state: Column, f: Column) -> Column:
        run = state["run"]
        along, wraps = _continues({c: run["last"][c] for c in BOX}, {c: f[c] for c in BOX})
        goes_on = along | (wraps & (F.abs(f["x"] - run["x"]) < WRAP_INDENT))
        longer = F.struct(
            run["seq"].alias("seq"),
            joined_text(run["text"], f["text"]).alias("text"),
            F.least(run["x"], f["x"]).alias("x"),
            F.least(run["y"], f["y"]).alias("y"),
            F.greatest(run["right"], f["x"] + f["w"]).alias("right"),
            F.greatest(run["bottom"], f["y"] + f["h"]).alias("bottom"),
            F.struct(*[f[c].alias(c) for c in BOX]).alias("last"),
            (run["fragments"] + 1).alias("fragments"),
        )
        return F.struct(
            F.when(goes_on, state["done"]).otherwise(F.concat(state["done"], F.array(run))).alias("done"),
            F.when(goes_on, longer).otherwise(opened(f)).alias("run"),
        )

    first = opened(F.get(fragments, F.lit(0)))
    start = F.struct(F.slice(F.array(first), 1, 0).alias("done"), first.alias("run"))
    rest = F.slice(fragments, F.lit(2), F.size(fragments))
    return F.aggregate(rest, start, step, lambda s: F.concat(s["done"], F.array(s["run"])))


RUN_COLUMNS = ["seq", "text", "x", "y", "w", "h", "fragments"]


def _merge_whole_pages(boxed: DataFrame) -> DataFrame:
    # Sorted natively; array_sort would call a comparator for each pair.
    ordered = F.sort_array(F.collect_list(F.struct("side", "y", "x", "seq", "w", "h", "text")))
    runs = boxed.groupBy(*RUN).agg(ordered.alias("f")).select(*RUN, F.inline(_fold_page(F.col("f"))))
    return runs.select(
        *RUN, "seq", "text", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "fragments"
    )


# How a stretch of fragments maps the left edge of the run that is open before it to that of the run open after it:
# the first of ``entries`` that the edge does not pass gives the edge after (``to``); an edge that passes all of them
# becomes ``rest``, or stays if that is null.  An edge passes an entry if it is not right of ``x`` and, unless the
# fragment goes on along the line, not WRAP_INDENT left of it.  ``hi`` and ``lo`` are what all entries let pass.
ENTRY = "struct<x:double,along:boolean,to:double>"


def _edge_after(left: Column, x: Column, along: Column, wraps: Column) -> Column:
    return F.when(along | (wraps & (F.abs(x - left) < WRAP_INDENT)), F.least(left, x)).otherwise(x)


def _mapped(edges: Column, left: Column) -> Column:
    """The edge that ``left`` becomes; a null one is before the page's first fragment."""
    stops = F.filter(edges["entries"], lambda e: (left > e["x"]) | (~e["along"] & (F.abs(e["x"] - left) >= WRAP_INDENT)))
    return F.coalesce(F.get(stops, F.lit(0))["to"], edges["rest"], left)


def _entry(x: Column, along: Column, to: Column) -> Column:
    return F.struct(x.alias("x"), along.alias("along"), to.alias("to"))


def _edge_map(fragments: Column) -> Column:
    """The map of an ordered array of fragments (x, along, wraps)."""
    null = F.lit(None).cast("double")
    none = F.array().cast(f"array<{ENTRY}>")
    start = F.struct(none.alias("entries"), null.alias("hi"), null.alias("lo"), null.alias("rest"))

    def step(edges: Column, f: Column) -> Column:
        x, along, wraps = f["x"], f["along"], f["wraps"]
        passed = edges["rest"].isNull() & (along | wraps)
        moved = F.transform(edges["entries"], lambda e: _entry(e["x"], e["along"], _edge_after(e["to"], x, along, wraps)))
        higher = edges["hi"].isNull() | (x < edges["hi"])
        lower = ~along & (edges["lo"].isNull() | (x > edges["lo"]))
        rest = F.when(edges["rest"].isNotNull(), _edge_after(edges["rest"], x, along, wraps)).when(~(along | wraps), x)
        return F.struct(
            F.when(passed & (higher | lower), F.concat(moved, F.array(_entry(x, along, x)))).otherwise(moved).alias("entries"),
            F.when(passed, F.least(edges["hi"], x)).otherwise(edges["hi"]).alias("hi"),
            F.when(passed & ~along, F.greatest(edges["lo"], x)).otherwise(edges["lo"]).alias("lo"),
            rest.alias("rest"),
        )

    return F.aggregate(fragments, start, step)


def _composed(maps: Column) -> Column:
    """One map in place of an ordered array of them."""

    def step(first: Column, then: Column) -> Column:
        moved = F.transform(first["entries"], lambda e: _entry(e["x"], e["along"], _mapped(then, e["to"])))
        met = F.filter(
            then["entries"],
            lambda e: first["hi"].isNull() | (e["x"] < first["hi"]) | (~e["along"] & (first["lo"].isNull() | (e["x"] > first["lo"]))),
        )
        rest = F.when(first["rest"].isNotNull(), _mapped(then, first["rest"])).otherwise(then["rest"])
        return F.struct(
            F.when(first["rest"].isNull(), F.concat(moved, met)).otherwise(moved).alias("entries"),
            F.when(first["rest"].isNull(), F.least(first["hi"], then["hi"])).otherwise(first["hi"]).alias("hi"),
            F.when(first["rest"].isNull(), F.greatest(first["lo"], then["lo"])).otherwise(first["lo"]).alias("lo"),
            rest.alias("rest"),
        )

    return F.aggregate(F.slice(maps, 2, F.size(maps)), F.get(maps, F.lit(0)), step)


def _edges_before(maps: DataFrame, pieces: int, fan: int) -> DataFrame:
    """(run columns, piece, left): the open left edge before each piece of ``maps`` (run columns, piece, map).

    A tree: maps of ``fan`` neighbours are composed until a page has at most ``fan``; then the edges go down again.
    """
    group = RUN + ["above"]
    levels = [maps]
    while pieces > fan:
        pieces = -(-pieces // fan)
        gathered = levels[-1].withColumn("above", F.floor(F.col("piece") / fan)).groupBy(*group)
        gathered = gathered.agg(F.array_sort(F.collect_list(F.struct("piece", "map"))).alias("m"))
        levels.append(gathered.select(*RUN, F.col("above").alias("piece"), _composed(F.col("m.map")).alias("map")))
    edges = None
    for level in reversed(levels):
        spread = level.withColumn("above", F.floor(F.col("piece") / fan) if edges is not None else F.lit(0).cast("bigint"))
        gathered = spread.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("piece", "map"))).alias("m"))
        if edges is None:
            gathered = gathered.withColumn("left", F.lit(None).cast("double"))
        else:
            side = edges.select(*[F.col(k).alias(f"_a_{k}") for k in RUN], F.col("piece").alias("_a_above"), "left")
            gathered = gathered.join(side, same_keys(gathered, side, group, "_a_"))
        handed = F.aggregate(
            F.slice("m", 1, F.size("m") - 1),
            F.array(F.col("left")),
            lambda lefts, p: F.concat(lefts, F.array(_mapped(p["map"], F.element_at(lefts, -1)))),
        )
        pairs = F.explode(F.arrays_zip(F.col("m.piece").alias("piece"), handed.alias("left"))).alias("e")
        edges = gathered.select(*RUN, pairs).select(*RUN, F.col("e.piece").alias("piece"), F.col("e.left").alias("left"))
    return edges


def _run_starts(fragments: Column, left: Column) -> Column:
    """Which of an ordered array of fragments (seq, x, along, wraps) start a run, after an open run with that left edge."""
    start = F.struct(left.alias("left"), F.array().cast("array<struct<seq:bigint,starts:boolean>>").alias("marked"))

    def step(state: Column, f: Column) -> Column:
        goes_on = F.coalesce(f["along"] | (f["wraps"] & (F.abs(f["x"] - state["left"]) < WRAP_INDENT)), F.lit(False))
        mark = F.struct(f["seq"].alias("seq"), (~goes_on).alias("starts"))
        return F.struct(
            F.when(goes_on, F.least(state["left"], f["x"])).otherwise(f["x"]).alias("left"), F.concat(state["marked"], F.array(mark)).alias("marked")
        )

    return F.aggregate(fragments, start, step, lambda s: s["marked"])


def _merge_in_pieces(boxed: DataFrame, piece_rows: int, fan: int) -> DataFrame:
    """The same runs on pages cut into ordered pieces, folded side by side.

    Only the run's left edge crosses a piece's border.  Each piece is folded twice: into its map of that edge, and,
    when the maps have told the edge before it, into the starts of its runs.
    """
    groups = OrderedGroups(boxed, RUN, ["side", "y", "x", "seq"], piece_rows).previous("_last", F.struct(*BOX))
    last = {c: F.col("_last")[c] for c in BOX}
    along, wraps = _continues(last, {c: F.col(c) for c in BOX})
    rows = groups.df if groups.hot else groups.df.withColumn(CHUNK, F.lit(-1))
    rows = durable(
        rows.withColumn("_along", F.coalesce(along, F.lit(False))).withColumn("_wraps", F.coalesce(wraps, F.lit(False))).drop("_last")
    )
    # Pages within the limit are the piece -1, which is their only one.
    line = F.struct("side", "y", "x", "seq", F.col("_along").alias("along"), F.col("_wraps").alias("wraps"))
    pieces = rows.groupBy(*RUN, F.col(CHUNK).cast("bigint").alias("piece")).agg(F.array_sort(F.collect_list(line)).alias("f"))
    edges = _edges_before(pieces.select(*RUN, "piece", _edge_map(F.col("f")).alias("map")), groups.chunks if groups.hot else 1, fan)
    side = edges.select(*[F.col(k).alias(f"_e_{k}") for k in [*RUN, "piece"]], "left")
    known = pieces.join(side, same_keys(pieces, side, [*RUN, "piece"], "_e_")).select(*RUN, F.inline(_run_starts(F.col("f"), F.col("left"))))
    marked = known.select(*[F.col(k).alias(f"_s_{k}") for k in [*RUN, "seq"]], "starts")
    groups.df = rows.join(marked, same_keys(rows, marked, RUN + ["seq"], "_s_")).drop(*[f"_s_{k}" for k in [*RUN, "seq"]])
    numbered = groups.running_sum("_run", F.col("starts").cast("long")).result()
    ordered = F.array_sort(F.collect_list(F.struct("side", "y", "x", "seq", "text")))
    runs = numbered.groupBy(*RUN, "_run").agg(
        ordered.alias("f"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("right"),
        F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.count(F.lit(1)).cast("int").alias("fragments"),
    )
    text = F.aggregate(F.slice("f", 2, F.size("f")), F.get("f", F.lit(0))["text"], lambda t, f: joined_text(t, f["text"]))
    return runs.select(
        *RUN, F.get("f", F.lit(0))["seq"].alias("seq"), text.alias("text"), "x", "y",
        (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "fragments",
    )


def merge_fragments(
    fragments: DataFrame, gutters: DataFrame, piece_rows: int = PIECE_ROWS, sizes: DataFrame | None = None, fan: int = FAN
) -> DataFrame:
    """Fragments of one page and colour that continue each other, along a line or on the next, as whole highlights.

    A highlight keeps the ``seq`` of its first fragment.  Boxless fragments pass unchanged.  A page is folded in pieces of
    about ``piece_rows`` rows; an ordinary page is one.  ``sizes`` may name a cheaper table, with at least the same rows
    per page, to find by it the pages that have more.
    """
    boxless = fragments.filter(F.col("x").isNull()).withColumn("fragments", F.lit(1))
    boxed = with_side(fragments.filter(F.col("x").isNotNull()), gutters)
    cold, hot, _ = split_hot(boxed, PAGE, piece_rows, fragments if sizes is None else sizes)
    merged = _merge_whole_pages(cold)
    if hot is not None:
        merged = merged.unionByName(_merge_in_pieces(hot, piece_rows, fan))
    columns = RUN + RUN_COLUMNS
    return merged.select(*columns).unionByName(boxless.select(*columns))


def whole_highlights(fragments: DataFrame, gutters: DataFrame) -> DataFrame:
    """Shadowed fragments out, the rest merged."""
    return merge_fragments(drop_shadowed(fragments, gutters), gutters, sizes=fragments)


# --- strokes and sources ---------------------------------------------------------------------------------------------


def merge_stroke_regions(
    strokes: DataFrame, gap: float = 40.0, limit: int = HOT_ROWS, sizes: DataFrame | None = None
) -> DataFrame:
    """Strokes of a page from top to bottom; a new region begins after a gap or with another colour.

    ``sizes`` is counted for large pages instead of ``strokes``, when those are costly to read.
    """
    groups = OrderedGroups(strokes, PAGE, ["y", "stroke_id"], limit, sizes)
    groups.previous("_above", F.struct((F.col("y") + F.col("h")).alias("bottom"), "color"))
    far = (F.col("y") - F.col("_above.bottom") > gap) | ~F.col("color").eqNullSafe(F.col("_above.color"))
    groups.running_sum("region", F.when(F.col("_above").isNull() | far, 1).otherwise(0))
    regions = groups.result().groupBy(*PAGE, "region").agg(
        F.min("color").alias("color"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("w")).alias("right"),
        F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.count(F.lit(1)).alias("stroke_count"),
    )
    return regions.select(
        *PAGE, "region", "color", "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "stroke_count"
    )


def merge_highlight_sources(a: DataFrame, b: DataFrame, dedupe: bool = True) -> DataFrame:
    """Highlights of two extractors; unless ``dedupe`` is off, those of ``b`` whose identifier ``a`` has are left out."""
    rest = b.join(a.select("id").distinct(), "id", "left_anti") if dedupe else b
    return a.unionByName(rest)
