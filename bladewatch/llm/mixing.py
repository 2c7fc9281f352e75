"""Mixing sources to target weights: budgets by water-filling, drawn by Efraimidis-Spirakis keys.

A source whose target is at least its size enters as complete epochs; the rest of the target is drawn without
replacement: each document gets an exponential key divided by its quality weight, the keys are sorted within the
source, and the sizes are prefix-summed to the budget. The document at the budget's edge is cut there.

No document is sorted globally and no source lands in one task. Where a source is cut is found from two histograms of
the key (sizes per cell, pre-aggregated), and only the documents of the one cell that holds the edge are ordered. A
cell of the second histogram holds about one of CELLS ** 2 documents of its source. The outcome is one row per source
(epochs, edge, words left at the edge); against it every document is judged on its own, so texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from bladewatch.llm.common import bounded, own_row, stored, words_of

WEIGHTS = (5, 2, 1)  # by the order of the sources, repeating
MAX_EPOCHS = 3
SEED = "mix-1"
CELLS = 4096
LEAST_QUALITY = 0.05


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, falling by the share of markup-like symbols per word to LEAST_QUALITY."""
    symbols = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^#*$%&|<>]+", ""))
    return F.greatest(F.lit(LEAST_QUALITY), F.lit(1.0) - symbols / F.greatest(size, F.lit(1)))


def sampling_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) taken from a digest of seed and id, so that reruns agree."""
    digest = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 12)
    u = (F.conv(digest, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return -F.ln(u) / weight


def targets(sizes: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (_mx_null, _mx_source, source_size).

    Water-filling in closed form: in the order of cap / weight, a source is at its cap if the rate that is left
    after all earlier caps still reaches it; the others get the final rate times their weight.
    """
    by_name = Window.orderBy("_mx_null", "_mx_source")  # one row per source: a bounded dimension
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)).cast("long"))
    ranked = ranked.withColumn("_cap", F.col("source_size") * max_epochs)
    whole = Window.orderBy(F.col("_cap") / F.col("_weight"), "_mx_null", "_mx_source")
    before = whole.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rate = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / (
        F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0)))
    marked = ranked.withColumn("_rate", rate).withColumn("_full", F.col("_cap") <= F.col("_rate") * F.col("_weight"))
    final = F.coalesce(F.max(F.when(~F.col("_full"), F.col("_rate"))).over(everything), F.lit(0.0))
    return marked.withColumn(
        "target", F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(final * F.col("_weight"))
    ).select("_mx_null", "_mx_source", "source_size", "target")


def _cell(key: Column, low: Column | float, width: Column | float) -> Column:
    """Cell of the key among CELLS equal parts of [low, low + width) of 1 - exp(-key), which rises with the key."""
    part = F.floor((F.lit(1.0) - F.exp(-key) - low) / width * CELLS)
    return F.least(F.greatest(part, F.lit(0)), F.lit(CELLS - 1)).cast("int")


def _edge_cell(rows: DataFrame, wanted: DataFrame, cell: str, budget: str, name: str) -> DataFrame:
    """The cell in which each source's running size passes the budget, and the budget left for it."""
    keys = ["_mx_null", "_mx_source"]
    upto = Window.partitionBy(*keys).orderBy(cell)
    cells = rows.groupBy(*keys, cell).agg(F.sum("_mx_size").alias("_in"))
    run = cells.withColumn("_upto", F.sum("_in").over(upto)).join(F.broadcast(wanted), keys)
    hit = run.filter(F.col("_upto") > F.col(budget)).groupBy(*keys).agg(
        F.min_by(F.struct(F.col(cell).alias("c"), (F.col(budget) - F.col("_upto") + F.col("_in")).alias("left")), cell)
        .alias("_hit"))
    return hit.select(*keys, F.col("_hit.c").alias(name), F.col("_hit.left").alias(f"{name}_left"))


def mixing_plan(rows: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: sizes, target, epochs and the edge (key, id, hash, words each row there still gives).

    ``rows`` is stored and narrow: (_mx_null, _mx_source, _mx_id, _mx_size, _mx_key, _mx_hash).
    """
    keys = ["_mx_null", "_mx_source"]
    rows = rows.withColumn("_c1", _cell(F.col("_mx_key"), 0.0, 1.0))
    sizes = rows.groupBy(*keys).agg(F.sum("_mx_size").alias("source_size"))
    goal = targets(sizes, weights, max_epochs)
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0)
    plan = goal.withColumn("_epochs", F.least(full, F.lit(max_epochs)).cast("long")).withColumn(
        "_rest", (F.floor(F.col("target") + 0.5) - F.col("_epochs") * F.col("source_size")).cast("long"))
    plan = stored(plan)
    wanted = bounded(plan.select(*keys, "_rest"))
    first = stored(_edge_cell(rows, wanted, "_c1", "_rest", "_e1"))
    near = rows.join(bounded(first), keys).filter("_c1 = _e1").withColumn(
        "_c2", _cell(F.col("_mx_key"), F.col("_e1") / CELLS, F.lit(1.0 / CELLS)))
    near = stored(near.select(*keys, "_mx_id", "_mx_size", "_mx_key", "_mx_hash", "_c2", "_e1_left"))
    second = stored(_edge_cell(
        near, near.groupBy(*keys).agg(F.max("_e1_left").alias("_e1_left")), "_c2", "_e1_left", "_e2"))
    order = ["_mx_key", "_mx_id", "_mx_hash"]
    upto = Window.partitionBy(*keys).orderBy(*order)
    ties = near.join(bounded(second), keys).filter("_c2 = _e2").groupBy(*keys, *order, "_e2_left").agg(
        F.sum("_mx_size").alias("_in"), F.count(F.lit(1)).alias("_n"))
    edge = ties.withColumn("_upto", F.sum("_in").over(upto)).filter("_upto > _e2_left").groupBy(*keys).agg(
        F.min_by(F.struct(*order, F.floor((F.col("_e2_left") - F.col("_upto") + F.col("_in")) / F.col("_n"))
                          .cast("long").alias("_give")), F.struct(*order)).alias("_edge"))
    return plan.join(edge, keys, "left")


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", size: Column | None = None) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target`` and ``taken`` (words the mix takes, repeats counted) to each row.

    Sizes are words; a null or empty text has 0 and gives 0. A null source is a source of its own, the last one.
    Rows with equal id and text share one key and, at the edge, the words left. A null id is drawn like any
    other. Extra columns pass through, but those named as the four results are replaced. No rows give no rows.
    """
    names = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    own = docs.select(*names)
    counted = own.withColumns({
        "_mx_null": F.col(source_col).isNull(), "_mx_source": F.coalesce(F.col(source_col), F.lit("")),
        "_mx_id": F.col(id_col), "_mx_size": F.size(words_of(F.col(text_col))).cast("long") if size is None else size,
        "_mx_hash": F.xxhash64(text_col)})
    keyed = counted.withColumn(
        "_mx_key", sampling_key(F.col("_mx_id"), quality_weight(F.col(text_col), F.col("_mx_size")), seed))
    narrow = ["_mx_null", "_mx_source", "_mx_id", "_mx_size", "_mx_key", "_mx_hash"]
    plan = bounded(stored(mixing_plan(stored(keyed.select(*narrow)), weights, max_epochs)))
    return _judged(keyed, plan, names)


def _judged(keyed: DataFrame, plan: DataFrame, names: list[str]) -> DataFrame:
    edge = F.col("_edge")
    at = F.struct(F.col("_mx_key"), F.col("_mx_id"), F.col("_mx_hash"))
    mark = F.struct(edge["_mx_key"].alias("_mx_key"), edge["_mx_id"].alias("_mx_id"), edge["_mx_hash"].alias("_mx_hash"))
    drawn = F.when(edge.isNull() | (at < mark), F.col("_mx_size")).when(at == mark, edge["_give"]).otherwise(F.lit(0))
    # without an edge the budget takes every document of the source, which happens only if all sizes are 0
    return keyed.join(plan, ["_mx_null", "_mx_source"]).select(
        *names, F.col("_mx_size").alias("size"), "source_size", "target",
        (F.col("_epochs") * F.col("_mx_size") + drawn).cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
               chars_col: str = "n_chars", **options) -> DataFrame:
    """The mixed corpus: each document once per complete copy taken, and the edge document's last, cut copy.

    The cut copy holds the first words, joined by single spaces; its ``n_chars``, if there is one, is counted anew. All
    other columns keep their values, whatever their names.
    """
    wanted = docs.select(own_row(docs, "_mx_row"), F.col(id_col).alias("_mx_doc"), F.col(text_col).alias("_mx_text"),
                         F.col(source_col).alias("_mx_from"))
    taken = mix(wanted, id_col="_mx_doc", text_col="_mx_text", source_col="_mx_from", **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.greatest("size", F.lit(1)))).otherwise(F.lit(0))
    cut = F.col("taken") - whole * F.col("size")
    copies = F.concat(
        F.array_repeat(F.lit(0).cast("long"), whole.cast("int")), F.when(cut > 0, F.array(cut)).otherwise(F.array()))
    out = taken.withColumn("_mx_cut", F.explode(copies))
    part = F.array_join(F.slice(words_of(F.col("_mx_text")), F.lit(1), F.col("_mx_cut").cast("int")), " ")
    is_cut, row = F.col("_mx_cut") > 0, F.col("_mx_row")
    out = out.withColumn("_mx_text", F.when(is_cut, part).otherwise(F.col("_mx_text")))
    new = {text_col: F.col("_mx_text"), chars_col: F.when(is_cut, F.length("_mx_text")).otherwise(row[chars_col])
           if chars_col in docs.columns else None}
    return out.select(*[(row[c] if new.get(c) is None else new[c]).alias(c) for c in docs.columns])
