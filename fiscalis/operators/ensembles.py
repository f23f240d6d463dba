"""Boosted ensembles and forests of all regions at once, as tables of tree nodes.

Columns are cut at their exact quantiles per region, rows become vectors of bin numbers, and trees
grow from histograms (`histogram_trees`). Regions of up to `WHOLE_ROWS` train rows are dealt to
tasks and grown there, each in one. The others share every pass: tasks count the histograms of
all of these regions, one shuffle adds them up, and the driver, which sees sums only, cuts. What the
trees so far say of a row is written every `FOLD` trees. Sums are exact integers, so that both ways
give the same trees.

A model is a table: one row per node (ccaa_slug, tree, node, col, threshold, left_node, value, gain, n_rows)
and a row with tree -1 that holds the starting value. Values are contributions: the starting value and one leaf of each
tree add up to the forecast. Its size is regions x trees x nodes, whatever the number of rows, where depth
or leaves are limited; a forest without a limit has up to two nodes a train row and tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscalis.operators.histogram_trees import BINS, Grower, Rules, Tree, count, descend, fixed_scale, grow_whole, integers, poisson_weights
from fiscalis.operators.ranking import positions, value_counts
from fiscalis.session import cut

WHOLE_ROWS = 1 << 20
FOLD = 8          # trees between two writings of the margins
FOREST_BATCH = 16  # trees of a forest that share a pass
FLAG_EDGE = 0.5   # between the two values of a 0/1 column
MODEL = ("ccaa_slug string, tree int, node int, col int, threshold double, left_node int, value double, gain double, n_rows double")
NAMES = [f.split()[0] for f in MODEL.split(", ")]
SUMS = "ccaa_slug string, tree int, sums binary"


def bin_edges(train: DataFrame, numeric: list[str], flags: list[str]) -> dict[str, list[np.ndarray]]:
    """Per region the upper ends of each column's bins but the last, BINS at most."""
    keys = ["ccaa_slug", "variable"]
    long = train.select("ccaa_slug", *numeric).unpivot(["ccaa_slug"], numeric, "variable", "value")
    placed = positions(value_counts(long, keys, "value"), keys)
    ends = placed.groupBy(*keys, F.floor(F.col("below") * BINS / F.col("total")).alias("bin")).agg(F.max("value").alias("top"))
    found: dict[str, dict[str, np.ndarray]] = {}
    for r in ends.groupBy(*keys).agg(F.sort_array(F.collect_list("top")).alias("tops")).collect():
        found.setdefault(r["ccaa_slug"], {})[r["variable"]] = np.array(r["tops"][:-1])
    return {region: [columns.get(c, np.zeros(0)) for c in numeric] + [np.array([FLAG_EDGE])] * len(flags) for region, columns in found.items()}


def _regions(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray]]:
    """Each region of a batch and its rows."""
    names = batch.column(0).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False)
    for i, name in enumerate(names.dictionary.to_pylist()):
        yield name, np.flatnonzero(codes == i)


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)]).astype(float)


def _bin(edges: dict[str, list[np.ndarray]]):
    """(ccaa_slug, number, target, columns...) to (ccaa_slug, number, target, bins)."""
    def run(batches):
        for batch in batches:
            x = _matrix(batch, 3)
            out = np.zeros(x.shape, dtype=np.uint8)
            for region, rows in _regions(batch):
                for j, edge in enumerate(edges[region]):
                    out[rows, j] = np.searchsorted(edge, x[rows, j], side="left")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([r.tobytes() for r in out], pa.binary())],
                                             ["ccaa_slug", "number", "target", "bins"])
    return run


def _bins(column: pa.Array, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, columns)


def _table(region: str, trees: list[Tree], edges: list[np.ndarray], base: float, rules: Rules) -> pa.Table:
    """The rows of a region's model."""
    share = rules.rate if rules.boosted else 1.0 / rules.trees
    parts = [pd.DataFrame({"tree": [-1], "node": [0], "col": [0], "threshold": [0.0], "left_node": [0], "value": [base], "gain": [0.0], "n_rows": [0.0]})]
    for i, t in enumerate(trees):
        # The last bin has no upper end, but no cut lies there either.
        ends = [float(edges[c][b]) if below else 0.0 for c, b, below in zip(t.column, t.bin, t.left, strict=True)]
        parts.append(pd.DataFrame({"tree": i, "node": np.arange(len(t.left)), "col": np.where(t.left > 0, t.column, 0), "threshold": ends, "left_node": t.left,
                                   "value": t.value * share, "gain": t.gain, "n_rows": t.rows}))
    out = pd.concat(parts, ignore_index=True)
    out.insert(0, "ccaa_slug", region)
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split() for f in MODEL.split(", "))])
    return pa.Table.from_pandas(out[NAMES], schema=schema, preserve_index=False)


def _grow_in_task(edges: dict, starts: dict, rules: Rules):
    def run(group: pa.Table) -> pa.Table:
        region = group.column("ccaa_slug")[0].as_py()
        base, scale = starts[region]
        bins = _bins(group.column("bins"), len(edges[region]))
        trees = grow_whole(bins, group.column("target").to_numpy(), group.column("number").to_numpy(), rules, base, scale)
        return _table(region, trees, edges[region], base, rules)
    return run


def _add_trees(bins: np.ndarray, margin: np.ndarray, trees: list[Tree], rate: float) -> np.ndarray:
    for t in trees:
        margin = margin + rate * t.value[descend(bins, t.column, t.bin, t.left)]
    return margin


def _fold(pending: dict[str, list[Tree]], columns: int, rate: float):
    """Rows with the trees since the last writing added to their margin."""
    def run(batches):
        for batch in batches:
            margin, bins = batch.column(4).to_numpy().copy(), _bins(batch.column(3), columns)
            for region, rows in _regions(batch):
                margin[rows] = _add_trees(bins[rows], margin[rows], pending[region], rate)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(margin)], batch.schema.names)
    return run


def _count_part(asked: dict, pending: dict, scales: dict, columns: int, rules: Rules):
    """Rows (ccaa_slug, number, target, bins, margin) to this task's sums of the asked nodes."""
    def run(batches):
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            number, target, bins, margin = batch.column(1).to_numpy(), batch.column(2).to_numpy(), _bins(batch.column(3), columns), batch.column(4).to_numpy()
            for region, rows in _regions(batch):
                if region not in asked:
                    continue
                some = bins[rows]
                left = target[rows] - _add_trees(some, margin[rows], pending[region], rules.rate) if rules.boosted else target[rows]
                goal = integers(left, scales[region])
                for tree, (column, edge, below), wanted in asked[region]:
                    weight = None if rules.boosted else poisson_weights(number[rows], tree, rules.seed)
                    found = count(some, descend(some, column, edge, below), goal, weight, wanted)
                    sums[region, tree] = sums[region, tree] + found if (region, tree) in sums else found
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in sums]), pa.array([t for _, t in sums], pa.int32()),
                                              pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["ccaa_slug", "tree", "sums"])
    return run


def _add(batches):
    total: dict[tuple[str, int], np.ndarray] = {}
    for batch in batches:
        for region, tree, sums in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            now = np.frombuffer(sums)
            total[region, tree] = total[region, tree] + now if (region, tree) in total else now
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in total]), pa.array([t for _, t in total], pa.int32()),
                                          pa.array([s.tobytes() for s in total.values()], pa.binary())], ["ccaa_slug", "tree", "sums"])


def _grow_across(rows: DataFrame, edges: dict, starts: dict, rules: Rules) -> dict[str, list[Tree]]:
    """The trees of regions whose rows are spread over tasks."""
    spark, columns = rows.sparkSession, len(next(iter(edges.values())))
    scales = {r: scale for r, (_, scale) in starts.items()}
    base = F.element_at(F.create_map(*[F.lit(x) for r, (b, _) in starts.items() for x in (r, b)]), F.col("ccaa_slug"))
    kind = "ccaa_slug string, number bigint, target double, bins binary, margin double"
    rows = cut(spark, rows.withColumn("margin", base), "margins")
    grown: dict[str, list[Tree]] = {r: [] for r in starts}
    pending: dict[str, list[Tree]] = {r: [] for r in starts}
    batch = 1 if rules.boosted else FOREST_BATCH
    for first in range(0, rules.trees, batch):
        growers = {r: [Grower(rules, scales[r]) for _ in range(min(batch, rules.trees - first))] for r in starts}
        while True:
            asked = {r: some for r, trees in growers.items() if (some := [(first + i, g.arrays(), g.wanted) for i, g in enumerate(trees) if g.wanted])}
            if not asked:
                break
            parts = rows.mapInArrow(_count_part(asked, pending, scales, columns, rules), SUMS)
            for r in parts.repartition("ccaa_slug", "tree").mapInArrow(_add, SUMS).collect():
                grower = growers[r["ccaa_slug"]][r["tree"] - first]
                grower.counted(np.frombuffer(r["sums"]).reshape(len(grower.wanted), 2, columns, BINS))
        for region, trees in growers.items():
            made = [g.finish() for g in trees]
            grown[region] += made
            if rules.boosted:
                pending[region] += made
        if rules.boosted and len(next(iter(pending.values()))) == FOLD:
            rows = cut(spark, rows.mapInArrow(_fold(pending, columns, rules.rate), kind), "margins")
            pending = {r: [] for r in starts}
    return grown


def fit_trees(train: DataFrame, rules: Rules, numeric: list[str], flags: list[str], target, whole_rows: int = WHOLE_ROWS) -> DataFrame:
    """The model table of all regions of `train` (ccaa_slug, number, columns without NULL); `number` tells rows apart."""
    spark, columns = train.sparkSession, [*numeric, *flags]
    edges = bin_edges(train, numeric, flags)
    if not edges:
        return spark.createDataFrame([], MODEL)
    rows = cut(spark, train.select("ccaa_slug", F.col("number").cast("long"), target.cast("double").alias("target"), *[F.col(c).cast("double") for c in columns]).mapInArrow(
        _bin(edges), "ccaa_slug string, number bigint, target double, bins binary"), "binned")
    starts, large = {}, []
    for r in rows.groupBy("ccaa_slug").agg(F.count("number").alias("n"), F.max(F.abs("target")).alias("top"), F.avg("target").alias("mean")).collect():
        # Rounded, so that the order in which rows are summed doesn't show.
        base = float(np.float32(r["mean"])) if rules.boosted else 0.0
        starts[r["ccaa_slug"]] = base, fixed_scale(r["n"], r["top"])
        if r["n"] > whole_rows:
            large.append(r["ccaa_slug"])
    small = rows.where(~F.col("ccaa_slug").isin(large)) if large else rows
    # The number is set, as small partitions would be put together: the work of a region is not the size of its rows.
    dealt = small.repartition(4 * len(starts), "ccaa_slug")
    out = cut(spark, dealt.groupBy("ccaa_slug").applyInArrow(_grow_in_task(edges, starts, rules), MODEL), "trees")
    if large:
        some = {r: starts[r] for r in large}
        grown = _grow_across(rows.where(F.col("ccaa_slug").isin(large)), edges, some, rules)
        tables = pa.concat_tables([_table(r, trees, edges[r], some[r][0], rules) for r, trees in grown.items()])
        out = out.unionByName(cut(spark, spark.createDataFrame(tables), "trees"))
    return out


def _forecast(model: dict[str, dict[str, np.ndarray]]):
    """(ccaa_slug, number, columns...) to (number, forecast)."""
    def run(batches):
        for batch in batches:
            x, out = _matrix(batch, 2), np.zeros(batch.num_rows)
            for region, rows in _regions(batch):
                m, some = model[region], x[rows]
                for lo in range(0, len(rows), 4096):
                    part = some[lo:lo + 4096]
                    at = np.broadcast_to(m["root"], (len(part), len(m["root"])))
                    where = np.arange(len(part))[:, None]
                    while (m["left"][at] > 0).any():
                        below = m["left"][at]
                        at = np.where(below > 0, below + (part[where, m["col"][at]] > m["threshold"][at]), at)
                    out[rows[lo:lo + 4096]] = m["base"] + m["value"][at].sum(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out)], ["number", "forecast"])
    return run


def forecast_trees(rows: DataFrame, model: DataFrame, numeric: list[str], flags: list[str]) -> DataFrame:
    """(number, forecast) of the rows of regions that have a model."""
    held: dict[str, dict[str, np.ndarray]] = {}
    for region, part in model.toPandas().groupby("ccaa_slug"):
        nodes = part[part["tree"] >= 0].sort_values(["tree", "node"])
        size = nodes.groupby("tree").size().to_numpy()
        root = np.cumsum(size) - size
        left = nodes["left_node"].to_numpy()
        held[region] = {
            "root": root, "left": np.where(left > 0, left + np.repeat(root, size), 0), "col": nodes["col"].to_numpy(),
            "threshold": nodes["threshold"].to_numpy(), "value": nodes["value"].to_numpy(), "base": float(part.loc[part["tree"] < 0, "value"].iloc[0])}
    known = rows.where(F.col("ccaa_slug").isin(list(held))) if held else rows.limit(0)
    return known.select("ccaa_slug", F.col("number").cast("long"), *[F.col(c).cast("double") for c in (*numeric, *flags)]).mapInArrow(
        _forecast(held), "number bigint, forecast double")


def importances(model: DataFrame, columns: list[str], top: int = 10) -> DataFrame:
    """(ccaa_slug, variable, importancia): each tree's gains as shares, averaged over the trees, the largest of a region."""
    from pyspark.sql import Window
    trees = model.where("tree >= 0").groupBy("ccaa_slug", "tree", "col").agg(F.sum("gain").alias("gain"))
    whole = F.sum("gain").over(Window.partitionBy("ccaa_slug", "tree"))
    shares = trees.withColumn("share", F.when(whole > 0, F.col("gain") / whole).otherwise(F.lit(0.0))).groupBy("ccaa_slug", "col").agg(F.sum("share").alias("share"))
    total = F.sum("share").over(Window.partitionBy("ccaa_slug"))
    names = F.array(*[F.lit(c) for c in columns])
    ranked = shares.select("ccaa_slug", names[F.col("col")].alias("variable"), F.when(total > 0, F.col("share") / total).otherwise(F.lit(0.0)).alias("importancia"))
    order = Window.partitionBy("ccaa_slug").orderBy(F.col("importancia").desc(), "variable")
    return ranked.withColumn("_k", F.row_number().over(order)).where((F.col("_k") <= top) & (F.col("importancia") > 0)).drop("_k")
