"""Matrices in long form (i, j, v), losses and metrics, edit rates and bitmap runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product of (i, k, v) and (k, j, v)."""
    return a.alias("a").join(b.alias("b"), F.col("a.k") == F.col("b.k")).groupBy("i", "j").agg(F.sum(F.col("a.v") * F.col("b.v")).alias("v"))


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def cellwise(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """Sum, difference or product of two matrices, cell by cell."""
    x, y = F.col("a.v"), F.col("b.v")
    v = {"add": x + y, "subtract": x - y, "hadamard": x * y}[op]
    return a.alias("a").join(b.alias("b"), (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))).select(F.col("a.i").alias("i"), F.col("a.j").alias("j"), v.alias("v"))


def add_bias(m: DataFrame, bias: DataFrame) -> DataFrame:
    """m with the bias (j, v) of each column added."""
    return m.alias("m").join(bias.alias("b"), F.col("m.j") == F.col("b.j")).select("m.i", "m.j", (F.col("m.v") + F.col("b.v")).alias("v"))


def column_sums(m: DataFrame) -> DataFrame:
    return m.groupBy("j").agg(F.sum("v").alias("v"))


def ragged(rows: DataFrame) -> DataFrame:
    """Rows (i, row) of a nested matrix whose length is not that of the first."""
    first = rows.agg(F.min_by(F.size("row"), "i").alias("n"))  # one row
    return rows.crossJoin(F.broadcast(first)).where(F.size("row") != F.col("n")).drop("n")


def sigmoid(v: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), v))))


def relu(v: Column) -> Column:
    return F.greatest(F.lit(0.0), v)


def leaky_relu(v: Column, slope: float = 0.01) -> Column:
    return F.when(v > 0, v).otherwise(v * slope)


def softmax(m: DataFrame) -> DataFrame:
    """Each row's exponentials, shifted by its maximum, over their sum."""
    row = Window.partitionBy("i")
    e = m.withColumn("e", F.exp(F.col("v") - F.max("v").over(row)))
    return e.select("i", "j", (F.col("e") / F.sum("e").over(row)).alias("v"))


def argmax(m: DataFrame) -> DataFrame:
    """i, j of the largest value of each row, the smallest j among equals."""
    return m.groupBy("i").agg(F.max_by("j", F.struct("v", -F.col("j"))).alias("j"))


def clamp(p: Column) -> Column:
    return F.greatest(F.lit(1e-7), F.least(F.lit(1 - 1e-7), p))


def losses(cells: DataFrame) -> DataFrame:
    """mse, bce (by cells) and cce (by rows) of cells (i, j, p, y)."""
    p, y = clamp(F.col("p")), F.col("y")
    return cells.agg(
        F.avg((F.col("p") - y) * (F.col("p") - y)).alias("mse"),
        (-F.avg(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("bce"),
        (-F.sum(y * F.log(p)) / F.countDistinct("i")).alias("cce"),
    )


def confusion(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """actual, predicted, n for every pair of classes; classes (c) is a table of labels."""
    grid = classes.select(F.col("c").alias("actual")).join(classes.select(F.col("c").alias("predicted")))
    n = pairs.groupBy("actual", "predicted").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))


def one_hot(v: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == v).cast("int"))


def character_error_rate(expected: Column, predicted: Column) -> Column:
    n = F.length(expected)
    return F.when(n > 0, F.levenshtein(expected, predicted) / F.nullif(n, F.lit(0))).otherwise((F.length(predicted) > 0).cast("double"))


def word_error_rate(pairs: DataFrame) -> DataFrame:
    """id, wer of (id, expected, predicted): word edits over expected words. Each pair's words become characters."""

    @F.pandas_udf("double")
    def rate(expected: pd.Series, predicted: pd.Series) -> pd.Series:
        out = []
        for e, p in zip(expected, predicted, strict=True):
            a, b = e.split(), p.split()
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                old, row[0] = row[0], i
                for j, y in enumerate(b, 1):
                    old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
            out.append(row[-1] / len(a) if a else float(bool(b)))
        return pd.Series(out)

    return pairs.select("id", rate("expected", "predicted").alias("wer"))


def otsu(values: DataFrame) -> DataFrame:
    """threshold of values (v from 0 to 255): the first that separates the histogram into the most different halves.

    256 rows at most meet in the windows.
    """
    h = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    low = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy()
    h = h.select("v", F.sum("n").over(low).alias("w"), F.sum(F.col("v") * F.col("n")).over(low).alias("s"), F.sum("n").over(every).alias("n"), F.sum(F.col("v") * F.col("n")).over(every).alias("total"))
    h = h.where("w < n")
    gap = F.col("s") / F.col("w") - (F.col("total") - F.col("s")) / (F.col("n") - F.col("w"))
    h = h.withColumn("between", F.col("w").cast("double") * (F.col("n") - F.col("w")) * gap * gap)
    return h.agg(F.coalesce(F.max_by("v", F.struct("between", -F.col("v"))), F.lit(127)).cast("long").alias("threshold"))


def runs(cells: DataFrame, by: str = "line", at: str = "x") -> DataFrame:
    """by, start, size of each run of consecutive active places (by, at, active)."""
    on = cells.where("active")
    island = F.col(at) - F.row_number().over(Window.partitionBy(by).orderBy(at))
    return on.withColumn("g", island).groupBy(by, "g").agg(F.min(at).alias("start"), F.count(F.lit(1)).alias("size")).select(by, "start", "size")


def gaps(found: DataFrame, by: str = "line") -> DataFrame:
    """by, start, gap: free places before each run but the first."""
    w = Window.partitionBy(by).orderBy("start")
    return found.select(by, "start", (F.col("start") - F.lag(F.col("start") + F.col("size")).over(w)).alias("gap")).where("gap is not null")


def text_runs(lines: DataFrame) -> DataFrame:
    """line, start, size of the runs of letters a-z of (line, text), and gap to the run before; no exchange."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, text in zip(batch.column("line").to_pylist(), batch.column("text").to_pylist(), strict=True):
                c = np.frombuffer((text or "").encode("utf-32-le"), np.uint32)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], (c >= 97) & (c <= 122), [False]]).astype(np.int8)))
                start, end = edge[::2], edge[1::2]
                gap = pa.array(np.concatenate([[0], start[1:] - end[:-1]])[: len(start)].astype(np.int64), mask=np.arange(len(start)) == 0)
                yield pa.RecordBatch.from_arrays([pa.array([line] * len(start), pa.int64()), pa.array(start.astype(np.int64)), pa.array((end - start).astype(np.int64)), gap], ["line", "start", "size", "gap"])

    return lines.select(F.col("line").cast("long").alias("line"), "text").mapInArrow(find, "line long, start long, size long, gap long")


def word_gap(gap: DataFrame) -> DataFrame:
    """threshold of gaps (gap): the middle of the largest jump between sorted gaps if it stands out, else beyond the largest."""
    g = gap.where("gap > 0")
    distinct = g.groupBy("gap").agg(F.count(F.lit(1)).alias("n"))
    w = Window.orderBy("gap")
    jump = distinct.select("gap", F.lead("gap").over(w).alias("after")).withColumn("jump", F.col("after") - F.col("gap"))
    best = jump.agg(F.max_by(F.struct("gap", "after", "jump"), F.struct("jump", -F.col("gap"))).alias("b"), F.max("gap").alias("largest"), F.count(F.lit(1)).alias("kinds"))
    typical = g.agg(F.expr("percentile(gap, 0.5)").alias("typical"))
    b, t = best.crossJoin(F.broadcast(typical)), F.col("typical")  # one row each
    clear = (F.col("b.jump") >= F.greatest(F.lit(2.0), t * 0.75)) & (F.col("largest") >= t * 1.8)
    return b.select(F.when(clear & (F.col("kinds") > 1), (F.col("b.gap") + F.col("b.after")) / 2.0).otherwise(F.col("largest") + 1).cast("double").alias("threshold"))


def denoise(cells: DataFrame) -> DataFrame:
    """y, x of the active cells with an active neighbour among the eight around them."""
    on = cells.where("active").select("y", "x")
    around = on.select(F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])).alias("p")).select("p.*").distinct()
    return on.join(around, ["y", "x"], "left_semi")


def glyphs(cells: DataFrame, height: int = 9, width: int = 7) -> DataFrame:
    """line, glyph, v: each run of inked columns of a line (line, y, x, active), cut to its ink and resized to height x width.

    A target cell takes its nearest source cell; v is the flat list of 0.0 and 1.0.
    """
    ink = cells.where("active")
    columns = ink.select("line", "x", F.lit(True).alias("active")).distinct()
    found = runs(columns).withColumn("glyph", F.row_number().over(Window.partitionBy("line").orderBy("start")).cast("long"))
    inside = ink.alias("c").join(found.alias("f"), (F.col("c.line") == F.col("f.line")) & (F.col("c.x") >= F.col("f.start")) & (F.col("c.x") < F.col("f.start") + F.col("f.size"))).select("f.line", "glyph", "start", "size", "y", "x")
    box = inside.groupBy("line", "glyph", "start", "size").agg(F.min("y").alias("top"), F.max("y").alias("bottom"), F.collect_set(F.struct("y", "x")).alias("on"))
    tall = F.col("bottom") - F.col("top") + 1
    rows, cols = F.sequence(F.lit(0), F.lit(height - 1)), F.sequence(F.lit(0), F.lit(width - 1))

    def cell(j, i):
        y = F.col("top") + F.floor(j * tall / F.lit(height))
        x = F.col("start") + F.floor(i * F.col("size") / F.lit(width))
        return F.exists("on", lambda p: (p["y"] == y) & (p["x"] == x)).cast("double")

    return box.select("line", "glyph", F.flatten(F.transform(rows, lambda j: F.transform(cols, lambda i: cell(j, i)))).alias("v"))


def recognized(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """i, label, confidence: the best class of each row of scores (i, j, v), ? where it is under least."""
    best = scores.groupBy("i").agg(F.max(F.struct("v", (-F.col("j")).alias("j"))).alias("b"))
    return best.select("i", F.when(F.col("b.v") >= least, (-F.col("b.j")).cast("string")).otherwise("?").alias("label"), F.col("b.v").alias("confidence"))


def derivatives(v: Column) -> dict[str, Column]:
    """Derivatives of the activations at v."""
    s = sigmoid(v)
    return {"sigmoid": s * (1 - s), "relu": F.when(v > 0, 1.0).otherwise(0.0), "leaky": F.when(v > 0, 1.0).otherwise(0.01), "tanh": 1 - F.tanh(v) * F.tanh(v)}


def loss_derivatives(p: Column, y: Column, n: Column) -> dict[str, Column]:
    """Derivatives of mse, bce and cce by a prediction p of n."""
    q = clamp(p)
    return {"mse": 2 * (p - y) / n, "bce": ((1 - y) / (1 - q) - y / q) / n, "cce": -y / q / n}


def binary_accuracy(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """accuracy of (p, y): whether p reaches the threshold as y does."""
    return pairs.agg(F.avg(((F.col("p") >= threshold) == (F.col("y") >= threshold)).cast("double")).alias("accuracy"))


def perplexity(found: DataFrame) -> DataFrame:
    """mean_loss and perplexity (its exponential, of 20 at most) of the probabilities p of what came."""
    loss = F.avg(-F.log(clamp(F.col("p"))))
    return found.agg(loss.alias("mean_loss"), F.exp(F.least(F.lit(20.0), loss)).alias("perplexity"))


def ink_sums(cells: DataFrame, axis: str) -> DataFrame:
    """axis (y or x) and n: active cells of each row or column."""
    return cells.groupBy(axis).agg(F.sum(F.col("active").cast("long")).alias("n"))
