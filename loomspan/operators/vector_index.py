"""A persisted inverted file of vectors with product-quantised codes.

``build`` fits centroids and code books on a bounded sample and writes three tables under a path: ``cells``
(cell, top, centroid), ``books`` (part, code, word) and ``vectors`` (cell, row, id, code, embedding), sorted by
cell. ``add`` files more vectors under the same centroids. ``search`` compares queries with the short codes
in the nearest cells, takes the ``refine`` times ``k`` nearest by code, and ranks those by their vectors.

The number of cells follows the square root of the table up to MAX_CELLS; centroids have two levels, so a
vector meets some 2 * sqrt(cells) of them. Codes are read without the vectors; cells are dealt to shards of
SHARD_ROWS codes, a cell larger than that to several, and queries to lots of LOT, so no task grows with the
table, a hot cell or the questions. Only centroids, books and cell sizes reach the driver.

Vectors and queries that are null, of another length than the index's, or hold null or non-finite components
take no part. Rows alike in id and vector are one; of an id with several vectors the nearest counts. Ties go to the smaller
id. An empty table gives an index in which nothing is found. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.sources.scratch import written

SAMPLE = 65_536  # rows that centroids and books are fitted on
MAX_CELLS = 4_096
PARTS, WORDS = 16, 256  # a code has a byte a part
SHARD_ROWS, LOT = 16_384, 1_024
ROUNDS = 10


def _valid(col: Column, dim: int | None = None) -> Column:
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(col) == dim if dim else F.size(col) > 0) & finite, F.lit(False))


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0.0)


def _means(x: np.ndarray, k: int) -> np.ndarray:
    """``k`` means of the rows (all rows, if fewer), begun at rows spread over them."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = _squares(x, c).argmin(1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(np.float64)


class _Model:
    """Centroids of both levels and code books, as arrays: at most MAX_CELLS and PARTS * WORDS rows."""

    def __init__(self, cells: list, books: list):
        self.cell_top = np.array([r.top for r in cells], int)
        self.centroids = np.array([r.centroid for r in cells], np.float64)
        tops = np.unique(self.cell_top)
        self.members = [np.flatnonzero(self.cell_top == t) for t in tops]
        self.tops = np.stack([self.centroids[m].mean(0) for m in self.members])
        self.books = [np.array([r.word for r in books if r.part == p], np.float64) for p in sorted({r.part for r in books})]

    def cell_of(self, x: np.ndarray) -> np.ndarray:
        top, out = _squares(x, self.tops).argmin(1), np.zeros(len(x), int)
        for t in np.unique(top):
            at = np.flatnonzero(top == t)
            out[at] = self.members[t][_squares(x[at], self.centroids[self.members[t]]).argmin(1)]
        return out

    def pieces(self, dim: int) -> list[np.ndarray]:
        return np.array_split(np.arange(dim), min(PARTS, dim))

    def encode(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        rest = x - self.centroids[cell]
        return np.stack([_squares(rest[:, at], book).argmin(1) for at, book in zip(self.pieces(x.shape[1]), self.books)], 1).astype(np.uint8)

    def decode(self, code: np.ndarray, cell: np.ndarray) -> np.ndarray:
        out = self.centroids[cell].copy()
        for p, at in enumerate(self.pieces(out.shape[1])):
            out[:, at] += self.books[p][code[:, p]]
        return out


def _read(spark: SparkSession, path: str, what: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{what}")


def _model(spark: SparkSession, path: str) -> _Model | None:
    cells = _read(spark, path, "cells").orderBy("cell").collect()
    return _Model(cells, _read(spark, path, "books").orderBy("part", "code").collect()) if cells else None


def build(vectors: DataFrame, path: str, *, id_col: str = "node_id", vector_col: str = "embedding", sample: int = SAMPLE, max_cells: int = MAX_CELLS) -> None:
    """Fit an index on ``sample`` rows of least hash and file every vector under ``path``."""
    spark = vectors.sparkSession
    values = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), values.alias("embedding")).where(_valid(F.col("embedding")))
    # The length of most vectors is the index's; the lesser of two as common.
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    n, dim = (common["count"], common["dim"]) if common else (0, 1)
    rows = rows.where(F.size("embedding") == dim)
    picked = written(rows.withColumn("h", F.xxhash64("id", "embedding")).orderBy("h").limit(sample).select("h", "embedding"), "index-sample")
    k = int(min(max_cells, max(1, round(n**0.5)), max(1, sample // 16)))
    n_tops = max(1, round(k**0.5))

    def ordered(frame: pd.DataFrame) -> np.ndarray:
        return _matrix(frame.sort_values("h")["embedding"])

    def fit_tops(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"centroid": list(_means(ordered(frame), n_tops))})

    tops = np.array([r.centroid for r in picked.groupBy().applyInPandas(fit_tops, "centroid array<double>").collect()], np.float64)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(top=_squares(_matrix(f["embedding"]), tops).argmin(1).astype(np.int32))

    def fit_cells(frame: pd.DataFrame) -> pd.DataFrame:
        share = max(1, round(k * len(frame) / min(n, sample)))
        return pd.DataFrame({"top": frame["top"].iloc[0], "centroid": list(_means(ordered(frame), share))})

    fine = picked.mapInPandas(place, "h long, embedding array<double>, top int").groupBy("top").applyInPandas(fit_cells, "top int, centroid array<double>")
    cells = fine.withColumn("cell", F.row_number().over(Window.orderBy("top", "centroid")) - 1)  # as many rows as cells
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    fitted = [r for r in _read(spark, path, "cells").orderBy("cell").collect()]
    model = _Model(fitted, []) if fitted else None

    def residuals(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _matrix(f["embedding"])
                rest = x - model.centroids[model.cell_of(x)]
                for p, at in enumerate(model.pieces(dim)):
                    yield pd.DataFrame({"h": f["h"], "part": p, "embedding": list(rest[:, at])})

    def fit_book(frame: pd.DataFrame) -> pd.DataFrame:
        words = _means(ordered(frame), WORDS)
        return pd.DataFrame({"part": frame["part"].iloc[0], "code": range(len(words)), "word": list(words)})

    books = picked.mapInPandas(residuals, "h long, part int, embedding array<double>").groupBy("part").applyInPandas(fit_book, "part int, code int, word array<double>")
    books.write.mode("overwrite").parquet(f"{path}/books")
    _file(rows, path, "overwrite")


def _file(rows: DataFrame, path: str, mode: str) -> None:
    """Write rows (id, embedding) under their cells with their codes."""
    spark = rows.sparkSession
    model = _model(spark, path)
    schema = f"cell int, row long, id {rows.schema['id'].dataType.simpleString()}, code binary, embedding array<double>"

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x = _matrix(f["embedding"])
                cell = model.cell_of(x)
                yield pd.DataFrame({"cell": cell.astype(np.int32), "row": f["row"], "id": f["id"], "code": [c.tobytes() for c in model.encode(x, cell)], "embedding": f["embedding"]})

    keyed = rows.withColumn("row", F.xxhash64("id", "embedding")).dropDuplicates(["row", "id"]).select("row", "id", "embedding")
    out = keyed.mapInPandas(coded, schema) if model else spark.createDataFrame([], schema)
    out.repartitionByRange("cell", "row").sortWithinPartitions("cell", "row").write.mode(mode).parquet(f"{path}/vectors")


def add(vectors: DataFrame, path: str, *, id_col: str = "node_id", vector_col: str = "embedding") -> None:
    """File the vectors that the index lacks; centroids and books stay. An index built on nothing must be built anew."""
    spark = vectors.sparkSession
    first = _read(spark, path, "cells").first()
    if first is None:
        raise ValueError("the index was built on an empty table")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.where(_valid(F.col("embedding"), len(first.centroid))).withColumn("row", F.xxhash64("id", "embedding"))
    new = rows.join(_read(spark, path, "vectors").select("row", "id"), ["row", "id"], "left_anti").drop("row")
    _file(written(new, "index-new"), path, "append")


def _shards(sizes: dict[int, int], n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """First shard and number of shards of each cell: neighbours share a shard while they fit, a large cell has several."""
    first, parts, shard, held = np.zeros(n_cells, int), np.ones(n_cells, int), 0, 0
    for cell in range(n_cells):
        n = sizes.get(cell, 0)
        if held and held + n > SHARD_ROWS:
            shard, held = shard + 1, 0
        first[cell], parts[cell] = shard, max(1, -(-n // SHARD_ROWS))
        if parts[cell] > 1:
            shard, held = shard + parts[cell], 0
        else:
            held += n
    return first, parts


def search(queries: DataFrame, path: str, *, k: int = 10, probe: float = 0.7, refine: int = 20, query_col: str = "query_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, distance)``: the ``k`` nearest of each query by squared distance, among the vectors in the nearest cells (``probe`` is their share).

    Recall rises with ``probe`` and ``refine``; both at their limits (1.0, all rows) search everything.
    Query ids name one query each; of an id with several vectors all are asked and the nearest hits count.
    """
    spark = queries.sparkSession
    model, index = _model(spark, path), _read(spark, path, "vectors")
    q_type, id_type = queries.schema[query_col].dataType.simpleString(), index.schema["id"].dataType.simpleString()
    if model is None:
        return spark.createDataFrame([], f"query_id {q_type}, rank int, id {id_type}, distance double")
    n_cells, dim = model.centroids.shape
    n_probe, wide = max(1, round(n_cells * probe)), refine * k
    asked = queries.select(F.col(query_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).where(_valid(F.col("q"), dim))
    n_lots = max(1, -(-asked.count() // LOT))
    asked = asked.withColumn("ask", F.xxhash64("query_id", "q"))
    sizes = {r.cell: r["count"] for r in index.groupBy("cell").count().collect()}  # at most MAX_CELLS
    first, parts = _shards(sizes, n_cells)
    of_cell = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(n_cells)], "cell int, first int, parts int")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query once a shard that holds cells near it, with those cells."""
        for f in frames:
            if not len(f):
                continue
            near = np.argsort(_squares(_matrix(f["q"]), model.centroids), 1, kind="stable")[:, :n_probe]
            out = []
            for ask, q, mine in zip(f["ask"], f["q"], near):
                home = first[mine]
                for s in np.unique(home):
                    cells = mine[home == s]
                    out += [(ask, q, int(s) + j, cells.tolist()) for j in range(int(parts[cells].max()))]
            yield pd.DataFrame(out, columns=["ask", "q", "shard", "cells"])

    def scan(probes: pd.DataFrame, codes: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(codes):
            return pd.DataFrame({"ask": [], "row": [], "near": []})
        codes = codes.sort_values("row")
        cell, row = codes["cell"].to_numpy(), codes["row"].to_numpy()
        x = model.decode(np.frombuffer(b"".join(codes["code"]), np.uint8).reshape(len(codes), -1), cell)
        asks, found, near = [], [], []
        for at in range(0, len(probes), 64):
            some = probes.iloc[at : at + 64]
            d = _squares(_matrix(some["q"]), x)
            for ask, cells, line in zip(some["ask"], some["cells"], d):
                line = np.where(np.isin(cell, cells), line, np.inf)
                best = np.argsort(line, kind="stable")[:wide] if len(line) <= 4 * wide else np.argpartition(line, wide)[:wide]
                best = best[np.isfinite(line[best])]
                asks.append(np.full(len(best), ask))
                found.append(row[best])
                near.append(line[best])
        return pd.DataFrame({"ask": np.concatenate(asks), "row": np.concatenate(found), "near": np.concatenate(near)})

    lot = F.pmod(F.xxhash64(F.lit(3), "ask"), F.lit(n_lots)).cast("int")
    probes = asked.select("ask", "q").dropDuplicates(["ask"]).mapInPandas(route, "ask long, q array<double>, shard int, cells array<int>").withColumn("lot", lot)
    shard = (F.col("first") + F.pmod(F.xxhash64(F.lit(4), "row"), F.col("parts"))).cast("int")
    codes = index.select("cell", "row", "code").join(F.broadcast(of_cell), "cell").select("cell", "row", "code", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(n_lots - 1))).alias("lot"))
    hits = probes.groupBy("shard", "lot").cogroup(codes.groupBy("shard", "lot")).applyInPandas(scan, "ask long, row long, near double")
    coarse = F.row_number().over(Window.partitionBy("ask").orderBy("near", "row"))
    short = written(hits.withColumn("r", coarse).where(F.col("r") <= wide).select("ask", "row"), "index-candidates")
    exact = short.join(index.select("row", "id", "embedding"), "row").join(asked, "ask").withColumn("distance", T.squared_l2(F.col("embedding"), F.col("q")))
    one = exact.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return one.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "distance")
