"""Optional reader of annotated HDF5 matrices as a Spark data source (needs h5py, imported on first use)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Range(InputPartition):
    """Rows start to stop of a matrix, or columns if it is stored by column."""

    def __init__(self, start: int, stop: int, by_column: bool) -> None:
        super().__init__((start, stop, by_column))
        self.start, self.stop, self.by_column = start, stop, by_column


def compressed(data: np.ndarray, indices: np.ndarray, edges: np.ndarray, start: int, by_column: bool) -> Iterator[tuple]:
    """(cell, gene, value) of a run of compressed rows (or columns); edges are their bounds within data."""
    major = np.repeat(np.arange(start, start + len(edges) - 1), np.diff(edges))
    keep = data != 0
    cells, genes = (indices, major) if by_column else (major, indices)
    yield from zip(cells[keep].tolist(), genes[keep].tolist(), data[keep].astype(float).tolist(), strict=True)


class AnnotatedReader(DataSourceReader):
    """X as coordinates; one partition per range of rows, or of columns of a column-major matrix."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.step = options["path"], int(options.get("rows", 4096))

    def partitions(self) -> list[InputPartition]:
        import h5py

        with h5py.File(self.path, "r") as f:
            x = f["X"]
            n = len(x["indptr"]) - 1 if "indptr" in x else x.shape[0]
            by_column = "indptr" in x and x.attrs.get("encoding-type") == "csc_matrix"
        return [Range(i, min(i + self.step, n), by_column) for i in range(0, n, self.step)]

    def read(self, partition: Range) -> Iterator[tuple]:
        import h5py

        with h5py.File(self.path, "r") as f:
            x = f["X"]
            if "indptr" not in x:
                block = x[partition.start : partition.stop]
                for i, j in zip(*block.nonzero(), strict=True):
                    yield partition.start + int(i), int(j), float(block[i, j])
                return
            edge = x["indptr"][partition.start : partition.stop + 1]
            yield from compressed(x["data"][edge[0] : edge[-1]], x["indices"][edge[0] : edge[-1]], edge - edge[0], partition.start, partition.by_column)


class AnnotatedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "annotated_hdf5"

    def schema(self) -> str:
        return "cell_id bigint, gene_id int, value double"

    def reader(self, schema) -> DataSourceReader:
        return AnnotatedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AnnotatedSource)
