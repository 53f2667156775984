"""Raw little-endian vectors: readers by Spark, a writer of one ordered file per partition."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: numpy types by name, and the Spark type they widen to.
KINDS = {"int32": ("<i4", "long"), "int64": ("<i8", "long"), "float32": ("<f4", "float"), "float64": ("<f8", "double")}


#: Bytes of a file that one task reads, and rows that travel together.
TASK_BYTES, ROWS = 64 << 20, 1 << 16


def _filesystem(path: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class RawVectors(DataSource):
    """Rows of raw files as (pos, v): each task reads a byte range, and positions follow from its offset.

    Options: path (a file that executors reach too), kind, width, begin and
    end (row numbers). Bytes outside begin and end aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_vectors"

    def schema(self) -> str:
        sql = KINDS[self.options["kind"]][1]
        return f"pos long, v {f'array<{sql}>' if int(self.options['width']) > 1 else sql}"

    def reader(self, schema) -> DataSourceReader:
        return RawReader(dict(self.options))


class RawReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.width = options["path"], int(options["width"])
        self.code, self.sql = KINDS[options["kind"]]
        self.size = np.dtype(self.code).itemsize * self.width
        self.begin, self.end = max(0, int(options.get("begin", 0))), options.get("end")

    def partitions(self) -> list[InputPartition]:
        files, path = _filesystem(self.path)
        length = files.get_file_info(path).size
        if length is None or length % self.size:
            raise ValueError(f"{self.path} isn't a file of whole rows of {self.size} bytes")
        end = length // self.size if self.end is None else min(int(self.end), length // self.size)
        step = max(1, TASK_BYTES // self.size)
        return [InputPartition((lo, min(end, lo + step))) for lo in range(self.begin, end, step)]

    def read(self, partition: InputPartition):
        files, path = _filesystem(self.path)
        lo, hi = partition.value
        with files.open_input_file(path) as file:
            for at in range(lo, hi, ROWS):
                n = min(ROWS, hi - at)
                flat = np.frombuffer(file.read_at(n * self.size, at * self.size), self.code)
                values = pa.array(flat.astype(np.int64) if self.sql == "long" else flat)
                if self.width > 1:
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, self.width), pa.int32()), values)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), values], names=["pos", "v"])


def read_vectors(spark: SparkSession, path: str, kind: str, width: int = 1, begin: int = 0, end: int | None = None) -> DataFrame:
    """(pos, v): rows begin to end of a row-major file; v is an array if width is over 1."""
    spark.dataSource.register(RawVectors)
    options = {"kind": kind, "width": str(width), "begin": str(begin)} | ({} if end is None else {"end": str(end)})
    return spark.read.format("raw_vectors").options(**options).load(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst) of a file of interleaved int32 pairs."""
    return read_vectors(spark, path, "int32", 2).select(F.col("v")[0].alias("src"), F.col("v")[1].alias("dst"))


def read_split_edges(spark: SparkSession, src: str, dst: str, kind: str = "int64") -> DataFrame:
    """(src, dst) of two parallel files."""
    one, two = read_vectors(spark, src, kind), read_vectors(spark, dst, kind)
    return one.withColumnRenamed("v", "src").join(two.withColumnRenamed("v", "dst"), "pos").select("src", "dst")


def read_features(spark: SparkSession, path: str, width: int, begin: int = 0, end: int | None = None) -> DataFrame:
    """(node, feat) of rows begin to end of a float32 matrix; no other bytes are read."""
    return read_vectors(spark, path, "float32", width, begin, end).select(F.col("pos").alias("node"), F.col("v").alias("feat"))


def feature_range(features: DataFrame, begin: int, end: int | None = None) -> DataFrame:
    """Rows of the half-open id range; on Parquet the filter reaches the row groups."""
    rows = features.where(F.col("node") >= begin)
    return rows if end is None else rows.where(F.col("node") < end)


def slice_bounds(slices: int, n: int) -> list[tuple[int, int]]:
    """Half-open id ranges of n div slices + 1 ids, clamped to n, so that no range is inverted."""
    step = n // slices + 1
    return [(min(i * step, n), min((i + 1) * step, n)) for i in range(slices)]


def write_vectors(df: DataFrame, path: str, kind: str, order: str, column: str, mode: str = "overwrite") -> None:
    """Write one column, sorted by ``order``, as raw vectors; arrays are written row-major.

    Each partition becomes a row (first, data) of a Parquet table at path;
    ``vector_bytes`` joins them. Sorting is by range, so no task holds all.
    """
    code = KINDS[kind][0]

    def pack(batches):
        for batch in batches:
            values = batch.column(1)
            flat = values.flatten() if pa.types.is_list(values.type) else values
            data = flat.to_numpy(zero_copy_only=False).astype(code).tobytes()
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(0, 1), pa.array([data], pa.binary())], names=["first", "data"])

    packed = df.select(F.col(order).cast("long").alias("o"), column).repartitionByRange("o").sortWithinPartitions("o").mapInArrow(pack, "first long, data binary")
    packed.write.mode(mode).parquet(path)


def vector_bytes(spark: SparkSession, path: str):
    """The chunks of a table that write_vectors wrote, in order, one at a time."""
    return (bytes(r[0]) for r in spark.read.parquet(path).orderBy("first").select("data").toLocalIterator())


def export_file(spark: SparkSession, path: str, file: str, append: bool = False) -> None:
    """Copy the chunks to one local file of the driver, appending or overwriting."""
    with open(file, "ab" if append else "wb") as out:
        for chunk in vector_bytes(spark, path):
            out.write(chunk)


def convert_dataset(edges: DataFrame, features: DataFrame, labels: DataFrame, splits: DataFrame, path: str) -> None:
    """Write a dataset as column files below path: edge ends by (src, dst), features and labels by node, ids by split.

    edges is (src, dst), features (node, feat), labels (node, label) and
    splits (node, split) with train, valid and test.
    """
    from hopforge.functions.ordering import global_rank
    from hopforge.plans.lineage import cut

    ranked = cut(global_rank(edges.select("src", "dst"), "src", "dst"))
    write_vectors(ranked, f"{path}/srcList", "int64", "rank", "src")
    write_vectors(ranked, f"{path}/dstList", "int64", "rank", "dst")
    write_vectors(features, f"{path}/feat", "float32", "node", "feat")
    write_vectors(labels, f"{path}/labels", "int64", "node", "label")
    for split, name in (("train", "trainIds"), ("valid", "valIDs"), ("test", "testIDs")):
        write_vectors(splits.where(F.col("split") == split), f"{path}/{name}", "int64", "node", "node")


def slice_ids(ids: DataFrame, bounds: list[tuple[int, int]]) -> DataFrame:
    """(slice, node): the half-open id range that each node falls in; nodes in none are left out."""
    found = F.lit(None).cast("long")
    for i, (begin, end) in enumerate(bounds):
        found = F.when((F.col("node") >= begin) & (F.col("node") < end), i).otherwise(found)
    return ids.select(found.cast("long").alias("slice"), "node").where("slice is not null")


def read_dataset(spark: SparkSession, folder: str, width: int) -> dict[str, DataFrame]:
    """edges, features, labels and train of a folder with graph.bin, feat.bin, labels.bin and trainIds.bin."""
    return {
        "edges": read_edges(spark, f"{folder}/graph.bin"),
        "features": read_features(spark, f"{folder}/feat.bin", width),
        "labels": read_vectors(spark, f"{folder}/labels.bin", "int64").select(F.col("pos").alias("node"), F.col("v").alias("label")),
        "train": read_vectors(spark, f"{folder}/trainIds.bin", "int64").select(F.col("v").alias("node")),
    }


def params_table(spark: SparkSession, layers: dict[str, np.ndarray]) -> DataFrame:
    """(layer, i, j, w) of named weight matrices, to be written like any table."""
    rows = [(name, i, j, float(w)) for name, m in layers.items() for (i, j), w in np.ndenumerate(np.atleast_2d(m))]
    return spark.createDataFrame(rows, "layer string, i long, j long, w double")


def params_from(table: DataFrame) -> dict[str, np.ndarray]:
    """The matrices of a (layer, i, j, w) table."""
    out: dict[str, np.ndarray] = {}
    for name, rows in table.toPandas().groupby("layer"):
        m = np.zeros((int(rows["i"].max()) + 1, int(rows["j"].max()) + 1))
        m[rows["i"], rows["j"]] = rows["w"]
        out[str(name)] = m
    return out


def mask_to_ids(nodes: DataFrame, mask: str) -> DataFrame:
    """(node) where a boolean column holds."""
    return nodes.where(F.col(mask)).select("node")


def zero_features(spark: SparkSession, n: int, width: int) -> DataFrame:
    """(node, feat) of zeros."""
    return spark.range(n).select(F.col("id").alias("node"), F.array_repeat(F.lit(0.0).cast("float"), width).alias("feat"))


def synthetic_dataset(spark: SparkSession, n: int, width: int, share: float = 0.01, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(features, labels, train): zero features, label 1, and a random int(n * share) of the ids."""
    from hopforge.functions.ordering import global_rank, shuffled

    ids = spark.range(n).withColumnRenamed("id", "node")
    ranked = global_rank(ids.withColumn("digest", shuffled(F.lit(seed), "node")), "digest", "node")
    labels = ids.select("node", F.lit(1).cast("long").alias("label"))
    return zero_features(spark, n, width), labels, ranked.where(F.col("rank") <= int(n * share)).select("node")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """(dataset, ...): a JSON object of datasets by code, one row each."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("dataset", "entry"))
    fields_ = "edges long, nodes long, rawFilePath string, processedPath string, featLen long, classes long, trainNUM long, valNUM long, testNUM long"
    return entries.select("dataset", F.from_json("entry", fields_).alias("e")).select("dataset", "e.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(part, n_nodes, n_edges, seq) of a JSON manifest: an object a part, and the order of parts in ``path``."""
    text = spark.read.text(path, wholetext=True)
    sizes = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("name", "entry")).where("name like 'part%'")
    sizes = sizes.select(F.expr("cast(substring(name, 5) as long)").alias("part"), F.from_json("entry", "nodeNUM long, edgeNUM long").alias("e"))
    order = text.select(F.posexplode(F.from_json(F.get_json_object("value", "$.path"), "array<long>")).alias("seq", "part"))
    return sizes.join(order, "part", "left").select("part", F.col("e.nodeNUM").alias("n_nodes"), F.col("e.edgeNUM").alias("n_edges"), F.col("seq").cast("long").alias("seq"))


def manifest_json(manifest: DataFrame) -> str:
    """The JSON of a manifest of parts, of which there are few."""
    rows = manifest.select("part", "n_nodes", "n_edges", "seq").orderBy("part").collect()
    out: dict = {f"part{r.part}": {"nodeNUM": r.n_nodes, "edgeNUM": r.n_edges} for r in rows}
    return json.dumps(out | {"path": [r.part for r in sorted(rows, key=lambda r: (r.seq is None, r.seq))]})


def write_meta(df: DataFrame, path: str) -> None:
    """(key, value) rows as tab-separated text."""
    df.select("key", "value").write.mode("overwrite").csv(path, sep="\t")


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema="key string, value string")


@dataclass(frozen=True)
class TrainConfig:
    """Settings of a training job; unknown keys of a file are ignored."""

    dataset: str = "PD"
    model: str = "SAGE"
    datasetpath: str = ""
    partNUM: int = 4
    batchsize: int = 1024
    maxEpoch: int = 20
    epochInterval: int = 5
    featlen: int = 100
    fanout: tuple[int, ...] = (10, 10, 10)
    classes: int = 47
    mode: str = "NC"
    memUse: float = 1.6e9

    @classmethod
    def from_text(cls, text: str) -> TrainConfig:
        raw = json.loads(text)
        known = {f.name for f in fields(cls)}
        out = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in raw.items() if k in known})
        if out.model == "GAT" and len(out.fanout) != 2:
            raise ValueError("GAT has two layers; fanout must name two hops")
        return out
