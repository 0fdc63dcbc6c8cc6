"""Writing partitions: staged, checked, moved into a folder of their own, then named in a manifest.

Each commit has a new folder below its partition's, and what the manifest named
before goes only after the manifest names the new one; whenever a writer stops,
the manifest names whole files.
"""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from wakeline.plans.catalog import COMMITTED, Manifest, statistics, statistics_by
from wakeline.plans.fs import Files
from wakeline.schemas import DATASETS

#: Rows of a file; its codec's level; bytes of a row group (about 500,000 positions).
FILE_ROWS, OPTIONS = 2_000_000, {"compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.block.size": str(64 << 20)}
DERIVED = ("tracks", "events", "density")


def layer(dataset: str) -> str:
    return "derived" if dataset in DERIVED else "canonical"


def _in_order(df: DataFrame, dataset: str, *first: str) -> DataFrame:
    """Ranges of the first keys: files are sorted among and within themselves, whatever the size."""
    spec = DATASETS.get(dataset)
    order = [*first, *[c for c in (spec.sort if spec else ()) if c in df.columns]]
    return df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df


class PartitionWriter:
    """One partition of one dataset; its manifest, written last, makes it visible."""

    def __init__(self, spark: SparkSession, root: str, dataset: str, source: str, date: str):
        self.files, self.dataset, self.source, self.date = Files(spark, root), dataset, source, date
        self.place = f"{layer(dataset)}/{dataset}/source={source}/date={date}"
        self.staging, self.target = self.files.at("_staging", self.place), self.files.at(self.place)
        self.manifest_path = self.files.at("manifests", dataset, f"source={source}", f"date={date}.json")
        self.state = "new"

    def write(self, df: DataFrame) -> PartitionWriter:
        """Stage the rows in the dataset's order; fails if the partition is being staged already."""
        if self.files.exists(self.staging):
            raise FileExistsError(f"{self.staging} is there already")
        _in_order(df, self.dataset).write.options(**OPTIONS).option("maxRecordsPerFile", FILE_ROWS).parquet(self.staging)
        self.state = "staged"
        return self

    def take(self, folder: str) -> PartitionWriter:
        """Stage a folder of files that were written in order already."""
        if self.files.exists(self.staging):
            raise FileExistsError(f"{self.staging} is there already")
        self.files.move(folder, self.staging)
        self.state = "staged"
        return self

    def validate(self) -> list[str]:
        names = [(n, size) for n, size, folder in self.files.names(self.staging) if not folder and n.endswith(".parquet")]
        if self.state != "staged" or not names or any(size == 0 for _, size in names):
            raise ValueError(f"{self.place}: nothing whole was staged")
        return [n for n, _ in names]

    def commit(self, stats: dict | None = None, **about) -> Manifest:
        """Replace the partition by what is staged, then write its manifest; ``stats`` are its statistics, if known."""
        if self.state == "committed":
            raise RuntimeError("committed already")
        names = self.validate()
        stats = statistics(self.files._spark.read.parquet(self.staging)) if stats is None else stats
        version = f"v-{uuid.uuid4().hex}"
        self.files.move(self.staging, f"{self.target}/{version}")
        spec = DATASETS.get(self.dataset)
        fill = {"schema_version": spec.version if spec else self.dataset, "adapter_version": f"{self.source}/0.1.0", "transform_version": "normalize/0.1.0"}
        made = Manifest(dataset=self.dataset, source=self.source, date=self.date, files=[f"{self.place}/{version}/{n}" for n in names], write_timestamp=datetime.now(UTC).isoformat(), write_status=COMMITTED, **(fill | stats | about))
        self.files.write(self.manifest_path, made.to_json())
        self.state = "committed"
        for name, _, _ in self.files.names(self.target):
            if name != version:
                self.files.delete(f"{self.target}/{name}")
        return made

    def abort(self) -> None:
        self.files.delete(self.staging)
        self.state = "aborted"


def write_partition(df: DataFrame, root: str, dataset: str, source: str, date: str, **about) -> Manifest:
    writer = PartitionWriter(df.sparkSession, root, dataset, source, date)
    try:
        return writer.write(df).commit(**about)
    except Exception:
        if writer.state != "new":
            writer.abort()
        raise


def write_partitions(df: DataFrame, root: str, dataset: str, source: str, day: str, **about) -> list[Manifest]:
    """A partition for each value of ``day``, a column of ISO dates that isn't stored: all are staged and counted at once, then committed one by one."""
    spark, files = df.sparkSession, Files(df.sparkSession, root)
    staged = files.at("_staging", f"days-{uuid.uuid4().hex}", layer(dataset), dataset, f"source={source}")
    made = []
    try:
        _in_order(df, dataset, day).write.options(**OPTIONS).option("maxRecordsPerFile", FILE_ROWS).partitionBy(day).parquet(staged)
        found = {n.split("=", 1)[1]: f"{staged}/{n}" for n, _, folder in files.names(staged) if folder and n.startswith(f"{day}=")}
        stats = statistics_by(spark.read.parquet(staged), day) if found else {}
        for iso in sorted(found):
            writer = PartitionWriter(spark, root, dataset, source, iso).take(found[iso])
            try:
                made.append(writer.commit(stats[iso], **about))
            except Exception:
                writer.abort()
                raise
    finally:
        files.delete(staged.split(f"/{layer(dataset)}/{dataset}/source=")[0])
    return made


def cleanup_stale_staging(spark: SparkSession, root: str) -> list[str]:
    """Delete what writers left behind; the partitions it was meant for."""
    files = Files(spark, root)
    staged = {p.rsplit("/", 1)[0].split("/_staging/", 1)[1] for p in files.walk(files.at("_staging"), "")}
    # days that were staged together lie in a folder of their own
    found = sorted({re.sub(r"/[^/=]*=(?=[^/]*$)", "/date=", re.sub(r"^days-[0-9a-f]+/", "", p)) for p in staged if p.count("=") > 1})
    files.delete(files.at("_staging"))
    return found
