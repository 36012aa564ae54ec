"""PLINK 1 tables: sample, variant and packed genotype files, and a Spark data source over ranges of variants."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.storage import cut

# Fixed values of the format: the header bytes and the dosage of each two-bit code.
MAGIC = bytes([0x6C, 0x1B, 0x01])
DOSAGE = np.array([2, -127, 1, 0], dtype=np.int8)


def indexed_csv(spark: SparkSession, path: str, schema: str, index: str, header: bool = False) -> DataFrame:
    """A tab-separated file with its row number, by file order. Rows are numbered within the byte range that they are read
    from; only a count for each range comes together."""
    names = [c.split()[0] for c in schema.split(", ")]
    rows = spark.read.csv(path, sep="\t", schema=schema, header=header)
    rows = rows.select(*names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"))
    inside = cut(rows.withColumn("_in", F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_id")) - 1))
    before = Window.orderBy("_f", "_s").rowsBetween(Window.unboundedPreceding, -1)  # a row for each byte range
    counts = inside.groupBy(F.col("_file").alias("_f"), F.col("_start").alias("_s")).agg(F.count("*").alias("_n"))
    starts = counts.select("_f", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return inside.join(F.broadcast(starts), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s"))).select(*names, (F.col("_first") + F.col("_in")).cast("long").alias(index))


def read_fam(spark: SparkSession, path: str) -> DataFrame:
    return indexed_csv(spark, path, "fid string, iid string, father string, mother string, gender int, trait double", "sample_idx")


def read_bim(spark: SparkSession, path: str, include_x: bool = False) -> DataFrame:
    """Variants on chromosomes 1 to 22 (and X), with a composite identifier; row numbers are those of the file."""
    keep = [*map(str, range(1, 23)), *(["X"] if include_x else [])]
    v = indexed_csv(spark, path, "chrom string, snp string, cm double, pos long, a0 string, a1 string", "variant_idx").where(F.col("chrom").isin(keep))
    return v.withColumn("rsID", F.concat(F.lit("chr"), F.concat_ws(":", "chrom", F.col("pos").cast("string"), "a0", "a1")))


def read_master(spark: SparkSession, path: str, columns: list[str], sex: str | None = None) -> DataFrame:
    """IIDs as whole numbers in text and the given columns; sex m or w keeps rows whose column sex is 1 or 0."""
    df = spark.read.csv(path, sep="\t", header=True)
    if sex is not None:
        df = df.where(F.col("sex").cast("double") == {"m": 1, "w": 0}[sex])
    return df.select(F.col("IID").cast("long").cast("string").alias("IID"), *columns)


def write_bed(path: str, dosage: np.ndarray) -> None:
    """(variants, samples) of 0, 1, 2 and -127; for fixtures."""
    code = np.select([dosage == 2, dosage == -127, dosage == 1], [0, 1, 2], 3).astype(np.uint8)
    code = np.pad(code, ((0, 0), (0, -code.shape[1] % 4)))
    packed = code[:, 0::4] | code[:, 1::4] << 2 | code[:, 2::4] << 4 | code[:, 3::4] << 6
    with open(path, "wb") as f:
        f.write(MAGIC + packed.tobytes())


def write_fam(path: str, samples: int) -> None:
    with open(path, "w") as f:
        f.writelines(f"{1000 + i}\t{1000 + i}\t0\t0\t{1 + i % 2}\t-9\n" for i in range(samples))


def write_bim(path: str, chromosomes: list[str]) -> None:
    with open(path, "w") as f:
        f.writelines(f"{c}\trs{i}\t0.0\t{1000 * (i + 1)}\tA\tG\n" for i, c in enumerate(chromosomes))


def write_master(path: str, columns: dict) -> None:
    """IIDs as in write_fam, and the given columns."""
    with open(path, "w") as f:
        f.write("\t".join(["IID", *columns]) + "\n")
        f.writelines("\t".join([str(1000 + i), *map(str, x)]) + "\n" for i, x in enumerate(zip(*columns.values())))


def unpack(raw: bytes, samples: int) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8).reshape(-1, -(-samples // 4))
    return DOSAGE[(b[:, :, None] >> np.array([0, 2, 4, 6]) & 3)].reshape(len(b), -1)[:, :samples]


class Range(InputPartition):
    """Variants first to last - 1; `asked` are the ones wanted of them, None all."""

    def __init__(self, first: int, last: int, asked: tuple[int, ...] | None = None):
        super().__init__((first, last))
        self.first, self.last, self.asked = first, last, asked


class PlinkReader(DataSourceReader):
    """Filters on variant_idx (comparisons with numbers, lists of them) choose byte ranges, so the others aren't read."""

    def __init__(self, options, chosen: np.ndarray | None = None, long: bool = False):
        self.path, self.samples = options["path"], int(options["n_samples"])
        self.step = int(options.get("variants_per_partition", 10_000))
        self.chosen, self.long = chosen, long
        self.low, self.high, self.asked = 0, None, None

    def pushFilters(self, filters):
        for f in filters:
            known = getattr(f, "attribute", None) == ("variant_idx",)
            kind = type(f).__name__
            if known and kind == "EqualTo":
                self._ask([f.value])
            elif known and kind == "In":
                self._ask(f.value)
            elif known and kind in ("GreaterThan", "GreaterThanOrEqual"):
                self.low = max(self.low, f.value + (kind == "GreaterThan"))
            elif known and kind in ("LessThan", "LessThanOrEqual"):
                end = f.value + (kind == "LessThanOrEqual")
                self.high = end if self.high is None else min(self.high, end)
            elif not (known and kind == "IsNotNull"):
                yield f

    def _ask(self, values):
        values = {int(v) for v in values if v is not None}
        self.asked = values if self.asked is None else self.asked & values

    def _open(self):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(self.path if ":/" in self.path else f"file://{self.path}")
        return store, path

    def partitions(self):
        store, path = self._open()
        with store.open_input_file(path) as f:
            if f.read(3) != MAGIC:
                raise ValueError("not a variant-major PLINK 1 file")
            whole, rest = divmod(f.size() - 3, -(-self.samples // 4))
        if rest:
            raise ValueError("the file's size does not fit n_samples")
        high = whole if self.high is None else min(whole, self.high)
        if self.asked is None:
            return [Range(i, min(high, i + self.step)) for i in range(self.low, high, self.step)] or [Range(0, 0)]
        wanted = sorted(v for v in self.asked if self.low <= v < high)
        return [Range(part[0], part[-1] + 1, tuple(part)) for part in (wanted[i : i + self.step] for i in range(0, len(wanted), self.step))] or [Range(0, 0)]

    def _runs(self, part):
        """Stretches of wanted variants that follow one another, at most 256 each."""
        wanted = np.arange(part.first, part.last) if part.asked is None else np.array(part.asked)
        for run in np.split(wanted, np.flatnonzero(np.diff(wanted) != 1) + 1):
            for k in range(0, len(run), 256):
                yield int(run[k]), len(run[k : k + 256])

    def read(self, part):
        import pyarrow as pa

        store, path = self._open()
        width = -(-self.samples // 4)
        if part.first == part.last:
            return
        with store.open_input_file(path) as f:
            for first, n in self._runs(part):
                f.seek(3 + first * width)
                calls = unpack(f.read(n * width), self.samples)
                variants = np.arange(first, first + n, dtype=np.int32)
                if not self.long:
                    flat = pa.array(calls.ravel(), pa.int8(), mask=(calls == -127).ravel())
                    ends = pa.array(np.arange(n + 1, dtype=np.int32) * calls.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(variants), pa.ListArray.from_arrays(ends, flat)], ["variant_idx", "dosage"])
                    continue
                samples = np.arange(self.samples) if self.chosen is None else self.chosen
                for k in range(0, n, max(1, 1_000_000 // max(1, len(samples)))):
                    own = calls[k : k + max(1, 1_000_000 // max(1, len(samples)))][:, samples]
                    dosage = pa.array(own.ravel(), pa.int8(), mask=(own == -127).ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.tile(samples, len(own)), pa.int64()), pa.array(np.repeat(variants[k : k + len(own)], len(samples))), dosage], ["sample_idx", "variant_idx", "dosage"])


class PlinkSource(DataSource):
    """spark.read.format("plink").option("n_samples", n).load(path): (variant_idx, dosage array), one row per variant."""

    @classmethod
    def name(cls):
        return "plink"

    def schema(self):
        return "variant_idx int, dosage array<tinyint>"

    def reader(self, schema):
        return PlinkReader(self.options)


def read_bed(spark: SparkSession, path: str, n_samples: int, variants_per_partition: int = 10_000, samples: list[int] | None = None, variants: list[int] | None = None) -> DataFrame:
    """(sample_idx, variant_idx, dosage): all samples, or the given ones in their order, repeats included; all variants, or the
    given ones. Filters on variant_idx that follow are pushed into the reader, as the list of variants is. The samples'
    places go to the tasks once, with the source."""
    chosen = None if samples is None else np.array(samples, np.int64)

    class Calls(DataSource):
        @classmethod
        def name(cls):
            return "plink_calls"

        def schema(self):
            return "sample_idx long, variant_idx int, dosage tinyint"

        def reader(self, schema):
            return PlinkReader(self.options, chosen, long=True)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PlinkSource)
    spark.dataSource.register(Calls)
    calls = spark.read.format("plink_calls").option("n_samples", n_samples).option("variants_per_partition", variants_per_partition).load(path)
    return calls if variants is None else calls.where(F.col("variant_idx").isin(list(map(int, variants))))
