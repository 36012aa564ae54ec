"""PLINK files: which bytes a filter reads, and row numbers over many splits."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from strandmill.operators import qc
from strandmill.sources import plink

N, M = 37, 500


@pytest.fixture(scope="module")
def bed(tmp_path_factory):
    dosage = np.random.default_rng(1).choice([0, 1, 2, -127], (M, N)).astype(np.int8)
    path = f"{tmp_path_factory.mktemp('bed')}/x.bed"
    plink.write_bed(path, dosage)
    return path, dosage


def rows_of(df):
    return sorted((r.variant_idx, r.sample_idx, r.dosage) for r in df.collect())


def expected(dosage, variants, samples):
    return sorted((v, s, None if dosage[v, s] == -127 else int(dosage[v, s])) for v in variants for s in samples)


def expect_equal(a, b):
    key = lambda x: (x[0], x[1], x[2] is None, x[2] or 0)
    assert sorted(a, key=key) == sorted(b, key=key)


def test_filters_reach_the_reader(spark, bed):
    path, dosage = bed
    calls = plink.read_bed(spark, path, N, 64)
    few = calls.where("variant_idx >= 100 and variant_idx < 110 and dosage is not null")
    key = lambda x: x
    assert sorted(((r.variant_idx, r.sample_idx, r.dosage) for r in few.collect()), key=key) == [x for x in sorted(((v, s, int(dosage[v, s])) for v in range(100, 110) for s in range(N)), key=key) if x[2] != -127]
    assert "PushedFilters" in few._jdf.queryExecution().toString() or "plink_calls" in few._jdf.queryExecution().toString()
    listed = [3, 4, 5, 400, 77]
    expect_equal([(r.variant_idx, r.sample_idx, r.dosage) for r in plink.read_bed(spark, path, N, 2, variants=listed, samples=[5, 0, 5]).collect()], [x for v in listed for s in (5, 0, 5) for x in [(v, s, None if dosage[v, s] == -127 else int(dosage[v, s]))]])
    assert plink.read_bed(spark, path, N).where("variant_idx > 1000").count() == 0


@pytest.mark.parametrize("filters,wanted", [
    ([], list(range(M))), ([EqualTo(("variant_idx",), 7)], [7]), ([In(("variant_idx",), (9, 3, 3, 499, 10))], [3, 9, 10, 499]),
    ([GreaterThanOrEqual(("variant_idx",), 490)], list(range(490, 500))), ([GreaterThanOrEqual(("variant_idx",), 5), LessThan(("variant_idx",), 9)], [5, 6, 7, 8]),
    ([In(("variant_idx",), (1, 2, 900)), LessThan(("variant_idx",), 2)], [1]), ([EqualTo(("variant_idx",), 7), EqualTo(("variant_idx",), 8)], []),
])
def test_only_wanted_bytes_are_read(bed, monkeypatch, filters, wanted):
    path, dosage = bed
    reader = plink.PlinkReader({"path": path, "n_samples": str(N), "variants_per_partition": "50"})
    other = EqualTo(("dosage",), 1)
    assert list(reader.pushFilters([*filters, other])) == [other]
    parts, read = reader.partitions(), []
    opened = reader._open

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    def counting():
        store, where = opened()
        return type("Store", (), {"open_input_file": lambda _, p: Counted(store.open_input_file(p))})(), where

    monkeypatch.setattr(reader, "_open", counting)
    got = [v for part in parts for batch in reader.read(part) for v in batch.column(0).to_pylist()]
    assert got == wanted and sum(read) == len(wanted) * -(-N // 4)


def test_row_numbers_over_many_splits(spark, tmp_path):
    n = 30_000
    with open(f"{tmp_path}/x.fam", "w") as f:
        f.writelines(f"{i * 7}\tid{i}\t0\t0\t{1 + i % 2}\t-9\n" for i in range(n))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        fam = plink.read_fam(spark, f"file://{tmp_path}/x.fam")
        assert spark.read.text(f"file://{tmp_path}/x.fam").rdd.getNumPartitions() > 20
        got = fam.select("sample_idx", "iid", "gender").toPandas()
    finally:
        for name, value in zip(("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"), before):
            spark.conf.set(name, value)
    assert len(got) == n and (got["iid"] == "id" + got["sample_idx"].astype(str)).all() and got["sample_idx"].nunique() == n


def test_sex(spark, tmp_path):
    plink.write_master(f"{tmp_path}/m.phe", {"sex": [0, 1, 1, 0], "population": ["a", "a", "b", "a"], "y": [1, 2, 3, 4]})
    path = f"file://{tmp_path}/m.phe"
    assert [r.IID for r in plink.read_master(spark, path, ["y"], "w").collect()] == ["1000", "1003"]
    assert [r.IID for r in plink.read_master(spark, path, ["y"], "m").collect()] == ["1001", "1002"]
    fam = spark.createDataFrame([(i, str(1000 + i)) for i in range(4)], "sample_idx long, iid string")
    master = plink.read_master(spark, path, ["sex", "population", "y"]).withColumn("_row", F.monotonically_increasing_id())
    assert sorted(r.sample_idx for r in qc.prepare_samples(fam, master, "y", ["a"], "w").collect()) == [0, 3]
    assert [r.sample_idx for r in qc.prepare_samples(fam, master, "y", ["a"], "m").collect()] == [1]
