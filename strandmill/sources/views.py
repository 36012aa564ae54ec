"""Genotype, phenotype and estimator tables derived from the driver's tables, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def md5_order(seed, *columns) -> Column:
    """The key of every seeded draw: MD5 over ids and seed."""
    return F.md5(F.concat_ws("_", *[F.col(c).cast("string") for c in columns], F.lit(str(seed))))


def geno(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_idx, variant_idx, dosage): calls in {0, 1, 2}, null where missing."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_idx"), F.posexplode("embedding").alias("variant_idx", "e"))
    v, e = F.col("variant_idx"), F.col("e").cast("double")
    missing = F.substring(F.md5(F.concat_ws("_", F.col("sample_idx").cast("string"), v.cast("string"))), 1, 2) < F.when(v % 16 == 15, "20").otherwise("05")
    dosage = F.when(missing, None).when(e < 0.04 * (v % 10) - 0.13, 0).when(e < 0.04 * (v % 10) + 0.05, 1).otherwise(2)
    return long.select("sample_idx", "variant_idx", dosage.cast("int").alias("dosage"))


def pheno(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("vec_id"), F.conv(F.substring(F.md5(F.col("vec_id").cast("string")), 1, 4), 16, 10).cast("int") % 100
    return table(spark, sf_dir, "embeddings").select(
        i.alias("sample_idx"), (i + 1000001).cast("string").alias("iid"), F.concat(F.lit("pop"), (F.col("label") % 3).cast("string")).alias("population"),
        (F.col("label") >= 5).cast("int").alias("y_bin"), (F.col("label") + F.col("embedding")[0].cast("double")).alias("y_cont"), (30 + i % 50).cast("double").alias("age"),
        (i % 2).cast("int").alias("sex"), F.col("embedding")[60].cast("double").alias("pc1"), F.when(d < 70, "train").when(d < 85, "val").otherwise("test").alias("split"),
    )


def variants_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variants that geno has calls of, as many as the longest embedding has dimensions."""
    ids = table(spark, sf_dir, "embeddings").select(F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("id")).where("id >= 0").distinct()
    return ids.select(F.col("id").cast("int").alias("variant_idx"), (F.col("id").cast("int") / 3 + 1).cast("int").cast("string").alias("chr"), ((F.col("id") % 3 + 1) * 1_000_000).cast("long").alias("pos"))


def variants_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_partkey is not null")
    prefix = F.when(F.col("p_partkey") % 3 == 0, "chr").when(F.col("p_partkey") % 3 == 1, "CHR").otherwise("")
    mean = p.agg(F.avg("p_retailprice").alias("_m"))
    return p.crossJoin(F.broadcast(mean)).select(  # one row
        F.col("p_partkey").alias("variant_idx"), F.concat(prefix, (F.col("p_size") % 26).cast("string")).alias("chr"), (F.col("p_partkey") * 1000 + F.col("p_size")).cast("long").alias("pos"),
        F.concat(F.lit("rs"), F.col("p_partkey").cast("string")).alias("snp"), (F.col("p_retailprice") - F.col("_m")).alias("shap"),
    )


def estimator_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(estimator_idx, sample_idx, pred): estimator k is the mean of dimensions 8k to 8k + 7."""
    long = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_idx"), F.posexplode("embedding").alias("d", "e"))
    return long.groupBy((F.col("d") / 8).cast("int").alias("estimator_idx"), "sample_idx").agg(F.round(F.avg(F.col("e").cast("double")), 9).alias("pred"))


def calls_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, variant, dosage) at bench scale; repeated pairs keep the largest dosage."""
    li, o = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_custkey").alias("sample"), F.col("l_partkey").alias("variant")).agg(F.max((F.col("l_quantity") % 3).cast("int")).alias("dosage"))


#: The same views for the oracle, as common table expressions.
SQL = {
    "geno": """geno as (select sample_idx, variant_idx, case when substr(md5(concat(sample_idx, '_', variant_idx)), 1, 2) < (case when variant_idx % 16 = 15 then '20' else '05' end) then null
      when e < 4e-2 * (variant_idx % 10) - 13e-2 then 0 when e < 4e-2 * (variant_idx % 10) + 5e-2 then 1 else 2 end as dosage
      from (select vec_id as sample_idx, unnest(range(0, 64))::int as variant_idx, unnest(embedding)::double as e from embeddings))""",
    "pheno": """pheno as (select vec_id as sample_idx, (vec_id + 1000001)::varchar as iid, concat('pop', label % 3) as population, (label >= 5)::int as y_bin,
      label + embedding[1]::double as y_cont, (30 + vec_id % 50)::double as age, (vec_id % 2)::int as sex, embedding[61]::double as pc1,
      case when h < 70 then 'train' when h < 85 then 'val' else 'test' end as split
      from (select *, cast(concat('0x', substr(md5(vec_id::varchar), 1, 4)) as bigint) % 100 as h from embeddings))""",
    "variants_small": "variants_small as (select v::int as variant_idx, (v // 3 + 1)::varchar as chr, ((v % 3 + 1) * 1000000)::bigint as pos from range(0, 64) t(v))",
    "variants_large": """variants_large as (select p_partkey as variant_idx, concat(case p_partkey % 3 when 0 then 'chr' when 1 then 'CHR' else '' end, p_size % 26) as chr,
      (p_partkey * 1000 + p_size)::bigint as pos, concat('rs', p_partkey) as snp, p_retailprice - avg(p_retailprice) over () as shap from part)""",
    "preds": """preds as (select estimator_idx, sample_idx, round(avg(e), 9) as pred from (select vec_id as sample_idx, (unnest(range(0, 64)) // 8)::int as estimator_idx, unnest(embedding)::double as e from embeddings) group by 1, 2)""",
    "calls": "calls as (select o_custkey as sample, l_partkey as variant, max((l_quantity % 3)::int) as dosage from lineitem join orders on l_orderkey = o_orderkey group by 1, 2)",
}
