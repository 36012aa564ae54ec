"""Registered queries of selection, reports and simulation, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import BASE, ECOEFS, LAID, SHAP, STATS, estimator_coefs, query, rounded, scored, shap_values, stats, train_calls
from .operators import estimators as E
from .operators import layout as L
from .operators import linkage as G
from .operators import reports as R
from .operators import selection as N
from .operators import simulate as M
from .operators import stats as S
from .sources import views as V


# ---- selection ------------------------------------------------------------------------------------------------------
@query("select sample_idx, split from (select *, row_number() over (order by sample_idx) - 1 as i from pheno) where i >= 10 and i < 200 and (i - 10) % 3 = 0", "pheno")
def slice_positions(s, d):
    return N.by_position(V.pheno(s, d).select("sample_idx", "split"), "sample_idx", 10, 200, 3)


@query("select sample_idx, split from pheno where sample_idx % 7 = 0", "pheno")
def slice_labels(s, d):
    p = V.pheno(s, d).select("sample_idx", "split")
    return N.by_label(p, p.where("sample_idx % 7 = 0"), "sample_idx")


@query("select case when sample_idx % 3 = 0 then 'train' when sample_idx % 3 = 1 then 'val' else 'test' end as part, count(*) as n, round(avg(y_cont), 6) as mean from pheno group by 1", "pheno")
def split_index_lists(s, d):
    p = V.pheno(s, d)
    parts = N.split_by_lists(p, {name: p.where(f"sample_idx % 3 = {k}") for k, name in enumerate(("train", "val", "test"))}, "sample_idx")
    out = [x.agg(F.lit(name).alias("part"), F.count("*").alias("n"), F.round(F.avg("y_cont"), 6).alias("mean")) for name, x in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("select sample_idx, round((y_cont - m) / sd, 6) as y, round(y_cont, 6) as back from pheno, (select avg(y_cont) as m, stddev_pop(y_cont) as sd from pheno where split = 'train')", "pheno")
def label_standardize(s, d):
    p = V.pheno(s, d).select("sample_idx", "split", F.col("y_cont").alias("y"))
    scale = N.label_scale(p, "y")
    y = N.standardised_label(p, "y", scale)
    return rounded(N.restored_label(y.withColumn("back", F.col("y")), "back", scale).select("sample_idx", "y", "back"), "y", "back")


@query("select estimator_idx, sample_idx from (select e as estimator_idx, sample_idx, row_number() over (partition by e order by md5(concat(sample_idx, '_', e + 22)), sample_idx) as i from pheno, (select unnest(range(0, 4))::int as e)) where i <= 50", "pheno")
def draw_fresh(s, d):
    return N.sample_draws(V.pheno(s, d), 4, 50, 22, False)


@query("select e as estimator_idx, sample_idx from (select sample_idx, row_number() over (order by md5(concat(sample_idx, '_', 22)), sample_idx) as i from pheno), (select unnest(range(0, 4))::int as e) where i <= 50", "pheno")
def draw_fixed(s, d):
    return N.sample_draws(V.pheno(s, d), 4, 50, 22, True)


@query("""with draws as (select k, sample_idx, rare from (select k, sample_idx, (sample_idx % 40 = 0)::int as rare, row_number() over (partition by k order by md5(concat(sample_idx, '_', k + 5)), sample_idx) as i from pheno, (select unnest(range(0, 10)) as k)) where i <= 20),
  good as (select min(k) as k from (select k from draws group by k having count(distinct rare) = 2)) select sample_idx, rare, k::int as attempt from draws where k = (select k from good)""", "pheno")
def draw_both_classes(s, d):
    p = V.pheno(s, d).select("sample_idx", (F.col("sample_idx") % 40 == 0).cast("int").alias("rare"))
    return N.draw_with_classes(p, "rare", 20, 5)


@query("""select sample_idx, case when t < 0.2::double then 'test' when v < 0.2::double / 0.8::double then 'val' else 'train' end as split from (select sample_idx,
  cast(concat('0x', substr(md5(concat(sample_idx, '_t9')), 1, 8)) as bigint)::double / 4294967296::double as t, cast(concat('0x', substr(md5(concat(sample_idx, '_v9')), 1, 8)) as bigint)::double / 4294967296::double as v from pheno)""", "pheno")
def split_simulation(s, d):
    return N.simulation_split(V.pheno(s, d).select("sample_idx"), 0.2, 9)


@query("""select sample_idx, y_bin from (select sample_idx, y_bin, row_number() over (partition by y_bin order by md5(concat(sample_idx, '_', 22)), sample_idx) as i, sum(y_bin) over () as c from pheno) where y_bin = 1 or i <= least(2 * c, greatest(0, 300 - c))""", "pheno")
def sample_balanced_sized(s, d):
    return N.balanced_draw(V.pheno(s, d).select("sample_idx", "y_bin"), "y_bin", 2, 22, 300)


@query(f"with {STATS}, mi as (select variant_idx, sum(pxy * ln(pxy / (px * py))) as mi from (select distinct variant_idx, dosage, bin, count(*) over (partition by variant_idx, dosage, bin)::double / n as pxy, count(*) over (partition by variant_idx, dosage)::double / n as px, count(*) over (partition by variant_idx, bin)::double / n as py from (select variant_idx, dosage, least(4, floor((y_cont - lo) / ((hi - lo) / 5)))::int as bin, count(*) over (partition by variant_idx) as n from train, (select min(y_cont) as lo, max(y_cont) as hi from train) where dosage is not null)) group by 1) select variant_idx, round(mi, 6) as mi from mi", BASE)
def fs_mutual_info_regression(s, d):
    """Plug-in mutual information of the dosage and the label in five bins of equal width."""
    x = train_calls(s, d)
    span = x.agg(F.min("y_cont").alias("_lo"), F.max("y_cont").alias("_hi"))  # one row
    x = x.where("dosage is not null").crossJoin(F.broadcast(span)).withColumn("y", F.least(F.lit(4), F.floor((F.col("y_cont") - F.col("_lo")) / ((F.col("_hi") - F.col("_lo")) / 5))).cast("int"))
    cells = x.groupBy("variant_idx", "dosage", "y").agg(F.count("*").cast("double").alias("_c"))
    w = lambda *by: F.sum("_c").over(Window.partitionBy("variant_idx", *by))
    cells = cells.withColumn("_n", w()).withColumn("_x", w("dosage")).withColumn("_y", w("y"))
    return cells.groupBy("variant_idx").agg(F.round(F.sum(F.col("_c") / F.col("_n") * F.log(F.col("_c") * F.col("_n") / (F.col("_x") * F.col("_y")))), 6).alias("mi"))


# ---- estimators, annotations, local values --------------------------------------------------------------------------
@query("select sample_idx, pred from preds where estimator_idx = 3", "preds")
def aggregate_identity(s, d):
    return R.only_estimator(V.estimator_preds(s, d).where("estimator_idx = 3"))


@query(f"with {ECOEFS} select variant_idx, min_by(coef, estimator_idx) filter (where estimator_idx % 2 = 1) as coef, min_by(estimator_idx, estimator_idx) as first_estimator from (select variant_idx, estimator_idx, round(coef, 6) as coef from ecoefs) group by 1", BASE)
def first_annotation(s, d):
    notes = estimator_coefs(s, d).select("variant_idx", "estimator_idx", F.when(F.col("estimator_idx") % 2 == 1, F.round("coef", 6)).alias("coef"), F.col("estimator_idx").alias("first_estimator"))
    return R.first_annotation(notes, ["coef", "first_estimator"])


@query(f"with {ECOEFS}, t as (select variant_idx, case when estimator_idx < 3 then 'linear' else 'nonlinear' end as model_type, coef from ecoefs) select variant_idx, model_type, round(sum(coef) / case model_type when 'linear' then 3 else 5 end, 6) as value, round(sum(abs(coef)) / case model_type when 'linear' then 3 else 5 end, 6) as value_abs from t group by 1, 2", BASE)
def values_by_type(s, d):
    kinds = s.range(8).select(F.col("id").cast("int").alias("estimator_idx"), F.when(F.col("id") < 3, "linear").otherwise("nonlinear").alias("model_type"))
    return rounded(R.values_by_type(estimator_coefs(s, d), kinds, "coef"), "value", "value_abs")


LOCAL = SHAP.replace(", std as", ", ecoefs as (select estimator_idx, variant_idx, coef from coefs, (select unnest(range(0, 8))::int as estimator_idx) where substr(md5(concat(variant_idx, '_', estimator_idx)), 1, 2) < '80'), std as") + ", many as (select s.sample_idx, s.variant_idx, e.estimator_idx, s.phi * (1 + e.estimator_idx) as phi from shap s join ecoefs e using (variant_idx) where s.sample_idx % 25 = 0 and e.estimator_idx < 3)"


def _many(s, d):
    e = estimator_coefs(s, d).where("estimator_idx < 3").select("estimator_idx", "variant_idx")
    return shap_values(s, d).where("sample_idx % 25 = 0").join(e, "variant_idx").select("sample_idx", "variant_idx", "estimator_idx", (F.col("phi") * (1 + F.col("estimator_idx"))).alias("phi"))


@query(f"with {LOCAL} select sample_idx, variant_idx, iid, round(sum(phi) / 3, 6) + 0 as phi from many join (select sample_idx, iid from pheno) using (sample_idx) group by 1, 2, 3", BASE)
def local_shap_aggregate(s, d):
    """Local values of chosen samples over estimators, with the samples' iid."""
    return rounded(R.with_iid(R.local_values(_many(s, d), 3), V.pheno(s, d)).select("sample_idx", "variant_idx", "iid", "phi"), "phi").withColumn("phi", F.col("phi") + 0.0)


@query(f"with {LOCAL}, one as (select sample_idx, variant_idx, sum(phi) / 3 as phi from many group by 1, 2) select sample_idx, round(coalesce(max(phi) filter (where variant_idx = 1), 0), 6) + 0 as v1, round(coalesce(max(phi) filter (where variant_idx = 2), 0), 6) + 0 as v2, round(coalesce(max(phi) filter (where variant_idx = 60), 0), 6) + 0 as v60 from one group by 1", BASE)
def local_shap_wide(s, d):
    got = rounded(R.wide_local(R.local_values(_many(s, d), 3), [1, 2, 60]), "v1", "v2", "v60")
    return got.select("sample_idx", *[(F.col(c) + 0.0).alias(c) for c in ("v1", "v2", "v60")])


@query("select round(avg(r2), 6) as score from (select estimator_idx, power(corr(pred, y_cont), 2) as r2 from preds join pheno using (sample_idx) group by 1)", "pheno preds")
def score_multi_output(s, d):
    r2 = S.r2(scored(s, d), "pred", "y_cont", ["estimator_idx"]).select(F.col("estimator_idx").alias("output"), F.col("r2").alias("score"))
    return R.multi_output(r2).select(F.round("score", 6).alias("score"))


@query("""select population, round(sum(age * power(y_cont - a, 2)) / sum(age), 6) as mse_linear, round(sum(age * power(y_cont - b, 2)) / sum(age), 6) as mse_tree, round(sum(age * power(y_cont - a, 2)) / sum(age) - sum(age * power(y_cont - b, 2)) / sum(age), 6) as delta
  from (select sample_idx, max(pred) filter (where estimator_idx = 0) as a, max(pred) filter (where estimator_idx = 1) as b from preds group by 1) join pheno using (sample_idx) group by 1""", "pheno preds")
def mse_delta_weighted(s, d):
    p = V.estimator_preds(s, d).groupBy("sample_idx").agg(F.max(F.when(F.col("estimator_idx") == 0, F.col("pred"))).alias("pred_linear"), F.max(F.when(F.col("estimator_idx") == 1, F.col("pred"))).alias("pred_tree"))
    return rounded(R.errors(p.join(V.pheno(s, d).withColumn("y", F.col("y_cont")), "sample_idx"), ["population"], "age"), "mse_linear", "mse_tree", "delta")


# ---- order, names, layouts ------------------------------------------------------------------------------------------
@query(f"with {LAID} select variant_idx, chr_order, pos from ord order by chr_order nulls last, pos, variant_idx", "variants_large")
def genomic_sort(s, d):
    return R.genomic_order(V.variants_large(s, d)).select("variant_idx", "chr_order", "pos")


@query("select sample_idx, split from pheno order by sample_idx", "pheno")
def index_sort(s, d):
    return R.in_order(V.pheno(s, d).select("sample_idx", "split"), "sample_idx")


@query("select variant_idx, round(shap, 4) as shap from variants_large order by round(variants_large.shap, 6) desc, variant_idx limit 20", "variants_large")
def delta_topk_signed(s, d):
    return R.top_signed(V.variants_large(s, d).withColumn("shap", F.round("shap", 6)), "shap", 20, "variant_idx").select("variant_idx", F.round("shap", 4).alias("shap"))


@query(f"with {STATS}, a as (select variant_idx, avg((dosage is null)::int::double) as m from geno group by 1) select variant_idx, round(stats.missingness, 6) as \"left\", round(m, 6) as \"right\" from stats join a using (variant_idx) where abs(stats.missingness - m) > 1e-3 order by 1 limit 5", BASE)
def mismatch_head(s, d):
    from .operators import qc as Q

    a, b = stats(s, d), Q.variant_stats(V.geno(s, d))
    return rounded(R.mismatches(a, b, "variant_idx", "missingness", 1e-3, 5), "left", "right")


RAW = "(select case p_partkey % 7 when 0 then 'chrX' when 1 then 'MT' when 2 then 'chr12_random' when 3 then 'chrUn' when 4 then ' 7 ' when 5 then 'CHR23' else 'mito' end as raw from part)"


def _raw(s, d):
    k = F.col("p_partkey") % 7
    return V.table(s, d, "part").select(F.when(k == 0, "chrX").when(k == 1, "MT").when(k == 2, "chr12_random").when(k == 3, "chrUn").when(k == 4, " 7 ").when(k == 5, "CHR23").otherwise("mito").alias("raw"))


@query(f"""with n as (select raw, upper(trim(regexp_replace(raw, '^(?i:chr|chrom)', ''))) as n from {RAW}) select raw, case when n in ('X', 'Y') then n when n in ('M', 'MT', 'MITO') then 'MT' when regexp_matches(n, '^[0-9]') then try_cast(regexp_extract(n, '^[0-9]+') as int)::varchar else n end as label,
  (case when n = 'X' then 23 when n = 'Y' then 24 when n in ('M', 'MT', 'MITO') then 25 else coalesce(try_cast(regexp_extract(n, '^[0-9]+') as int), 100) end)::int as chr_order, count(*) as n from n group by 1, 2, 3""")
def chr_normalize_delta(s, d):
    label, order = R.delta_chromosome(F.col("raw"))
    return _raw(s, d).groupBy("raw", label.alias("label"), order.alias("chr_order")).agg(F.count("*").alias("n"))


@query(f"select raw, case when n in ('M', 'MT', 'MITO') then 'MT' when n = '23' then 'X' when n = '24' then 'Y' else n end as norm, count(*) as n from (select raw, upper(regexp_replace(trim(raw), '(?i)^chr', '')) as n from {RAW}) group by 1, 2")
def chr_normalize_reduction(s, d):
    return _raw(s, d).groupBy("raw", R.reduction_chromosome(F.col("raw")).alias("norm")).agg(F.count("*").alias("n"))


@query(f"with {LAID}, flat as (select chr_order, coalesce(sum(m) over (order by chr_order rows between unbounded preceding and 1 preceding), 0)::bigint as o from mx) select variant_idx, (pos + o)::bigint as x from ord join flat using (chr_order)", "variants_large")
def manhattan_without_gap(s, d):
    return L.manhattan(V.variants_large(s, d), gap=False).select("variant_idx", "x")


@query(f"with {LAID}, names as (select chr_order, chr_norm, row_number() over (partition by chr_order order by count(*) desc, chr_norm) as i from laid group by 1, 2) select laid.chr_order, round(quantile_cont(x, 0.5), 3) as tick, max(names.chr_norm) as label from laid join names on laid.chr_order = names.chr_order and i = 1 group by 1", "variants_large")
def manhattan_centre_ticks(s, d):
    return rounded(R.centre_ticks(L.manhattan(V.variants_large(s, d))), "tick", n=3)


@query("""with e as (select event_id, event_id % 64 as i, user_id % 64 as j, value from events where value is not null) select event_id, a.chr as chr_i, b.chr as chr_j from e join variants_small a on a.variant_idx = e.i join variants_small b on b.variant_idx = e.j where a.chr = b.chr and a.chr::int <= 12""", "variants_small")
def edges_within_chromosome(s, d):
    v = V.variants_small(s, d)
    e = V.table(s, d, "events").where("value is not null").select("event_id", (F.col("event_id") % 64).cast("int").alias("i"), (F.col("user_id") % 64).cast("int").alias("j"))
    for x in "ij":
        e = e.join(F.broadcast(v.select(F.col("variant_idx").alias(x), F.concat(F.lit("chr"), F.col("chr")).alias(f"chr_{x}"))), x)
    got = R.within_chromosome(e, v.where("cast(chr as int) <= 12"))
    return got.select("event_id", F.expr("substring(chr_i, 4)").alias("chr_i"), F.expr("substring(chr_j, 4)").alias("chr_j"))


@query("select p_partkey, concat(regexp_replace(lower(concat_ws('_', p_brand, p_type, p_partkey::varchar)), '[^a-z0-9]+', '_', 'g'), '.parquet') as name from part")
def output_names(s, d):
    return V.table(s, d, "part").select("p_partkey", R.file_name(F.col("p_brand"), F.col("p_type"), F.col("p_partkey").cast("string")).alias("name"))


@query("select word, lower(trim(word)) not in ('false', '0', 'no') as truth, count(*) as n from (select case p_partkey % 5 when 0 then 'False' when 1 then ' no ' when 2 then '0' when 3 then 'yes' else null end as word from part) group by 1, 2")
def boolean_words(s, d):
    k = F.col("p_partkey") % 5
    w = V.table(s, d, "part").select(F.when(k == 0, "False").when(k == 1, " no ").when(k == 2, "0").when(k == 3, "yes").alias("word"))
    return w.groupBy("word", R.truth(F.col("word")).alias("truth")).agg(F.count("*").alias("n"))


@query("""select count(*) as n, md5(coalesce(sum(cast(concat('0x', substr(md5(concat_ws('#', length(sample_idx::varchar) || ':' || sample_idx, length(variant_idx::varchar) || ':' || variant_idx, coalesce(length(dosage::varchar) || ':' || dosage, 'n'))), 1, 15)) as bigint)), 0)::varchar) as hash from geno""", "geno")
def content_hash(s, d):
    return R.content_hash(V.geno(s, d), ["sample_idx", "variant_idx", "dosage"])


# ---- simulation -----------------------------------------------------------------------------------------------------
@query("""with z as (select vec_id as sample_idx, unnest(range(0, 64))::int as variant_idx, 8 * unnest(embedding)::double as z from embeddings), t as (select *, 1 / (1 + 0.2316419::double * abs(z)) as t, 0.1::double + 0.005::double * variant_idx as p from z),
  u as (select *, exp(-z * z / 2) / sqrt(2 * pi()) * t * (0.319381530::double + t * (-0.356563782::double + t * (1.781477937::double + t * (-1.821255978::double + t * 1.330274429::double)))) as tail from t)
  select variant_idx, dosage, count(*) as n from (select variant_idx, case when c < (1 - p) * (1 - p) then 0 when c < (1 - p) * (1 - p) + 2 * p * (1 - p) then 1 else 2 end as dosage from (select *, case when z >= 0 then 1 - tail else tail end as c from u)) group by 1, 2""")
def genotype_thresholds(s, d):
    long = V.table(s, d, "embeddings").select(F.posexplode("embedding").alias("variant_idx", "e"))
    p = 0.1 + 0.005 * F.col("variant_idx")
    return long.select("variant_idx", M.thresholded(8 * F.col("e").cast("double"), p).alias("dosage")).groupBy("variant_idx", "dosage").agg(F.count("*").alias("n"))


def simulated_pairs(s, d):
    """Pairs under all constraints: a third with an additive variant, blocks of eight variants."""
    v = V.variants_small(s, d)
    blocks = v.select("variant_idx", (F.col("variant_idx") / 8).cast("int").alias("block"))
    return M.interaction_pairs(v, v.where("variant_idx in (3, 20, 41)"), 12, 0.34, False, 5, blocks, True, True)


def simulated_liability(s, d):
    x = V.pheno(s, d).select("sample_idx", "split", F.col("age").alias("cov"), F.col("pc1").alias("add"))
    got = M.liability(x, {"cov": 0.2, "add": 0.3}, 7)
    return rounded(G.case_control(got, "liability", 0.3).select("sample_idx", "liability", "y"), "liability")


def two_snp_grid(s, d):
    """Each variant with its successor, over all samples' calls."""
    samples = V.pheno(s, d).select("sample_idx", F.when(F.col("split") == "train", "train").otherwise("test").alias("split"))
    pairs = V.variants_small(s, d).select(F.col("variant_idx").alias("i"), (F.col("variant_idx") + 1).alias("j"))
    return rounded(M.two_snp_grid(V.geno(s, d), samples, pairs), "mse_linear", "mse_tree", "delta")


def ensemble_one_patch(s, d):
    """Three base models on the same patches: each member's prediction of the patch's own samples and their mean."""
    from .models import patch

    own = patch(s, d, "y_cont")
    return rounded(E.ensemble_patches(own, ["linear_l2", "elasticnet", "bayesian"]), "pred")


EXTRA = {f.__name__: f for f in (simulated_pairs, simulated_liability, two_snp_grid, ensemble_one_patch)}
