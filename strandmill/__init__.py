"""strandmill: a Spark-first genotype-to-phenotype analytics engine."""
