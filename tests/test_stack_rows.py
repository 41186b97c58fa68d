"""The stack fixture hands every customer to the operator."""

from loomspan.plans import corpus_queries
from loomspan.plans import fixtures as X

SF = "/root/testdata/sf0.001"


def test_every_customer_is_a_root_file(spark):
    assert X.spark_sql(spark, SF, corpus_queries._ROOTS).count() == spark.read.parquet(f"{SF}/customer.parquet").count()


def test_stacks_differ_between_repositories(spark):
    assert len({r.stacks for r in corpus_queries.stack_detect(spark, SF).collect()}) > 1
