"""Views as Spark builds them."""

import re

from broadsheet.operators import ratings
from workload.views import Tables

FOLDER = "/root/testdata/sf0.001"


def test_methods_are_short_enough_to_be_compiled(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    Tables(spark, FOLDER)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 8000
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 5000)
    Tables(spark, FOLDER)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == 5000
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")


def test_answers_of_people_are_not_shuffled(spark):
    people = Tables(spark, FOLDER).people
    plan = people._jdf.queryExecution().optimizedPlan().toString()
    above, below = re.split(r"\n.*Window \[", plan, maxsplit=1)
    assert all(f"AS {c}#" in above and c not in below for c in ratings.model_columns(people))
