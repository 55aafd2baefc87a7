import io
import zipfile

import __spark_entry__
from granary.plans import shipping


def test_the_zip_holds_the_package():
    names = zipfile.ZipFile(io.BytesIO(shipping.zipped())).namelist()
    assert {"granary/__init__.py", "granary/plans/queries.py", "granary/functions/markup.py"} <= set(names)
    assert all(n.startswith("granary/") and n.endswith(".py") for n in names)


def test_shipping_is_done_once(spark):
    shipping.ship(spark)
    files = spark.sparkContext.listFiles
    shipping.ship(spark)
    assert spark.sparkContext.listFiles == files
    assert any(f.endswith("granary.zip") for f in files)


def test_queries_keep_their_names_and_have_sql_of_their_own():
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert all(q.__name__ == n for n, q in known.items() if n != "pipeline")
