"""Every query of the catalogue against its SQL, at the smallest size."""

import duckdb
import pytest

from hopforge.plans.oracle import ORACLE
from hopforge.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
TRAINING = ("train_softmax_head", "train_sage_network", "train_sage_batches", "train_gcn_batches", "train_gat_batches")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in ("part", "lineitem", "embeddings"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    want = duck.execute(ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    same = lambda df: df[columns].sort_values(columns).reset_index(drop=True).astype(str)
    assert same(got).equals(same(want))


@pytest.mark.parametrize("name", ["train_softmax_head", "train_sage_network", "train_gcn_batches"])
def test_losses_fall(spark, name):
    losses = [r.loss for r in QUERIES[name](spark, DATA).orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_merge_plan_weights(spark):
    rows = QUERIES["merge_plan"](spark, DATA).collect()
    assert len({r.merged_part for r in rows}) <= len(rows) == 8
    assert all(r.merged_part <= r.part for r in rows)


def test_all_but_rows_only_have_sql():
    assert set(QUERIES) - set(ORACLE) == {"merge_plan", *TRAINING}
