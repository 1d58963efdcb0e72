"""Votes that don't depend on the order in which they are added up."""

import math
import random

from pyspark.sql import functions as F

from neuritic.operators import forest, rules

SCHEMA = "cell_id string, cell_type string, seq int, id int, proxy int, primary_root int, pred int, conf double"


def voters(*votes, cell_type="pyramidal"):
    """A primary subtree below node 1 with these labels and confidences."""
    return [("c", cell_type, 0, 1, 1, None, 1, 1.0)] + [("c", cell_type, k, k + 1, 1, 2, p, c) for k, (p, c) in enumerate(votes, 1)]


def labels(df):
    return [r.pred for r in df.orderBy("id").collect()]


def test_equal_votes_go_to_the_smaller_label(spark):
    # 0.1 + 0.2 + 0.3 is more than 0.6 in doubles, in this order
    rows = spark.createDataFrame(voters((3, 0.1), (3, 0.2), (3, 0.3), (2, 0.6)), SCHEMA).coalesce(1)
    assert labels(rules.subtree_vote(rows)) == [1, 2, 2, 2, 2]
    assert labels(rules.subtree_vote(rows.orderBy("conf"))) == [1, 2, 2, 2, 2]


def test_equal_subtrees_keep_the_first_in_the_file(spark):
    one = voters((2, 0.6))
    two = [("c", "pyramidal", k + 10, k + 10, 1, 11, 2, c) for k, c in enumerate((0.1, 0.2, 0.3), 1)]
    assert labels(rules.single_class(spark.createDataFrame(one + two, SCHEMA).coalesce(1), 2, 3)) == [1, 2, 3, 3, 3]


def test_a_margin_that_is_just_met(spark):
    # 2.58 of 4.3; the doubles add up to a little less than 0.6 of all
    votes = [(2, 0.86), (3, 0.93), (3, 0.79), (2, 0.99), (2, 0.73), (3, 0.5)]
    assert labels(rules.soft_majority(spark.createDataFrame(voters(*votes), SCHEMA).coalesce(1)))[-1] == 2


def test_votes_are_the_doubles_next_to_exact_sums(spark):
    draw = random.Random(7)
    rows = [(c, draw.choice((2, 3, 4)), draw.choice((draw.uniform(0.001, 1), draw.randrange(1, 100) / 100))) for c in range(400) for _ in range(draw.randrange(1, 12))]
    rows += [(400, 2, 0.1)] * 5000 + [(400, 3, 1.0), (400, 3, 2.0**-53), (400, 3, 2.0**-62), (400, 4, None), (400, 4, float("nan"))]
    got = {r.cell: (r.v2, r.v3, r.v4) for r in rules._votes(spark.createDataFrame(rows, "cell int, pred int, conf double").repartition(7), ["cell"], F.col("conf")).collect()}
    for c in range(401):
        assert got[c] == tuple(math.fsum(w for cell, p, w in rows if cell == c and p == k and w and w == w) for k in (2, 3, 4))


def test_an_apical_subtree_by_doubles(spark):
    # 1.43 of all for basal and apical; in doubles 0.91 + 0.52 is more than 0.82 + 0.61, in either order
    schema = "cell_id string, cell_type string, seq int, id int, type int, x double, y double, z double, radius double, parent int, pred int, conf double"
    of = [(1, -1, 0, 1, 1.0), (2, 1, -10, 4, 0.52), (3, 2, -12, 4, 0.91), (4, 3, -14, 3, 0.61), (5, 4, -16, 3, 0.82)] + [(k, 1 if k == 6 else k - 1, 20 + k, 4, 0.9) for k in range(6, 12)]
    topo = forest.topology(spark.createDataFrame([("c", "pyramidal", k, i, p, float(x), 0.0, 0.0, 5.0 if i == 1 else 1.0, up, p, c) for k, (i, up, x, p, c) in enumerate(of)], schema))
    assert labels(rules.single_apical(topo)) == [1, 3, 3, 3, 3] + [4] * 6


def test_a_subtree_s_label_by_doubles(spark):
    rows = spark.createDataFrame(voters((2, 0.82), (3, 0.52), (2, 0.61), (3, 0.91)), SCHEMA)
    assert labels(rules.subtree_vote(rows)) == [1, 3, 3, 3, 3]


def test_one_subtree_of_a_class_by_doubles(spark):
    one = voters((2, 0.82), (2, 0.61))
    two = [("c", "pyramidal", k + 10, k + 10, 1, 11, 2, c) for k, c in enumerate((0.52, 0.91), 1)]
    assert labels(rules.single_class(spark.createDataFrame(one + two, SCHEMA), 2, 3)) == [1, 3, 3, 2, 2]
