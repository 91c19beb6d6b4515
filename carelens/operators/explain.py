"""Explaining recommendations.

For member u the implicit-ALS normal equation is  W x_u = sum_b c_b y_b  with
W = Y'Y + sum_b (c_b - 1) y_b y_b' + reg * n_u * I  and  c_b = 1 + alpha * r_b  over the rated
products b. Hence rating(a) = y_a' x_u = sum_b y_a' W^-1 y_b c_b, one contribution per rated
product. Y'Y is one rank x rank aggregate; each member's rank x rank solve runs in an
Arrow-batched ``mapInPandas`` task that holds the product factors, and only the requested target products are explained, so
the output per member is (targets x rated products), never all product pairs.
With a non-negative fit the decomposition is not exact; the residual column reports the gap.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.recommendation import ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.operators.factor import ITEM_BLOCK, Params
from carelens.operators.implicit import Factors
from carelens.operators.util import small_side
from carelens.session import written

OUT_ROWS = 200_000            # contributions of one output batch


def sample_members(user_map: DataFrame, n: int = 10, seed: int = 7) -> DataFrame:
    """M17 sample: ``n`` members chosen by a seeded hash (repeatable, no driver collect)."""
    return user_map.orderBy(F.xxhash64("member_id", F.lit(seed)), "member_id").limit(n)


def contributions(model: ALSModel | Factors, ratings: DataFrame, targets: DataFrame,
                  params: Params, users: DataFrame | None = None) -> DataFrame:
    """(user_id, product_a, product_b, weight, rating_a, residual_a) for every target
    (user_id, product_id) pair and every product b the user rated. With ``users`` (user_id,
    member_id) the rows also name the member, joined before a member becomes many rows.

    Only product numbers and confidences meet per user; the product factors are sent to every
    task (up to ``ITEM_BLOCK`` products; more are joined to the rows instead)."""
    items = model.itemFactors.select(F.col("id").alias("product_id"),
                                     F.col("features").cast("array<double>").alias("v"))
    gram = item_gram(model)
    alpha, reg, rank = float(params.alpha), float(params.reg), len(gram)
    targets = written(targets.select("user_id", "product_id"), "targets")
    wanted = small_side(targets.select("user_id").distinct(), "target-users")
    ratings = ratings.join(wanted, "user_id", "left_semi")
    sent = items.limit(ITEM_BLOCK + 1).count() <= ITEM_BLOCK

    def lists(df, prefix, *cols):
        """Per user: product ids (and ``cols``), in id order; joined factors come flattened."""
        held = df.join(items, "product_id") if not sent else df.join(
            small_side(items.select("product_id"), "products"), "product_id", "left_semi")
        factors = [] if sent else ["v"]
        every = F.array_sort(F.collect_list(F.struct("product_id", *cols, *factors)))
        g = held.groupBy("user_id").agg(every.alias("x"))
        return g.select("user_id", *[F.col("x")[c].alias(prefix + c)
                                     for c in ("product_id", *cols)],
                        *[F.flatten(F.col("x")[c]).alias(prefix + c) for c in factors])

    rows = (lists(targets, "a_").join(lists(ratings, "b_", "confidence"), "user_id")
            .join(model.userFactors.withColumnRenamed("id", "user_id"), "user_id"))
    if users is not None:
        rows = rows.join(users.select("user_id", "member_id"), "user_id")
    if sent:
        table = items.orderBy("product_id").toPandas()
        known = rows.sparkSession.sparkContext.broadcast(
            (table["product_id"].to_numpy(), np.stack(table["v"].to_numpy())))

    def vectors(ids, flat):
        if not sent:
            return np.asarray(flat, float).reshape(-1, rank)
        return known.value[1][np.searchsorted(known.value[0], ids)]

    def solve(batches):
        eye = np.eye(rank)
        for pdf in batches:
            out, size, first, total = [], [], 0, 0
            for at, row in enumerate(pdf.itertuples(index=False)):
                yb = vectors(row.b_product_id, None if sent else row.b_v)
                conf = np.asarray(row.b_confidence, float)
                c = 1.0 + alpha * np.abs(conf)
                w = gram + (yb * (c - 1.0)[:, None]).T @ yb + reg * (conf > 0).sum() * eye
                ya = vectors(row.a_product_id, None if sent else row.a_v)
                # w is symmetric: one solve serves all targets of the member
                contrib = (np.linalg.solve(w, ya.T).T @ yb.T) * c[None, :]
                rating = ya @ np.asarray(row.features, float)
                resid = rating - contrib.sum(axis=1)
                n_a, n_b = contrib.shape
                out.append((np.repeat(row.a_product_id, n_b), np.tile(row.b_product_id, n_a),
                            contrib.ravel(), np.repeat(rating, n_b), np.repeat(resid, n_b)))
                size.append(n_a * n_b)
                total += n_a * n_b
                if at + 1 == len(pdf) or total >= OUT_ROWS:
                    own = {k: np.repeat(pdf[k].to_numpy()[first:at + 1], size) for k in keys}
                    yield pd.DataFrame(own | dict(zip(
                        ("product_a", "product_b", "weight", "rating_a", "residual_a"),
                        map(np.concatenate, zip(*out)))))
                    out, size, first, total = [], [], at + 1, 0

    keys = [c for c in ("user_id", "member_id") if c in rows.columns]
    schema = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys) + (
        ", product_a int, product_b int, weight double, rating_a double, residual_a double")
    return rows.mapInPandas(solve, schema)


def item_gram(model: ALSModel | Factors) -> np.ndarray:
    """Y'Y over all item factors: a partial matrix per task, summed by index (rank^2 numbers)."""
    rank = model.rank

    def partial(batches):
        g = np.zeros((rank, rank))
        for pdf in batches:
            if len(pdf):
                y = np.stack(pdf["features"].to_numpy()).astype(float)
                g += y.T @ y
        yield pd.DataFrame({"i": np.arange(rank * rank, dtype=np.int32), "v": g.ravel()})

    total = (model.itemFactors.select("features").mapInPandas(partial, "i int, v double")
             .groupBy("i").agg(F.sum("v").alias("v")).toPandas())
    g = np.zeros(rank * rank)
    g[total["i"].to_numpy()] = total["v"].to_numpy()
    return g.reshape(rank, rank)


def named_contributions(contrib: DataFrame, user_map: DataFrame, product_map: DataFrame
                        ) -> DataFrame:
    """J4 + M17: restore member and product names; the product map is joined under two roles."""
    pm = product_map
    a = pm.select(F.col("product_id").alias("product_a"),
                  F.col("feature_name").alias("feature_name_a"),
                  F.col("feature_value").alias("feature_value_a"),
                  F.col("chronic_flag").alias("chronic_flag_a"))
    b = pm.select(F.col("product_id").alias("product_b"),
                  F.col("feature_name").alias("feature_name_b"),
                  F.col("feature_value").alias("feature_value_b"),
                  F.col("chronic_flag").alias("chronic_flag_b"))
    if "member_id" not in contrib.columns:
        contrib = contrib.join(user_map, "user_id")
    return (contrib.join(a, "product_a").join(b, "product_b")
            .select("member_id", "feature_name_a", "feature_value_a", "chronic_flag_a",
                    "feature_name_b", "feature_value_b", "chronic_flag_b", "weight",
                    "rating_a", "residual_a"))
