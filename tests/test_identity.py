import hashlib
import random

import pandas as pd

from folioforge.operators import identity
from tests.folds import fold


def ordered(found):
    return found.sort_values("capture_id").reset_index(drop=True)


def chain(n):
    """URLs on a path, each sharing a DOI with the next: first all URLs alone, then the DOIs in a mixed order."""
    rng = random.Random(5)
    url = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    rows = [(u, "") for u in url] + rng.sample([(url[i], f"10.1/{i // 2 + i % 2}") for i in range(n)] + [(url[i], f"10.1/{n + i}") for i in range(n)] + [(url[i + 1], f"10.1/{n + i}") for i in range(n - 1)], 3 * n - 1)
    return pd.DataFrame([(u, d, "t", i) for i, (u, d) in enumerate(rows)], columns=["url_hash", "doi", "captured_at", "seq"])


def test_a_long_chain_is_one_component(spark):
    log = chain(300)
    pd.testing.assert_frame_equal(ordered(identity.resolve(spark.createDataFrame(log)).toPandas()), ordered(fold(log)), check_dtype=False)


def test_every_mix_of_arrivals_equals_the_fold_without_python_tasks(spark):
    rng = random.Random(3)
    rows = []
    for group in range(60):
        urls, dois = rng.randint(1, 7), rng.randint(1, 7)
        rows += [(f"{group:020d}u{rng.randrange(urls)}", f"10.{group}/{rng.randrange(dois)}" if rng.random() < 0.6 else "", str(rng.randrange(9))) for _ in range(rng.randint(1, 50))]
    log = pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=["url_hash", "doi", "captured_at", "seq"])
    found = identity.resolve(spark.createDataFrame(log))
    assert "Pandas" not in found._jdf.queryExecution().toString()
    pd.testing.assert_frame_equal(ordered(found.toPandas()), ordered(fold(log)), check_dtype=False)


def test_one_url_and_one_doi_with_most_arrivals(spark):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.7 else f"u{rng.randrange(9)}", rng.choice(["", "10.1/hot", "10.1/hot", f"10.1/{rng.randrange(5)}"]), str(rng.randrange(90))) for _ in range(1500)]
    log = pd.DataFrame([(*r, i) for i, r in enumerate(rows)], columns=["url_hash", "doi", "captured_at", "seq"])
    pd.testing.assert_frame_equal(ordered(identity.resolve(spark.createDataFrame(log)).toPandas()), ordered(fold(log)), check_dtype=False)
    only = log.assign(url_hash="hot", doi="")
    pd.testing.assert_frame_equal(ordered(identity.resolve(spark.createDataFrame(only)).toPandas()), ordered(fold(only)), check_dtype=False)
    blocks = identity._blocks(spark.createDataFrame(only).selectExpr("url_hash", "struct(captured_at, seq) AS at"), "url_hash", "block").groupBy("block").count().collect()
    assert len(blocks) == 4 and max(r["count"] for r in blocks) < 750


def test_an_empty_log(spark):
    assert identity.resolve(spark.createDataFrame([], "url_hash string, doi string, captured_at string, seq long")).count() == 0
