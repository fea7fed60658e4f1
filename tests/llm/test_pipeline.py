"""The pipeline's stages against brute force, and its run as a whole."""

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_operators import brute_groups, brute_measures  # noqa: E402


@pytest.fixture(scope="module")
def stages(spark, sf):
    from cirrostrat.runtime import stash, table

    docs, out = table(spark, sf, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = stash(stage(spark, docs, sf), name)
        out.append((docs, after))
        docs = after
    return out


def test_columns_stay_until_the_last_stage(stages):
    for before, after in stages[:-1]:
        assert sorted(after.dtypes) == sorted(before.dtypes)


def brute_kept(rows, limit=0.5, symbols=0.5):
    """The ids of (id, host, text) that pass the base rule and their host's verdict."""
    found = [(i, host, brute_measures(text)) for i, host, text in rows]
    failed = [m[0] < 10 or 100 * m[4] > 20 * m[0] for _, _, m in found]
    hosts = {}
    for (_, host, _), f in zip(found, failed):
        if host is not None:
            n, k = hosts.get(host, (0, 0))
            hosts[host] = (n + 1, k + f)
    total = sum(n for n, _ in hosts.values()) or 1
    m = sum(k for _, k in hosts.values()) / total
    beyond = sum(k * k / n for n, k in hosts.values()) / total - m * m - m * (1 - m) * len(hosts) / total
    strength = max(m * (1 - m) / beyond - 1, 0) if beyond > 0 else total
    rate = {h: (k + m * strength) / (n + strength) for h, (n, k) in hosts.items()}
    share = lambda h: symbols if h is None else -1 if rate[h] > limit else symbols * (1 - rate[h] / limit)
    return {i for (i, host, x), f in zip(found, failed) if not f and x[2] <= share(host) * x[0]}


def test_quality_rules_drop_what_fails(stages):
    before, after = stages[0]
    assert {r.doc_id for r in after.collect()} == brute_kept([(r.doc_id, r.source, r.text) for r in before.collect()])


def test_stages_take_odd_documents(spark, sf):
    from tests.llm.test_operators import ODD

    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    for c in ("lang", "n_chars", "__symbols", "symbols", "of_host", "__size", "__mix", "id", "g", "mix", "component", "grp"):
        df = df.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, df, sf), stage(spark, df.filter("false"), sf)
        assert none.count() == 0 and (out.count() > 0) == (name != "quality_rules")  # more than half of each host's rows fail
        assert name == "pieces" or out.columns == df.columns


def test_one_of_each_group_stays(stages):
    before, after = stages[1]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in after.collect()) == sorted({c for _, c in groups.values()})


def test_mixing_draws_whole_documents(stages):
    before, after = stages[2]
    texts = {r.doc_id: r.text for r in before.collect()}
    drawn = after.collect()
    assert all(texts[r.doc_id] == r.text for r in drawn) and 0 < len(drawn)


def test_pieces_decode_and_run_gives_the_same(spark, sf, stages):
    after = stages[3][1]
    assert after.filter("NOT decodes").count() == 0
    key = ["doc_id", "n_pieces"]
    assert sorted(map(tuple, after.select(key).collect())) == sorted(map(tuple, corpus_pipeline.run(spark, sf).select(key).collect()))
