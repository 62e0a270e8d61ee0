"""The corpus pipeline against a slow version of each stage, and on odd tables."""

from __future__ import annotations

import corpus_pipeline
from corvane.llm import common, pii, quality, queries, simhash, tokens

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = common.read(spark, SF, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, common.read(spark, SF, "labels"))
    pair = model.compressors()
    kept = {i: t for i, t in rows.items() if not (m := quality.measure(t, *pair)) or model.probability(*m) >= quality.KEEP}
    first: dict[str, int] = {}
    for i in sorted(kept):
        first.setdefault(kept[i], i)
    kept = {i: kept[i] for i in first.values()}
    signed = {r["doc_id"]: r for r in simhash.signatures(docs).collect()}

    def near(a: int, b: int) -> bool:
        x, y = signed.get(a), signed.get(b)
        if x is None or y is None:
            return False
        bits = sum(bin((x[c] ^ y[c]) & (2**64 - 1)).count("1") for c in ("high", "low"))
        return bits <= simhash.MAX_DISTANCE and min(x["n_words"], y["n_words"]) >= simhash.MIN_RATIO * max(x["n_words"], y["n_words"])

    root = {i: i for i in kept}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    order = sorted(kept)
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    want = {i for i in order if find(i) == i}
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"] for r in out}
    assert want <= got and len(got - want) <= 0.1 * max(1, len(order) - len(want))
    encode, p = tokens.encoder(tokens.BYTE_BPE), pii.Pseudonymiser()
    sizes: dict[int, int] = {}
    bins: dict[int, list[int]] = {}
    for r in out:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["tokens"]
        bins.setdefault(r["bin_id"], []).append(r["tokens"])
    assert sizes == {i: len(encode(p.replace(rows[i])[0])) for i in got}
    assert all(sum(b) <= 4096 and len(b) <= 32 for b in bins.values())


def test_stages_keep_columns_and_survive_odd_tables(spark):
    docs = common.read(spark, SF, "documents")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "x 10.0.0.1", None, "s", 10)], docs.schema)
    for table in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, table, SF)
            assert got.columns == docs.columns, name
            got.count()
        corpus_pipeline.STAGES[-1][1](spark, table, SF).count()


def test_registry():
    assert [n.split("_")[0] for n in queries.queries()] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())
