"""The pipeline's stages against plain brute force, each on what the one before kept."""

from __future__ import annotations

import random
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from shardweave.llm import pii, quality, similar
from tests.llm.test_operators import groups_brute, labelled, lines_brute, plain, words


def test_stages(spark, tmp_path):
    d, labels = labelled(spark, 250)
    rng = random.Random(2)
    line = "a line that many documents hold, as it happens"
    base = words(rng, 150).split()
    rows = [(1000 + i, f"{words(rng, 40)}\n{line}\n{words(rng, 9)}") for i in range(4)]
    rows += [(2000 + i, " ".join([*base[: 20 * i], "new", *base[20 * i + 1 :]])) for i in range(5)]
    rows += [(3000, None), (3001, ""), (None, "no name"), (3002, "write to a.b@c.org please"), (3003, words(rng, 30)), (3003, words(rng, 30))]
    extra = spark.createDataFrame(rows, "doc_id long, text string")
    docs = d.unionByName(extra).withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "__gone": F.lit(1)})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    now, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, str(tmp_path)).cache()
        kept[name] = now
        if name != "packing":
            assert now.columns == before.columns and now.dtypes == before.dtypes
    model = quality.fit(docs, labels)
    want = [(r["doc_id"], r["text"] or "") for r in quality.score(docs, model).where("score >= 0.3").collect()]
    assert sorted(plain(kept["quality"]), key=str) == sorted(want, key=str) and len(want) < docs.count()
    lined = [(i, t) for i, _, _, t in lines_brute(want)]
    assert sorted(plain(kept["lines"]), key=str) == sorted(lined, key=str)
    named = [(i, t) for i, t in lined if i is not None]
    sets = [set(similar.shingle_set(t, 5).tolist()) for _, t in named]
    alike = lambda a, b: sets[a] == sets[b] or bool(sets[a] & sets[b]) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    first = [x for x, c in zip(named, groups_brute([i for i, _ in named], alike), strict=True) if x[0] == c]
    assert sorted(plain(kept["near duplicates"]), key=str) == sorted({*first, *[x for x in lined if x[0] is None]}, key=str)
    crf = pii.train()
    assert sorted(plain(kept["personal data"]), key=str) == sorted([(i, pii.masked(t, pii.find(t, crf)[1])) for i, t in plain(kept["near duplicates"])], key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in kept["personal data"].collect())
    assert {r["doc_id"] for r in kept["packing"].collect()} == {i for i, _ in plain(kept["personal data"])}
    whole = corpus_pipeline.run(spark, str(tmp_path)).agg(F.countDistinct("doc_id"), F.sum("length")).first()
    assert whole == kept["packing"].agg(F.countDistinct("doc_id"), F.sum("length")).first()


def test_near_copies_go_by_row(spark):
    rng = random.Random(6)
    base, other = words(rng, 150), words(rng, 90)
    rows = [(1, base, 0), (2, base + " end", 1), (2, other, 2), (2, other, 3), (3, base.upper(), 4), (None, base, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __gone long")
    kept = corpus_pipeline.near_stage(spark, docs, "")
    assert sorted(plain(kept), key=str) == sorted([(1, base), (2, other), (None, base)], key=str)


def test_nothing_else_imports_the_text_operators():
    root = Path(__file__).resolve().parents[2]
    for p in root.glob("shardweave/**/*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "shardweave.llm" not in p.read_text(), p
