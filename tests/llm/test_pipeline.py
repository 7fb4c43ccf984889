"""Every stage works on all its predecessor kept, and the whole run keeps what the stages' rules keep."""

from pyspark.sql import functions as F

import corpus_pipeline
from plurivox.llm import quality, secrets

from . import fixtures
from .test_classifiers import labelled
from .test_decontam import brute as leaks
from .test_jaccard import brute as groups


def test_stages(spark, tmp_path):
    docs, labels = labelled(spark, 150)
    rows = [tuple(r) for r in docs.collect()]
    extra = [rows[1][1], rows[2][1], rows[3][1] + " password=abcdefgh99", rows[5][1], None]
    more = fixtures.table(spark, extra, range(1000, 1000 + len(extra)))
    docs = docs.union(more)
    items = [(0, " ".join(rows[6][1].split()[5:17]), "c")]
    d = f"file://{tmp_path}"
    docs.write.parquet(f"{d}/documents.parquet")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string, node string").write.parquet(f"{d}/benchmark.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"]: texts[r["doc_id"]] for r in quality.judge(docs, labels).where("keep").collect()}
    comp = groups(kept.items())
    kept = {i: t for i, t in kept.items() if comp[i][1] == i}
    hit = leaks(kept.items(), [(i, t) for i, t, _ in items])
    kept = {i: t for i, t in kept.items() if not hit[i][4]}
    assert 6 not in kept
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, d).collect()}
    assert got.keys() == kept.keys()
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, d)
        assert state.columns == docs.columns, name
    assert all("password=abcdefgh99" not in (r["text"] or "") for r in state.collect())
    assert secrets.base_spans("password=abcdefgh99")


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_rows_are_judged_by_themselves(spark, tmp_path):
    """A contaminated row without an id takes no clean one with it, and different texts of one id stay."""
    clean, other, leak = (" ".join(f"{x}{k}" for k in range(30)) for x in ("alpha", "beta", "gamma"))
    spark.createDataFrame([(0, " ".join(leak.split()[5:17]))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = fixtures.table(spark, [clean, leak, other, leak, other], [None, None, None, 1, 1])
    out = corpus_pipeline.drop_contaminated(spark, docs, f"file://{tmp_path}")
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"]) for r in out.collect()) == [(0, clean), (0, other), (1, other)]
    docs = fixtures.table(spark, [clean, other, clean], [5, 5, 5])
    got = corpus_pipeline.drop_near_duplicates(spark, docs.repartition(3), f"file://{tmp_path}").collect()
    assert sorted((r["doc_id"], r["text"], r["pos"]) for r in got) == [(5, clean, 0), (5, other, 1)]


NAMES = ("_row", "_id", "_gone", "c0", "host", "path", "z", "h", "p", "s", "score", "info", "shift", "posterior", "node", "key", "rep", "n", "bucket", "step", "ids", "spans", "contaminated", "token", "item_id", "o")


def test_awkward_run(spark, tmp_path):
    """Null ids, repeated ids and rows, empty texts and a column for each internal name pass every stage; so do empty tables."""
    rows = fixtures.awkward(spark).drop("node").selectExpr("*", *(f"'x' AS `{c}`" for c in NAMES))
    clean = " ".join(f"plain{k}" for k in range(30))
    more = rows.where("doc_id is null").limit(1)
    for text in (clean, clean + " again", clean.upper() + " twice"):
        rows = rows.union(more.withColumn("text", F.lit(text)))
    d = f"file://{tmp_path}"
    rows.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(0, "no such words here at all", 1), (None, None, 2), (0, "", 3)], "item_id long, text string, host int").write.parquet(f"{d}/benchmark.parquet")
    state = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, d)
        assert state.columns == rows.columns, name
        assert state.where("host <> 'x' or z <> 'x' or _row <> 'x' or key <> 'x'").count() == 0
    assert state.where("doc_id is null").count() >= 3
    assert corpus_pipeline.run(spark, d).count() == state.count()
    empty = f"file://{tmp_path}/empty"
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
