import os
import random
from pathlib import Path

import corpus_pipeline as P
from assayspark.llm import exact_dedup, near_dedup, packing, source_audit
from assayspark.model import run, shared_folder
from tests.llm.test_near_dedup import brute


def test_stages_on_a_small_corpus(spark, tmp_path):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("aeioustrn") for _ in range(rnd.choice([2, 3, 4])))
    docs, labels = [], []
    for i in range(600):
        words = [word() for _ in range(rnd.choice([10, 40, 90]))]
        toxic = rnd.random() < 0.2
        for _ in range(3 if toxic else 0):
            words.insert(rnd.randrange(len(words)), rnd.choice(["badword", "worse"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    clean = [i for i, _, t in labels if not t]
    for k, i in enumerate(rnd.sample(clean, 40)):
        text = docs[i][1]
        docs.append((1000 + k, text.replace(" ", "  ") if k % 2 else text + " extra"))
    rows = [(i, t, "en", "s", len(t)) for i, t in docs] + [(5000, None, None, None, None), (5001, "", "en", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = {}
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(P.DOCUMENTS)
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r.text for r in docs.collect()}
    toxic = {i for i, _, t in labels if t}
    assert len(toxic & left["toxicity"].keys()) <= 2 and len(left["toxicity"]) >= len(rows) - len(toxic) - 2
    groups = {}
    for i, t in left["toxicity"].items():
        groups.setdefault("".join((t or "").split()), []).append((-len(t or ""), i))
    assert left["exact_dedup"].keys() == {min(g)[1] for g in groups.values()}
    kept = {d for d, _, _, k in brute(list(left["exact_dedup"].items()), 5) if k}
    assert left["near_dedup"].keys() == kept
    assert P.drop_near_copies(spark, docs.limit(0), str(tmp_path)).collect() == P.drop_toxic(spark, docs.limit(0), str(tmp_path)).collect() == []
    packed = P.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == kept


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """A copy goes and a text that shares its doc_id stays; copies without a doc_id go; equal rows become one; clashing and missing columns."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, "a  text of five words", 1), (7, "a text of five words", 2), (7, "quite another one", 3), (None, "atextoffivewords", 4), (8, "same", 5), (8, "same", 5), (8, "same", 6)]
    rows += [(None, "lost", 1), (None, "lost", 1), (20, long, 0), (21, long + " more", 0), (21, "unlike anything", 0), (None, long + " end", 0), (30, None, 0), (31, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").withColumns({"text_hash": P.F.lit("x"), "stays": P.F.lit(1), "entry": P.F.lit(2)}).repartition(3)
    got = P.drop_copies(spark, docs, str(tmp_path))
    assert got.columns == list(P.DOCUMENTS)
    kept = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    texts = [(3, "a  text of five words"), (7, "quite another one"), (8, "same"), (None, "lost"), (20, long), (21, long + " more"), (21, "unlike anything"), (None, long + " end"), (30, None)]
    assert kept == sorted(texts, key=str)
    kept = sorted(((r.doc_id, r.text) for r in P.drop_near_copies(spark, docs, str(tmp_path)).collect()), key=str)
    near = [r[:2] for r in rows if r[:2] not in {(7, "a text of five words"), (21, long + " more"), (None, long + " end")}]
    assert kept == sorted(set(near), key=str)
    assert len(P.drop_toxic(spark, docs, str(tmp_path)).collect()) == len(rows)
    assert {r.doc_id for r in P.pack(spark, docs, str(tmp_path)).collect()} == {r[0] for r in rows}


def test_a_run_takes_its_scratch_away(spark):
    """What the operators write to the shared folder goes with the run that they were in."""
    folder = Path(shared_folder(spark).removeprefix("file://"))
    folder.mkdir(parents=True, exist_ok=True)
    before = sorted(os.listdir(folder))
    docs = spark.createDataFrame([(i, f"some words of text {i % 4}", "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string")
    with run(spark) as own:
        assert near_dedup.near_duplicates(docs).count() == 12 and exact_dedup.exact_duplicates(docs).count() == 12
        assert packing.pack(docs).count() == 12 and source_audit.audit(docs).count() >= 0
        assert len(os.listdir(own.removeprefix("file://"))) > 3
    assert sorted(os.listdir(folder)) == before
