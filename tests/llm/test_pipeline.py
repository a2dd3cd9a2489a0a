"""Each stage of the pipeline against a plain computation on its own input."""

import re

import corpus_pipeline as P
import pytest
from cairn.llm import toxicity
from test_against_brute_force import components, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES:
        out = P.written(stage(spark, docs, sf), "test")
        seen.append((docs.toPandas(), out.toPandas(), docs))
        docs = out
    return seen


def test_columns(stages):
    assert [name for name, _ in P.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    assert all(list(out.columns) == COLUMNS for _, out, _ in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    before, after, docs = stages[0]
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    low = {d for d, t in zip(before["doc_id"], before["text"]) if model.bias + model.weight * model.strength(t) < 0}
    assert set(after["doc_id"]) == low


def test_repeated_lines_go(stages):
    before, after, _ = stages[1]
    kept, held = {}, []
    for doc, text in sorted(zip(before["doc_id"], before["text"])):
        stay = []
        for line in (text or "").split("\n"):
            s = shingles(line, 5)
            if not s or not any(100 * len(s & o) >= 80 * len(s | o) for o in held):
                stay.append(line)
            if s:
                held.append(s)
        kept[doc] = "\n".join(stay)
    assert {d: t or "" for d, t in zip(after["doc_id"], after["text"])} == kept


def test_one_document_of_each_group_stays(stages):
    before, after, _ = stages[2]
    groups = components(before["doc_id"], before["text"], 5, 80, 100)
    assert sorted(after["doc_id"]) == sorted({c for _, c in groups.values()})


def test_benchmark_passages_go(duck, stages):
    before, after, _ = stages[3]

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))

    items = [words(t) for (t,) in duck.execute("SELECT text FROM benchmark").fetchall()]
    windows = {tuple(w[i : i + 10]) for w in items if w for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    clean = [d for d, t in zip(before["doc_id"], before["text"]) if not any(tuple(w[i : i + m]) in windows for w in [words(t)] for m in sizes for i in range(len(w) - m + 1))]
    assert sorted(after["doc_id"]) == sorted(clean)


def test_packing_holds_all(stages):
    before, after, _ = stages[4]
    assert set(after["doc_id"]) == set(before["doc_id"])
    assert after.groupby("sequence_id")["length"].sum().max() <= 2048


def test_rows_without_a_name_of_their_own(spark, duck, sf):
    item = max((t for (t,) in duck.execute("SELECT text FROM benchmark").fetchall() if t), key=len)
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(None, a), (None, a), (3, b), (3, b), (3, c), (2, ""), (None, b), (None, item), (4, item), (4, f"{c} more")]
    docs = P.written(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long"), "test")

    def told(out):
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    assert told(P.drop_near_copies(spark, docs, sf)) == sorted([(None, a), (3, b), (3, c), (2, ""), (4, item)], key=str)
    assert told(P.drop_contaminated(spark, docs, sf)) == sorted([r for r in rows if r[1] != item], key=str)


def test_empty_tables_pass_through(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, sf)
    assert docs.collect() == []
