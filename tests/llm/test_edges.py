"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; scans, shards, components."""

import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import common, decontaminate, graphs, jaccard, lines, neighbours, packing, pii, queries, repeats, sharding, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("spans", "words", "n_words", "key", "n", "label", "slot", "shard", "piece", "start", "length", "row", "gone", "gone_id", "n_lines", "n_removed", "tokens", "toxic", "fold", "hit_id", "items")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    line = "the quick brown fox jumps over the lazy dog tonight"
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, long), (5, line), (6, line), (6, line), (7, f"{line}\n{line}"), (None, line), (8, "a"), (9, "ß İ 日本 \U0001f600")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    return docs


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog tonight"), (2, None), (3, ""), (None, "a"), (4, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")], "item_id long, text string")


LABELS = "doc_id long, quality int, toxic int"


def operators(spark, bench):
    labels = spark.createDataFrame([(5, 1, 1), (8, None, 0), (None, 1, 1), (9, 1, None)], LABELS)
    return {
        "pack": lambda d: packing.best_fit_pack(d, 2048),
        "pii": lambda d: pii.digest(pii.find(d)),
        "toxicity": lambda d: toxicity.score(d, toxicity.train(d, labels)),
        "jaccard": lambda d: jaccard.near_duplicates(d),
        "leaks": lambda d: decontaminate.digest(decontaminate.report(d, bench)),
        "count": lambda d: tokens.count(d),
        "repeats": lambda d: repeats.digest(repeats.remove(d)),
        "lines": lambda d: lines.digest(lines.dedup_lines(d)),
        "shards": lambda d: sharding.assign(d, "doc_id", ["a", "b"], 7),
    }


@pytest.mark.parametrize("name", ["pack", "pii", "toxicity", "jaccard", "leaks", "count", "repeats", "lines", "shards"])
def test_odd_and_empty_tables(spark, odd, none, bench, name):
    run = operators(spark, bench)[name]
    got = run(odd).collect()
    if name == "pack":
        assert {r["doc_id"] for r in got} == {None, *range(1, 10)}
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(map(str, [1, 2, 3, 4, 5, 6, 6, 7, None, 8, 9]))
    assert run(none).collect() == []


def test_values_of_odd_rows(spark, odd, bench):
    groups = {r["doc_id"]: r for r in jaccard.near_duplicates(odd).collect()}
    assert groups[5]["component_id"] == groups[6]["component_id"] == groups[None]["component_id"] == 5
    assert groups[1]["n_shingles"] == groups[3]["n_shingles"] == 0 and groups[4]["component_id"] == 4
    leaks = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.report(odd, bench)).collect()}
    assert leaks[5]["n_hit"] == 10 and leaks[4]["n_hit"] == 11 and not leaks[1]["contaminated"] and leaks[7]["n_words"] == leaks[7]["n_hit"] == 20
    kept = {r["doc_id"]: r for r in lines.dedup_lines(odd).collect()}
    assert kept[1]["text"] is None and kept[7]["text"] == "" and kept[5]["text"].startswith("the quick") and kept[6]["n_removed"] == 0
    assert decontaminate.report(odd, bench.limit(0)).filter("contaminated").isEmpty()


def test_lines_of_rows_without_a_name_of_their_own(spark, tmp_path):
    line, other, third = "the quick brown fox jumps over the lazy dog tonight", "seven other words that no one else has", "a third line that is held by two rows"
    rows = [(None, f"{line}\n{third}"), (5, line), (6, f"{line}\n{other}"), (6, f"{other}\n{other}\nend"), (None, third), (7, None), (7, other), (8, "alone")]
    spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, row_key int").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["row_key"]: (r["doc_id"], r["text"], r["n_removed"]) for r in lines.dedup_rows(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert got == {0: (None, third, 1), 1: (5, line, 0), 2: (6, other, 1), 3: (6, "end", 2), 4: (None, "", 1), 5: (7, None, 0), 6: (7, "", 1), 7: (8, "alone", 0)}
    told = queries.op9_line_dedup(spark, str(tmp_path)).collect()
    assert len(told) == len(rows) and sum(r["n_removed"] for r in told) == 6


def test_scan_across_blocks(spark):
    rng, end = np.random.default_rng(3), 9
    flat = {f: np.where(rng.random(n) < 0.05, end, 1).astype("<u2") for f, n in ((0, 5003), (1, 0), (2, 64))}
    flat[2][:] = 1
    blocks = [(f, b, ids[b * 16 : b * 16 + 16].tobytes()) for f, ids in flat.items() for b in range(-(-len(ids) // 16))]
    tokens.RUN, before = 4, tokens.RUN
    try:
        frame = spark.createDataFrame(blocks + blocks[:1] + [(7, 0, None)], "file int, block long, data binary")
        got = sorted((r["file"], r["document"], r["start"], r["n_tokens"]) for r in tokens.scan(frame, end).collect())
    finally:
        tokens.RUN = before
    want = []
    for f, ids in flat.items():
        start = k = 0
        for stop in [*np.flatnonzero(ids == end), *([len(ids)] if len(ids) and ids[-1] != end else [])]:
            want.append((f, k, start, int(stop) - start))
            start, k = int(stop) + 1, k + 1
    assert got == want


def test_neighbours_leave_out_what_has_no_direction(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (50, [1.0, 1.0]), (50, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("node", F.lit(1)).withColumn("score", F.lit("x"))
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in neighbours.search(table, table.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 50), (0, 3, 2), (50, 1, 0), (50, 2, 1), (50, 3, 2)]
    assert neighbours.search(table.limit(0), table.limit(0)).collect() == []


def test_checksums_context_and_redaction(spark):
    text = "IBAN GB82 WEST 1234 5698 7654 32 or GB83 WEST 1234 5698 7654 32, call +1 (555) 123-4567, mail a@b.co, card 4111 1111 1111 1111 or 4111 1111 1111 1112"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = [(s["kind"], text[s["start"] : s["end"]], s["score"]) for s in pii.find(df).first()["spans"]]
    assert spans == [("email", "a@b.co", 1.0), ("card", "4111 1111 1111 1111", 0.9), ("phone", "+1 (555) 123-4567", 0.8), ("iban", "GB82 WEST 1234 5698 7654 32", 1.0)]
    assert pii.redact(df).first()["text"] == text.replace("GB82 WEST 1234 5698 7654 32", "<iban>").replace("+1 (555) 123-4567", "<phone>").replace("a@b.co", "<email>").replace("4111 1111 1111 1111", "<card>")


def test_very_many_spans_in_one_text(spark):
    text = "a@b.co 1.2.3.4, " * 50_000
    began = time.time()
    row = pii.digest(pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert time.time() - began < 60
    assert row["n_email"] == row["n_ip"] == 50_000 and row["n_card"] == row["n_phone"] == 0
    said = [f"email:{16 * i}:{16 * i + 6}" for i in range(50_000)] + [f"ip:{16 * i + 7}:{16 * i + 14}" for i in range(50_000)]
    assert row["base_sha256"] == hashlib.sha256(",".join(said).encode()).hexdigest()


def test_lookup_table_is_even_and_steady():
    names = [f"s{i}" for i in range(5)]
    table = sharding.lookup_table(names, 101)
    assert sorted(np.bincount(table)) == [20, 20, 20, 20, 21]
    fewer = sharding.lookup_table(names[:4], 101)
    assert sum(a != b for a, b in zip(table, fewer) if a != 4) < 40
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["label"] for r in graphs.components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}


def test_search_of_bins_empties_one():
    bins = packing.Bins(np.array([6, 6, 4, 4, 4, 3, 3]), 10)
    bins.best_fit()
    bins.local_search()
    assert sum(1 for b in bins.items if b) == 3
    assert sorted(i for b in bins.items for i in b) == list(range(7)) and all(sum(bins.size[i] for i in b) <= 10 for b in bins.items)


def test_shared_folder_is_the_sessions(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("blank", [" ", "\n", "\t", " \n"])
def test_long_white_space(blank):
    import public_tokenizers
    import tokenizers

    enc = tokens.encoder(None)
    library = tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    run = blank * (1_000_000 // len(blank))
    for text in (run, f"a{run}", f"{run}b c", f"x {run}<|endoftext|>{run} y{run}\u3000z"):
        assert tokens.library_ids_of(enc, text).tolist() == library.encode(text, add_special_tokens=False).ids
        plain = text.replace("<|endoftext|>", "|")
        assert tokens.ids_of(enc, plain).tolist() == library.encode(plain, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n", "\t"])
def test_very_long_white_space_is_packed_and_counted(spark, blank):
    text = blank * 10_000_000 + "end"
    enc = tokens.encoder(None)
    ids = tokens.library_ids_of(enc, text)
    assert enc.decode(ids.tolist()) == text
    docs = spark.createDataFrame([(1, text), (2, "b")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in tokens.count(docs).collect()} == {1: len(ids), 2: 1}
    packed = packing.best_fit_pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {1: len(ids) + 1, 2: 2}


@pytest.mark.parametrize("limit", [0, 1_000_000])
def test_leaks_of_rows_that_share_a_doc_id(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", limit)
    rows = [(1, "a b c d e f g h i j"), (1, "zzz"), (None, "x A B C D E F G H I J k"), (None, None), (2, "b c d e f g h i j"), (3, "p q zzz p q"), (4, "a b c d e f g h i j " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "a b c d e f g h i j"), (8, "P q"), (9, "zzz")], "item_id long, text string")
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate.report(docs, bench).collect()), key=repr)
    want = [(1, 10, 10, ["7"], True), (1, 1, 1, ["9"], True), (None, 12, 10, ["7"], True), (None, 0, 0, [], False), (2, 9, 0, [], False), (3, 5, 5, ["8", "9"], True), (4, 30000, 30000, ["7"], True)]
    assert got == sorted(want, key=repr)


def test_vectors_of_every_length_are_searched(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(20)] + [(2000, [1.0] * 5), (3000, [1.0, 2.0]), (3001, [2.0, 4.0]), (3002, [0.0, 0.0]), (None, [1.0, 1.0])]
    rows[0] = (0, [1.0 + 1e-12, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0])
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(table, table.filter("vec_id % 50 = 0 or vec_id > 500")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {*range(0, 400, 50), *range(1000, 1020), 3000, 3001}
    own = {k: np.array(v) for k, v in rows if k is not None}
    for query, found in got.items():
        q = own[query]
        want = sorted(((-float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)), k) for k, v in own.items() if k != query and len(v) == len(q) and v.any()))[:5]
        assert [k for _, k, _ in sorted(found)] == [k for _, k in want]
        assert np.allclose([s for *_, s in sorted(found)], [-s for s, _ in want], atol=1e-14)


def test_rows_lose_repeated_lines_whatever_their_columns(spark, odd, none):
    assert lines.digest(lines.dedup_rows(none)).collect() == []
    got = lines.dedup_rows(odd)
    assert set(CLASH) - {"n_lines", "n_removed"} <= set(got.columns) and got.schema["n_lines"].dataType.simpleString() == "int"
    kept = [(r["doc_id"], r["text"], r["n_removed"]) for r in got.collect()]
    line = "the quick brown fox jumps over the lazy dog tonight"
    assert sorted(k for k in kept if k[0] in (5, 6, 7)) == [(5, line, 0), (6, "", 1), (6, "", 1), (7, "", 2)] and (None, "", 1) in kept


@pytest.mark.parametrize("limit", [0, 10**9])
def test_lines_by_shuffles_and_broadcasts(spark, sf, monkeypatch, limit):
    monkeypatch.setattr(lines, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(lines, "BROADCAST_NUMBERS", limit)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_md5"]) for r in lines.digest(lines.dedup_rows(docs)).collect()}
    want = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["kept_md5"]) for r in queries.op9_line_dedup(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("heavy", [1, 5])
def test_lines_that_share_frequent_shingles(spark, monkeypatch, heavy):
    """A passage in all lines: its shingles come last in the order, whatever the limit, and no pair is lost."""
    rng = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(24))
    texts = [f"{passage} " + " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(12))) for _ in range(60)]
    texts = [f"{t}\n{t.replace(' p9 ', ' q ')}" for t in texts]
    whole = [(d, i, line.split()) for d, t in enumerate(texts) for i, line in enumerate(t.split("\n"))]
    sets = [(d, i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)}) for d, i, w in whole]
    want = {(d, i) for n, (d, i, s) in enumerate(sets) if any(5 * len(s & e) >= 4 * len(s | e) for *_, e in sets[:n])}
    monkeypatch.setattr(lines, "HEAVY", heavy)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r["doc_id"], r["line_no"]) for r in lines.matches(docs, 5, 80, 100).collect()} == want
    assert 0 < len(want) < len(sets)


def test_lists_hold_no_token_of_very_many_lines(spark):
    """A passage in 700 otherwise different lines is in none of their first tokens."""
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [" ".join(f"a{n}x{i}" for i in range(20)) + f" {passage} " + " ".join(f"b{n}x{i}" for i in range(20)) for n in range(700)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    each = lines._lines(docs, 5).select(F.col("doc_id").alias("id"), F.size("tokens").alias("n"), F.struct("doc_id", "line_no").alias("first"), "tokens")
    reach = lambda n: n - F.ceil(n * 0.8).cast("int") + 1
    classes = each.withColumn("prefix", F.transform(F.slice("tokens", F.lit(1), reach(F.col("n"))), lines._entry))
    posted = lines._posted(classes, lambda some: some.select("id", "tokens"), reach)
    assert posted.count() == classes.agg(F.sum(F.size("prefix"))).first()[0]
    assert classes.select(F.explode("prefix").alias("t")).groupBy("t").count().agg(F.max("count")).first()[0] == 700
    assert posted.groupBy("token").count().agg(F.max("count")).first()[0] < 10


def test_pairs_of_lines_that_share_a_little_are_not_verified(spark, monkeypatch):
    """Of 40 groups of six lines, each with a run of ten words in common and 40 of their own, no pair is near."""
    texts = [" ".join(f"a{n}x{i}" for i in range(20)) + " " + " ".join(f"g{n // 6}x{i}" for i in range(10)) + " " + " ".join(f"b{n}x{i}" for i in range(20)) for n in range(240)]
    docs, listed, write = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), [], lines.written
    monkeypatch.setattr(lines, "written", lambda df, name, *rows: (listed.append(df.count()) if name == "pairs" else None, write(df, name, *rows))[1])
    assert lines.matches(docs, 5, 80, 100).count() == 0
    assert listed and sum(listed) < 10


def test_a_long_text_is_split_once_for_the_lines_that_stay(spark):
    texts = [(1, "\n".join(f"line {i}" for i in range(60_000)) + "\nline 7")]
    began = time.time()
    (row,) = lines.dedup_rows(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert (row["text"], row["n_lines"], row["n_removed"]) == (texts[0][1][:-7], 60_001, 1)
    assert time.time() - began < 60


def test_hot_digits_give_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 120")
    want = {r["doc_id"]: r["kept_sha256"] for r in repeats.digest(repeats.remove(docs)).collect()}
    monkeypatch.setattr(repeats, "HOT", 0)
    assert {r["doc_id"]: r["kept_sha256"] for r in repeats.digest(repeats.remove(docs)).collect()} == want
