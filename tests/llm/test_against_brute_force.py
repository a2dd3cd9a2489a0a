"""Each operator's query against a plain computation over the same whole tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tokenizers

from cairn.llm import queries as Q
from cairn.llm import jaccard, neighbours, packing, tokens, toxicity
from cairn.llm.oracles import ORACLES


@pytest.fixture(scope="module")
def docs(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, same_as_sql, name):
    same_as_sql(getattr(Q, name)(spark, sf), ORACLES[name])


def test_packing(spark, sf, docs, tokenizer):
    out = Q.op1_packing(spark, sf).toPandas().sort_values(["doc_id", "piece"])
    pieces = {k: g for k, g in out.groupby("doc_id")}
    assert sorted(pieces) == sorted(docs["doc_id"])
    for doc, text in zip(docs["doc_id"], docs["text"]):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[doc]
        assert list(own["start"]) == [0, *np.cumsum(own["length"])[:-1]] and own["length"].sum() == len(ids)
        assert len(own) == -(-len(ids) // 2048) and (own["length"].iloc[1:] == 2048).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own["start"], own["length"])] == list(own["ids_crc32"])
    for _, held in out.groupby("sequence_id"):
        held = held.sort_values("offset")
        assert list(held["offset"]) == [0, *np.cumsum(held["length"])[:-1]] and held["length"].sum() <= 2048
    assert out["sequence_id"].nunique() <= -(-out["length"].sum() // 2048) + 1


def test_ids_are_those_of_the_vocabulary(tokenizer):
    enc = tokens.encoder()
    for text in ["", " ", "a  b\n\n c", "don't  'S 12345 x²", "naïve 日本語 🙂‍", "\x00\x1f　tab\t", "a" * 3000, "\r\n \r\n", "_-_ (x) ... !!!"]:
        assert list(tokens.ids_of(enc, text)) == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_in_packed_texts(spark, tokenizer):
    texts = ["<|endoftext|>", "a  <|endoftext|>  b\n", "x<|endoftext|><|endoftext|>y <|endoftext|", "<|ENDOFTEXT|> <<|endoftext|>>", "word <|endoftext|> " * 900]
    enc = tokens.encoder()
    want = {}
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(tokens.library_ids_of(enc, text)) == ids
        want[i] = np.array([*ids, 0], "<u4")
    out = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 2048).toPandas()
    assert out["doc_id"].nunique() == len(texts) and out.groupby("doc_id")["length"].sum().to_dict() == {i: len(w) for i, w in want.items()}
    for r in out.itertuples():
        assert zlib.crc32(want[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_neighbours(spark, sf):
    table = pd.read_parquet(f"{sf}/embeddings.parquet")
    x = np.stack(table["embedding"]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    ids = table["vec_id"].to_numpy()
    found = Q.op2_nearest_neighbours(spark, sf).toPandas()
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        own = found[found["query_id"] == ids[i]].sort_values("rank")
        best = sorted(range(len(ids)), key=lambda j: (-sims[i, j], ids[j]))[:5]
        assert list(own["rank"]) == [1, 2, 3, 4, 5]
        assert np.allclose(own["score"], [sims[i, np.flatnonzero(ids == v)[0]] for v in own["vec_id"]])
        hits, total = hits + len({*own["vec_id"]} & {*ids[best]}), total + 5
    assert hits / total >= 0.9


@pytest.mark.parametrize("noise", [0.02, 0.002])
def test_neighbours_among_near_copies(spark, noise):
    """A third of all rows are near copies of one vector, at cosines of about 0.98 and 0.9998 to each other."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4500, 64))
    x[::3] = rng.standard_normal(64) + rng.standard_normal((1500, 64)) * noise * 8
    x = x.astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    found = neighbours.search(table, table.filter("vec_id % 51 = 0")).toPandas()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for i in range(0, len(x), 51):
        sims = unit @ unit[i]
        sims[i] = -9
        best = np.lexsort((np.arange(len(x)), -sims))[:5]
        hits, total = hits + len({*found.loc[found["query_id"] == i, "vec_id"]} & {*best}), total + 5
    print("recall", noise, hits / total)
    assert hits / total >= 0.9


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    d = [int(c) for c in reversed(digits)]
    return sum(d[::2] + [x * 2 - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def _valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def test_personal_data(spark, sf, docs):
    found = {r["doc_id"]: r for r in Q.op3_pii(spark, sf).collect()}
    assert len(found) == len(docs)
    for doc, text in zip(docs["doc_id"], docs["text"]):
        spans = [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if _valid(k, m[0])]
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        row = found[doc]
        assert row["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert {*said.split(",")} <= {*row["spans"].split(","), ""}
        assert [row[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in spans) for k in BASE]


def test_toxicity_of_held_out_rows(spark):
    big = "/root/testdata/sf0.1"
    out = Q.op4_toxicity(spark, big).toPandas()
    labels = pd.read_parquet(f"{big}/labels.parquet")
    assert out["held_out"].tolist() == [zlib.crc32(str(d).encode()) % 5 == 0 for d in out["doc_id"]]
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.5) == (out["predicted"] == 1)).all()
    seen = out[out["held_out"]].merge(labels, on="doc_id")
    toxic, ordinary = seen[seen["toxic"] == 1], seen[seen["toxic"] == 0]
    ranks = seen["score"].rank()
    auc = (ranks[seen["toxic"] == 1].sum() - len(toxic) * (len(toxic) + 1) / 2) / (len(toxic) * len(ordinary))
    assert auc > 0.9 and (ordinary["predicted"] == 1).mean() < 0.03 and (toxic["predicted"] == 1).mean() > 0.7


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def components(ids, texts, k, num, den):
    sets = [shingles(t, k) for t in texts]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = defaultdict(int)
        for g in s:
            for j in holders[g]:
                shared[j] += 1
            holders[g].append(i)
        for j, n in shared.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return {d: (len(sets[i]), least[root(i)]) for i, d in enumerate(ids)}


def test_jaccard_join(spark):
    more = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{more}/documents.parquet")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in Q.op5_jaccard_join(spark, more).collect()}
    assert found == components(docs["doc_id"], docs["text"], 4, 85, 100)


def test_jaccard_join_of_a_dense_family(spark, monkeypatch):
    """Near copies on either side of the threshold, in lists of several blocks, compared in groups of sides."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        words = [f"w{j}" for j in range(200)]
        for j in rng.choice(200, int(rng.integers(0, 9)), replace=False):
            words[j] = f"x{rng.integers(0, 60)}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"u{i}_{j}" for j in range(50))) for i in range(20)]
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    monkeypatch.setattr(jaccard, "SIDE", 16)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    found = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()
    want = components([i for i, _ in rows], [t for _, t in rows], 4, 85, 100)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want


def test_token_counts(spark, sf, docs, tokenizer):
    found = {r["doc_id"]: r["n_tokens"] for r in Q.op7_token_counts(spark, sf).collect()}
    assert found == {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in zip(docs["doc_id"], docs["text"])}


def test_suffix_dedup(spark, sf, docs):
    starts = defaultdict(list)
    data = {d: (t or "").encode() for d, t in zip(docs["doc_id"], docs["text"])}
    for d, b in data.items():
        for i in range(len(b) - 399):
            starts[hash(b[i : i + 400])].append((d, i))
    gone = {d: np.zeros(len(b), bool) for d, b in data.items()}
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + 400] = True
    for r in Q.op8_suffix_dedup(spark, sf).collect():
        g = gone[r["doc_id"]]
        kept = np.frombuffer(data[r["doc_id"]], np.uint8)[~g].tobytes()
        assert (r["n_bytes"], r["n_removed"]) == (len(g), g.sum())
        assert r["n_spans"] == np.count_nonzero(np.diff(np.concatenate(([0], g.astype(int)))) == 1)
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def _told(text):
    """(context, character) of each distinct word of a text, as strings."""
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    for before, word in {(b[-3:], w) for b, w in zip(["", *words], words)}:
        line = f"{before} {word} "
        for i in range(len(before) + 1, len(line)):
            p = i - len(before) - 1
            yield line[0 if p < 2 else max(len(before), i - 6) : i], line[i]


def test_toxicity_against_plain_kneser_ney(spark):
    rng = np.random.default_rng(1)
    words = ["calm", "river", "blue", "stone", "walk", "évening", "thé", "walking"]
    rows = [(" ".join(rng.choice(words, 9)) + (f" vile{rng.choice(list('abcdef'))}x" if i % 2 else ""), i % 2) for i in range(60)]
    others = [" ".join(rng.choice([*words, "other", "vines"], 12)) for _ in range(40)] + [None, "", "12 !"]
    docs = spark.createDataFrame([(t,) for t, _ in rows] + [(t,) for t in others], "text string")
    tables = toxicity.ratios(spark.createDataFrame(rows, "text string, toxic int"), toxicity.shared_events(docs))

    def discount(counts):
        one, two = (sum(c == k for c in counts) for k in (1, 2))
        return min(max(one / (one + 2 * two), 0.1), 0.95) if one else 0.5

    every = {(h[i:], x) for t in [t for t, _ in rows] + others for h, x in _told(t) for i in range(len(h) + 1)}
    follows = defaultdict(int)
    for h, x in every:
        if h:
            follows[h[1:], x] += 1
    spare = [discount([c for (h, _), c in follows.items() if len(h) == n]) for n in range(6)]

    def low(h, x):
        held = {y: c for (g, y), c in follows.items() if g == h}
        d, rest = spare[len(h)], low(h[1:], x) if h else 1 / 256
        return (max(held.get(x, 0) - d, 0) + d * len(held) * rest) / sum(held.values())

    counts = [defaultdict(int), defaultdict(int)]
    for text, toxic in dict.fromkeys(rows):
        for e in _told(text):
            counts[toxic][e] += 1

    def weighed(c, h, x):
        held = {y: n for (g, y), n in counts[c].items() if g == h}
        if not held:
            return low(h[1:], x)
        d, total = discount(list(counts[c].values())), sum(held.values())
        return (max(held.get(x, 0) - d, 0) + d * len(held) * low(h[1:], x)) / total

    def packed(line):
        return len(line) << 56 | int.from_bytes(line.encode("latin-1"), "big")

    found = dict(zip(tables[0].tolist(), tables[1].tolist()))
    known = {*counts[0], *counts[1]}
    assert found.keys() == {packed(h + x) for h, x in known}
    for h, x in known:
        assert abs(found[packed(h + x)] - np.log(weighed(1, h, x) / weighed(0, h, x))) < 1e-9
    model = toxicity.Model(tables)
    texts = ["vilezx calm", "calm river", "never seen before", "Walk, walk; VILEAX", "", None]
    for text, got in zip(texts, toxicity.strengths(tables, texts)):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        seen = {(b[-3:], w) for b, w in zip(["", *words], words)}
        ratio = [sum(np.log(weighed(1, h, x) / weighed(0, h, x)) if (h, x) in known else _rest(tables, packed(h)) for h, x in _events(b, w)) for b, w in seen]
        want = sum(np.log1p(0.01 * np.expm1(r)) for r in ratio) / np.sqrt(max(len(seen), 1))
        assert abs(got - want) < 1e-9 and abs(model.strength(text) - got) < 1e-12


def _events(before, word):
    line = f"{before} {word} "
    for i in range(len(before) + 1, len(line)):
        p = i - len(before) - 1
        yield line[0 if p < 2 else max(len(before), i - 6) : i], line[i]


def _rest(tables, context):
    """The ratio of a character that neither class has in a context: what is shared cancels."""
    return dict(zip(tables[2].tolist(), tables[3].tolist())).get(context, 0.0)


def test_toxicity_without_labels_of_both_classes(spark):
    docs = spark.createDataFrame([(i, f"some text {i}") for i in range(20)] + [(None, None)], "doc_id long, text string")
    for labels in ([], [(i, 1, 1) for i in range(20)], [(i, 1, 0) for i in range(20)]):
        model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        assert {r["predicted"] for r in toxicity.score(docs, model).collect()} == {0}
        assert toxicity.reject(docs, model).count() == 21
