"""Spelling variants, URL filters and conversation repair against plain computations."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairn.llm import conversations, queries as Q, spelling, urls


def damaged_counts(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def variants(counts):
    """word -> (form, root, n, n_near, form_n), by masks of one place."""
    masks = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            masks[w[:i], None, w[i + 1 :]].add(w)
            masks["gone", w[:i] + w[i + 1 :]].add(w)
        masks["gone", w].add(w)
    near = defaultdict(set)
    for key, own in masks.items():
        if key[0] == "gone":  # of words of one result the longer ones reach the shorter
            pairs = ((a, b) for a in own if len(a) == len(key[1]) for b in own if len(b) == len(a) + 1)
        else:
            pairs = itertools.combinations(own, 2)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 10 * n else None

    def root(w):
        return root(form[w]) if form[w] else w

    return {w: (form[w], root(w), n, len(near[w]), counts.get(form[w])) for w, n in counts.items()}


def told(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_spelling(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    want = variants(damaged_counts(zip(docs["doc_id"], docs["text"])))
    got = told(Q.op11_spelling(spark, sf))
    assert got == want
    assert any(form for form, *_ in want.values())


def test_spelling_in_parts_and_chains(spark):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abcdeéß") for _ in range(rng.randint(7, 9))): rng.randint(2, 400) for _ in range(3000)}
    counts |= {"chainword": 40000, "chainworx": 3000, "chainwoxx": 200, "chainxoxx": 10, "hainxoxx": 1, "aaaaaaaa": 50, "aaaaaaa": 5, "aaaaaaaaa": 5000}
    long = "ab" * 30_000
    counts |= {long: 50, long[1:]: 5, long[:500] + "c" + long[501:]: 4}
    vocab = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = told(spelling.variants(vocab, part_blocks=50))
    small = {w: n for w, n in counts.items() if len(w) < 100}
    assert {w: v for w, v in got.items() if len(w) < 100} == variants(small)
    assert got["hainxoxx"][:2] == ("chainxoxx", "chainword") and got["aaaaaaa"][:2] == ("aaaaaaaa", "aaaaaaaaa")
    assert got[long] == (None, long, 50, 2, None) and got[long[1:]] == (long, long, 5, 1, 50)


def test_words_of_odd_texts(spark):
    rows = [(1, None), (2, ""), (None, "Wordword WORDWORD"), (3, "÷×÷×÷×÷×éÀ " * 3), (3, "÷×÷×÷×÷×éÀ"), (4, "abcdefg-abcdefg abcdefgh1abcdefgh")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "run", "n", "h", "length", "hash")})
    assert told(spelling.variants(spelling.vocabulary(spelling.damaged_words(docs)))) == variants(damaged_counts(rows))
    assert told(spelling.variants(spelling.vocabulary(spelling.damaged_words(docs.limit(0))))) == {}


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def judged(pages, labels, support=urls.SUPPORT, confidence=urls.CONFIDENCE):
    said = defaultdict(list)
    for doc, quality, toxic in labels:
        if doc is not None and not (quality is None and toxic is None):
            said[doc].append(toxic == 1 or quality == 0)

    def cut(url):
        _, mark, rest = (url or "").partition("://")
        host = re.match("[^/?#]*", rest)[0] if mark else ""
        return lower(host), re.match("[^?#]*", rest[len(host) :])[0] if mark else ""

    def tokens(host, path):
        plain = re.sub("[0-9]+", "0", lower(path))
        return {f"h:{x}" for x in host.split(".") if x} | {f"p:{x}" for x in plain.split("/") if x} | {f"w:{x}" for x in re.split("[^a-z0-9\u0080-\U0010ffff]+", f"{host}/{plain}") if x}

    rows = [(tokens(*cut(url)), any(said[page])) for page, url in pages if page in said]
    n, b = Counter(t for ts, _ in rows for t in ts), Counter(t for ts, blocked in rows if blocked for t in ts)
    share = sum(blocked for _, blocked in rows) / len(rows) if rows else 0
    rank = {t: (-abs(b[t] - n[t] * share) / n[t] ** 0.5, t) for t in n if b[t] >= support}
    sets, held = Counter(), Counter()
    for ts, blocked in rows:
        chosen = sorted(sorted((t for t in ts if t in rank), key=rank.get)[: urls.ITEMS])
        for k in range(1, len(chosen) + 1):
            for s in itertools.combinations(chosen, k):
                sets[frozenset(s)] += 1
                held[frozenset(s)] += blocked
    mined = {s: held[s] / sets[s] for s in sets if held[s] >= support and held[s] / sets[s] >= confidence}
    mined = {s: c for s, c in mined.items() if not any(o < s for o in mined)}
    out = []
    for page, url in pages:
        host, path = cut(url)
        fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith(f".{h}")) and path.startswith(p)]
        rule, verdict = max(fits)[1:] if fits else (None, None)
        best = max((c for s, c in mined.items() if s <= tokens(host, path)), default=None) if not fits else None
        out.append((page, host, path, rule, verdict or ("block" if best else "allow"), best))
    return mined, sorted(out, key=repr)


def verdicts(df):
    return sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict", "confidence")) for r in df.collect()), key=repr)


def test_urls(spark, sf):
    pages, labels = pd.read_parquet(f"{sf}/pages.parquet"), pd.read_parquet(f"{sf}/labels.parquet")
    _, want = judged(list(zip(pages["page_id"], pages["url"])), labels[["doc_id", "quality", "toxic"]].itertuples(index=False))
    assert verdicts(Q.op12_url_filters(spark, sf)) == want


@pytest.mark.parametrize("broadcast", [True, False])
def test_mined_urls(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(urls, "BROADCAST_BYTES", 0)
    rng = random.Random(1)
    pages, labels = [], []
    for k in range(600):
        host = rng.choice(["a.org", "free-bets.org", "casino.b.org", "c.d.net", "WWW.example.com"])
        url = f"https://{host}/{rng.choice(['en', 'win', 'de', 'fr', 'it'])}/{rng.choice(['cheap', 'news', 'x-pills', 'one', 'two'])}/{k}"
        pages.append((k, url))
        bad = ("bets" in url and "win" in url) or "pills" in url or rng.random() < 0.1
        if k % 2:
            labels.append((k, int(not bad), 0))
    pages += [(7, "https://a.org/win/bets-free"), (None, "http://free-bets.org/win/x"), (1000, None), (1001, "no address"), (1002, "://"), (1003, "x://é.ÀB.Net/es/?q#f"), (1004, "http://net/es/"), (1005, "http://example.com"), (1006, "http://example.com/en/a/" + "long/" * 20000), (1007, "a://b://c/d"), (1008, "A://COM/x\ny?z"), (1009, "x" * 100000 + "://q.net/fr/")]
    labels += [(3, None, None), (3, None, 1), (None, 0, 1), (5, 0, 0), (5, 1, 1)]
    mined, want = judged(pages, labels)
    assert len(mined) > 3 and any(len(s) > 1 for s in mined)
    frame = spark.createDataFrame(pages, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "token", "tokens", "row", "rule", "blocked", "met")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("page_id", F.lit("x"))
    assert verdicts(urls.judge(frame, said)) == want
    assert verdicts(urls.judge(frame.limit(0), said)) == []
    assert {v for *_, v, _ in verdicts(urls.judge(frame.filter("rule = 'x'"), said.limit(0)))} == {"allow", "block"}


def test_urls_mined_by_all_tokens(spark, monkeypatch):
    """With all tokens, rules beyond the eight most telling are found, and counts are those of all labelled pages."""
    rng = random.Random(2)
    pages, labels = [], []
    for k in range(300):
        url = f"https://{rng.choice(['a.org', 'free-bets.org', 'casino.b.org'])}/{rng.choice(['en', 'win', 'de'])}/{rng.choice(['cheap', 'news', 'x-pills'])}/{rng.choice(['one', 'two'])}/{k}"
        pages.append((k, url))
        labels.append((k, int(not (("bets" in url and "win" in url and "two" in url) or rng.random() < 0.3)), 0))
    made = lambda: (spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    eight = verdicts(urls.judge(*made()))
    assert eight == judged(pages, labels)[1]
    monkeypatch.setattr(urls, "ITEMS", None)
    mined, want = judged(pages, labels)
    assert verdicts(urls.judge(*made(), items=None)) == want != eight
    assert any(len(s) > 1 for s in mined)


def test_long_urls_mined_by_all_tokens(spark):
    """Tokens that stand in the same pages are mined as one, of which any makes a rule fit: sets among 120 tokens would be 2**120."""
    long = "/".join(f"{a}{b}" for a in "abcdef" for b in "abcdefghij")
    urls_of = [f"https://long.org/{long}/zz"] * 12 + [f"https://long.org/{long}"] * 20 + ["https://long.org/zz"] * 30
    pages = list(enumerate([*urls_of, "https://q.org/ba/zz", "https://q.org/x/zz", "https://q.org/ba/ff", "https://q.org/fj-zz"]))
    made = spark.createDataFrame(pages, "page_id long, url string")
    labels = spark.createDataFrame([(k, int(k >= 12), 0) for k in range(len(urls_of))], "doc_id long, quality int, toxic int")
    told = {r["page_id"]: (r["verdict"], r["confidence"]) for r in urls.judge(made, labels, items=None).collect()}
    assert [told[k] for k in (0, 12, 32, 62, 63, 64, 65)] == [("block", 1.0), ("allow", None), ("allow", None), ("block", 1.0), ("allow", None), ("allow", None), ("block", 1.0)]
    assert urls.judge(made, labels).filter("verdict = 'block'").count() == 0  # the eight that tell most are of the long path


def repaired(rows):
    """Of one conversation's rows in order (turn, role, text): all that the contract asks, by plain recursion over suffixes."""
    kinds, seen = [], set()
    for _, role, text in rows:
        trimmed = text.strip(" \t\n\v\f\r")
        kinds.append("blank" if not trimmed else "duplicate" if (role, text) in seen else "truncated" if trimmed[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == len(rows) and state in "0a" else []

        def take(cost, edit, line, rest):
            if rest is not None:
                found.append((cost + rest[0], edit + rest[1], (*line, *rest[2])))

        for r, role in (("u", "user"), ("a", "assistant")):
            to = step.get((state, r))
            if to and inserts < 2:
                take(2, "I", [f"{role}:"], best(i, to, inserts + 1))
            if to and i < len(rows) and kinds[i] not in ("blank", "duplicate"):
                take(2 + (kinds[i] == "truncated"), "R", [f"{role}:{rows[i][2]}"], best(i + 1, to, 0))
        if i < len(rows):
            take(3, "D", [], best(i + 1, state, 0))
            to = step.get((state, rows[i][1][:1]))
            if to and kinds[i] not in ("blank", "duplicate"):
                take(int(kinds[i] == "truncated"), "K", [f"{rows[i][1]}:{rows[i][2]}"], best(i + 1, to, 0))
        return min(found, default=None)

    cost, audit, lines = best(0, "0", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [role[:1] for _, role, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def all_repaired(rows, damage=True):
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        own = by_conv[conv]
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if d == 4:
            role = "user"
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        own += [(turn, role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return {conv: repaired(sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, own in by_conv.items()}


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def summary(df):
    return {r["conv_id"]: tuple(r[c] for c in NAMES) for r in df.collect()}


def test_conversations(spark, sf):
    rows = pd.read_parquet(f"{sf}/conversations.parquet")[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)
    got = summary(Q.op13_conversation_repair(spark, sf))
    assert got == all_repaired(rows)


@pytest.mark.parametrize("block", [2, 12])
def test_odd_conversations(spark, block):
    rng = random.Random(block)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            text = rng.choice(["Yes.", "No", "", " \n", "Well!  ", "So? x", "Yes.", "a" * 3, None])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), text))
    for turn in range(300):  # one conversation over many blocks
        rows.append((500, turn, rng.choice(["user", "assistant", "system"]), rng.choice([f"Say {turn}.", f"Say {turn}", "Again.", ""])))
    rows += [(501, 5, "user", "Same.")] * 50
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("at", "block", "n", "cost", "audit", "edit", "conv", "row")})
    for hurt in (conversations.damaged, lambda r: r):
        turns, plans, made = conversations.repair(hurt(frame), block)
        got = summary(conversations.digest(frame, turns, plans, made))
        assert got == all_repaired(rows, hurt is conversations.damaged)
    assert {"D", "I", "K", "R"} == {r["edit"] for r in made.select("edit").distinct().collect()}
    empty = frame.limit(0)
    assert summary(conversations.digest(empty, *conversations.repair(conversations.damaged(empty)))) == {}


def test_a_conversation_that_loses_all_rows(spark):
    lost = next((c, t) for c in range(1000) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    frame = spark.createDataFrame([(*lost, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = summary(conversations.digest(frame, *conversations.repair(conversations.damaged(frame))))
    assert got == {lost[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
