"""Token ids of texts inside tasks, and token counts of flat token files.

A flat token file is a stream of little-endian ids in which an end-of-document id
follows each document and nothing else marks where documents lie. It is read in
blocks of fixed size; a block's separators are found in one vectorised comparison,
and a prefix scan over the blocks' summaries stitches documents that span blocks.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import tokenizer_file, written

#: Fixed value: the vocabulary's published rule for cutting a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: The ranks of byte_bpe_50k.json: the same ids as the ``tokenizers`` library finds with that
#: file (the tests compare them), in a third of its time.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The file that names the vocabulary's added tokens, which the ranks lack.
ADDED = "byte_bpe_50k.json"
#: The end-of-document id of that vocabulary. ``ids_of`` never yields it, so that it marks ends in flat token files.
END = 50256
#: White space of that length is encoded by itself; the pattern's stack ends between 600,000 and 1,000,000 characters.
LONG_RUN = 100_000
#: Unicode's White_Space, which the pattern means by \\s.
RUNS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
_ENCODERS: dict = {}


def encoder(folder: str | None = None, name: str = VOCABULARY):
    """The worker's encoder; it outlives a task."""
    path = tokenizer_file(folder, name)
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=_added(folder))
    return _ENCODERS[path]


def _added(folder: str | None) -> dict[str, int]:
    """The added tokens of the vocabulary, which are found in texts as they stand."""
    with open(tokenizer_file(folder, ADDED), encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(a["single_word"] or a["lstrip"] or a["rstrip"] or a["normalized"] for a in added):
        raise ValueError("an added token that takes more or less than its own text")
    return {a["content"]: a["id"] for a in added}


def ids_of(enc, text: str | None) -> np.ndarray:
    """A text's ids; a null text has none. The name of an added token is ordinary text."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) < LONG_RUN:
        return np.array(enc.encode_ordinary(text), "<u4")
    return _ids_by_runs(enc, text)


def library_ids_of(enc, text: str | None) -> np.ndarray:
    """A text's ids as the ``tokenizers`` library gives them: added tokens in a text are one id each."""
    if not text:
        return np.empty(0, "<u4")
    if len(text) < LONG_RUN:
        return np.array(enc.encode(text, allowed_special="all", disallowed_special=()), "<u4")
    parts = re.split("(" + "|".join(map(re.escape, sorted(enc.special_tokens_set))) + ")", text)
    ids = [np.array([enc.encode_single_token(x)], "<u4") if k % 2 else _ids_by_runs(enc, x) for k, x in enumerate(parts)]
    return np.concatenate(ids)


def _ids_by_runs(enc, text: str) -> np.ndarray:
    """As ``ids_of``, but long runs of white space go round the pattern, whose stack they overflow.

    The pattern takes such a run as one word, at the end of a text whole, elsewhere up to its
    last character, which begins the next word; what stands before and after is cut as if it stood alone.
    """
    ids, at = [], 0
    for run in RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids.append(np.array(enc.encode_ordinary(text[at : run.start()]), "<u4"))
        ids.append(np.array(enc._encode_single_piece(text[run.start() : end]), "<u4"))
        at = end
    ids.append(np.array(enc.encode_ordinary(text[at:]), "<u4"))
    return np.concatenate(ids)


def token_files(docs: DataFrame, block_tokens: int = 1 << 16, folder: str | None = None) -> DataFrame:
    """``docs`` as flat token files: rows (file, block, data), and beside them rows (file, first, doc_ids).

    Each partition of ``docs`` is one file, the ids of its documents in order, 16 bits
    each, ``END`` after every document; a block holds ``block_tokens`` ids, the last
    maybe fewer. Null texts are empty documents. Nothing in the blocks tells where
    documents lie or what they are called: the rows without a block name them,
    ``doc_ids`` being the file's documents from its ``first`` on.
    """

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, file, block, seen, rest = encoder(folder), TaskContext.get().partitionId(), 0, 0, np.empty(0, "<u2")

        def row(data=None, doc_ids=None) -> dict:
            return {"file": file, "block": block if doc_ids is None else None, "data": data, "first": seen, "doc_ids": doc_ids}

        for batch in batches:
            for at in range(0, len(batch), 256):
                some, parts, rows = batch.iloc[at : at + 256], [rest], []
                for text in some["text"]:
                    parts += [ids_of(enc, text).astype("<u2"), np.array([END], "<u2")]
                rest = np.concatenate(parts)
                while len(rest) >= block_tokens:
                    rows.append(row(rest[:block_tokens].tobytes()))
                    rest, block = rest[block_tokens:], block + 1
                rows.append(row(doc_ids=[None if pd.isna(d) else int(d) for d in some["doc_id"]]))
                seen += len(some)
                yield pd.DataFrame(rows).astype({"block": "Int64"})
        if len(rest):
            yield pd.DataFrame([row(rest.tobytes())]).astype({"block": "Int64"})

    return docs.select("doc_id", "text").mapInPandas(encode, "file int, block long, data binary, first long, doc_ids array<long>")


def scan(blocks: DataFrame, end: int = END, width: int = 2) -> DataFrame:
    """Rows (file, document, start, n_tokens) for the documents of flat token files.

    ``blocks``: (file, block, data), blocks of a file numbered from 0 in order, every
    one but the last of the same size. ``document`` counts from 0 in a file, ``start``
    is its first id's place; the separator is not counted. Ids after the last
    separator are a document without an end. Empty blocks hold nothing; null data
    count as empty; an empty table or file has no documents. A row repeated with the same
    file and block counts once.

    The carry into a block (the separators before it, and the place after the last) is
    found in three steps, so that no task holds all blocks of one large file: a summary
    per block, a scan within runs of ``RUN`` blocks, a scan over the runs.
    """
    kind = f"<u{width}"

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file, block, data in zip(batch["file"], batch["block"], batch["data"], strict=True):
                ids = np.frombuffer(data or b"", kind)
                ends = np.flatnonzero(ids == end)
                rows.append((file, block, len(ids), ends.astype("<i4").tobytes(), len(ends), int(ends[-1]) + 1 if len(ends) else -1))
            yield pd.DataFrame(rows, columns=["file", "block", "n", "ends", "n_ends", "after"])

    schema = "file int, block long, n int, ends binary, n_ends int, after int"
    return _stitched(blocks.select("file", "block", "data").mapInPandas(summarise, schema))


#: Blocks in a run of the prefix scan.
RUN = 1024


def _stitched(summaries: DataFrame) -> DataFrame:
    one = written(summaries, "blocks").dropDuplicates(["file", "block"]).withColumn("run", F.floor(F.col("block") / RUN))
    within = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    place = lambda offset: F.when(F.col("after") >= 0, F.col(offset) + F.col("after"))
    local = (
        one.withColumn("at", F.coalesce(F.sum(F.col("n").cast("long")).over(within), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum("n_ends").over(within), F.lit(0)))
        .withColumn("open", F.max(place("at")).over(within))
    )
    runs = local.groupBy("file", "run").agg(
        F.sum(F.col("n").cast("long")).alias("run_n"), F.sum("n_ends").alias("run_ends"), F.max(place("at")).alias("run_after"), F.max("block").alias("run_block")
    )
    before = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        runs.withColumn("run_at", F.coalesce(F.sum("run_n").over(before), F.lit(0)))
        .withColumn("run_seen", F.coalesce(F.sum("run_ends").over(before), F.lit(0)))
        .withColumn("run_open", F.max(F.col("run_at") + F.col("run_after")).over(before))
        .withColumn("last_run", F.max("run").over(Window.partitionBy("file")))
    )
    whole = local.join(runs, ["file", "run"]).select(
        "file",
        "block",
        "n",
        "ends",
        (F.col("run_at") + F.col("at")).alias("at"),
        (F.col("run_seen") + F.col("seen")).alias("seen"),
        F.coalesce(F.col("run_at") + F.col("open"), F.col("run_open"), F.lit(0)).alias("open"),
        ((F.col("run") == F.col("last_run")) & (F.col("block") == F.col("run_block"))).alias("last"),
    )

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                ends = np.frombuffer(r.ends, "<i4").astype(np.int64) + r.at
                starts = np.concatenate(([r.open], ends + 1))
                sizes = ends - starts[:-1]
                if r.last and r.at + r.n > starts[-1]:
                    sizes = np.append(sizes, r.at + r.n - starts[-1])
                k = len(sizes)
                yield pd.DataFrame({"file": r.file, "document": r.seen + np.arange(k), "start": starts[:k], "n_tokens": sizes})

    return whole.mapInPandas(documents, "file int, document long, start long, n_tokens long")


def count(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens): documents are written as flat token files, then counted by their separators.

    Rows that repeat a ``doc_id``, or have none, get a row each. The separator is not
    counted; null and empty texts count 0; other columns are ignored.
    """
    files = written(token_files(docs, folder=folder), "tokens")
    names = files.filter("block is null").select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id"))
    names = names.select("file", (F.col("first") + F.col("k")).alias("document"), "doc_id")
    return names.join(scan(files.filter("block is not null")), ["file", "document"]).select("doc_id", "n_tokens")
