"""Personal data: patterns propose spans, checksums confirm them, context adjusts a score.

Everything is a Spark SQL expression over one row, so there is no shuffle and no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pattern starts where its first run of characters starts, or where the last match
#: ended (\\G). That finds the same leftmost matches as the plain pattern, but tries each
#: run once; possessive repeats keep long texts linear and off the stack.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"

_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Characters of context on either side of a span.
REACH = 40
#: Matches whose offsets are added up together: arrays grow by copying, so they grow in blocks.
BLOCK = 256


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn: every second one from the right is doubled, digits of products summed."""
    chars = F.split(F.reverse(digits), "")
    values = F.transform(chars, lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(values, F.lit(0), lambda s, v: s + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1: first four characters moved to the end, letters as 10 to 35."""
    compact = F.regexp_replace(iban, " ", "")
    moved = F.split(F.concat(F.substring(compact, 5, 34), F.substring(compact, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(moved, F.lit(0), step) == 1


def _count_between(low: int, high: int, text: Column) -> Column:
    return F.length(text).between(low, high)


#: kind -> (what a text must hold to be searched, pattern, check of a match, score, context words).
KINDS = {
    "email": ("@", EMAIL, lambda m: F.lit(True), 0.8, "mail|contact|write|send|adres|correo|courriel"),
    "ip": (".", IP, lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"), 0.6, "ip|host|server|address|login|adres"),
    "card": ("", CARD, lambda m: _count_between(16, 19, _digits(m)) & luhn(_digits(m)), 0.7, "card|visa|credit|pay|kart|tarjeta|carte"),
    "phone": ("+", PHONE, lambda m: _count_between(8, 15, _digits(m)), 0.6, "phone|call|tel|mobile|fax|llama|appel"),
    "iban": ("", IBAN, mod97, 0.8, "iban|bank|account|konto|cuenta|compte"),
}


def spans_of(text: Column, kind: str) -> Column:
    """array<struct<kind,start,end,score>> of one kind, in code points, in order of start.

    The pieces between matches and the matches themselves alternate, so their running
    lengths, added up block by block, are the offsets, and the neighbouring pieces are the context.
    """
    needs, pattern, valid, score, words = KINDS[kind]
    gaps = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    span = "struct<kind:string,start:int,end:int,score:double>"
    rows = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(g.alias("gap"), m.alias("hit")))
    after = F.slice(gaps, 2, F.size(found))
    rows = F.zip_with(rows, after, lambda r, g: F.struct(r["gap"].alias("gap"), r["hit"].alias("hit"), g.alias("next")))

    def grow(acc: Column, r: Column) -> Column:
        start = acc["at"] + F.length(r["gap"])
        end = start + F.length(r["hit"])
        near = F.concat(F.right(r["gap"], F.lit(REACH)), F.lit(" "), F.left(r["next"], F.lit(REACH)))
        bonus = F.when(near.rlike(f"(?i){words}"), 0.2).otherwise(0.0)
        one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), F.round(F.lit(score) + bonus, 2).alias("score"))
        spans = F.when(valid(r["hit"]), F.concat(acc["spans"], F.array(one))).otherwise(acc["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    none = F.array().cast(f"array<{span}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def blocks(whole: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(BLOCK))
        return F.transform(firsts, lambda i: F.aggregate(F.slice(whole, i, F.lit(BLOCK)), start, grow))

    def shift(acc: Column, block: Column) -> Column:
        part = F.struct(acc["at"].alias("base"), block["spans"].alias("spans"))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    # The matches are one element of an array, or each block would find them anew.
    each = F.flatten(F.transform(F.array(rows), blocks))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<base:int,spans:array<{span}>>>").alias("parts"))
    parts = F.aggregate(each, begin, shift, lambda acc: acc["parts"])
    moved = lambda p: F.transform(p["spans"], lambda s: F.struct(s["kind"].alias("kind"), (s["start"] + p["base"]).alias("start"), (s["end"] + p["base"]).alias("end"), s["score"].alias("score")))
    swept = F.flatten(F.transform(parts, moved))
    held = text.contains(needs) if needs else text.rlike("[0-9]")
    return F.when(held & text.rlike(pattern), swept).otherwise(none)


def find(docs: DataFrame, text: str = "text", kinds: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """``docs`` with ``spans``: array<struct<kind,start,end,score>>, by kind, then start.

    A null text counts as empty and has no spans. Each row stands alone: repeated rows
    give repeated results, very long texts cost time in proportion to their length, an
    empty table gives no rows, and a column of ``docs`` named spans is replaced.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "spans"]
    return docs.select(*kept, F.concat(*(spans_of(whole, k) for k in kinds)).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every email, card, phone, address and IBAN of ``text`` that holds a valid
    match replaced by its kind in angle brackets, overlapping spans as one."""
    found = find(docs, text)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))

    def step(acc: Column, s: Column) -> Column:
        keep = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.expr("''"), F.substr(whole, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0))), F.when(keep, F.concat(F.lit("<"), s["kind"], F.lit(">"))).otherwise(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), piece.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    clean = F.aggregate(ordered, start, step, lambda acc: F.concat(acc["out"], F.substr(whole, acc["at"] + 1, F.length(whole))))
    return found.withColumn(text, clean)


def digest(found: DataFrame) -> DataFrame:
    """Per document: counts by kind, the spans as text and a digest of the base kinds."""
    base = ("email", "ip", "card", "phone")

    def text_of(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s["kind"] == kind)

    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id",
        *(F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in (*base, "iban")),
        F.sha2(text_of(of_base).cast("binary"), 256).alias("base_sha256"),
        text_of(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
