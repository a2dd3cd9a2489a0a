"""Line dedup: an exact set-similarity join of lines on word shingles, in DataFrame operations.

A line's tokens are the hashes of its ``k``-word shingles, in the order of their values; two
lines within the threshold share one of their first (prefix filter). Tokens that stand in
too many prefixes come last in the order: lines that hold one there get another prefix. The
rest of the join follows from that: lines of equal sets are one class; prefixes meet in
a window by token; sizes, places in the order and signatures rule pairs out (length, positional
and bitmap filter); Jaccard is verified on whole sets; of two matching lines the later goes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, row_keyed, written

#: Blanks beside the space and the line feed.
BLANKS = "\t\x0b\x0c\r"
#: Prefixes of classes that a token may stand in before it comes last in the order.
HEAVY = 500
#: Rows that may be broadcast (names of documents or lines), and line numbers in their lists.
BROADCAST_ROWS = 300_000
BROADCAST_NUMBERS = 2_000_000


def _words(line: Column) -> Column:
    """A split by one character needs no pattern, so other blanks become spaces where there are any."""
    odd = line.contains(BLANKS[0]) | line.contains(BLANKS[1]) | line.contains(BLANKS[2]) | line.contains(BLANKS[3])
    plain = F.when(odd, F.translate(line, BLANKS, " " * len(BLANKS))).otherwise(line)
    return F.array_remove(F.split(ascii_lower(plain), " ", -1), "")


def _tokens(words: Column, k: int) -> Column:
    """Distinct hashes of the k-word shingles, in order; a line of fewer words has its whole sequence as one; null without words."""
    # Words are taken one by one: slice() would copy the whole line for each shingle.
    first = F.slice(words, 1, F.size(words) - (k - 1))
    shingles = F.transform(first, lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, k))))
    whole = F.array(F.xxhash64(F.size(words), F.array_join(words, " ")))
    return F.when(F.size(words) >= k, F.sort_array(F.array_distinct(shingles))).when(F.size(words) > 0, whole)


def _lines(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, line_no, tokens) of every line; tokens are null without words.

    No filter stands on computed arrays, here or below, and they are opened by outer
    explodes: Spark would move a filter below the projections and evaluate the arrays
    again for it, inside lambdas even for each element.
    """
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    worded = split.select("doc_id", "line_no", _words(F.col("line")).alias("words"))
    return worded.select("doc_id", "line_no", _tokens(F.col("words"), k).alias("tokens"))


def _entry(token: Column) -> Column:
    """The upper half of a hash, as prefixes keep it: a chance meeting only adds a pair to verify."""
    return F.shiftright(token, 32).cast("int")


def _signature(tokens: Column) -> Column:
    """64 parities of the tokens: two sets differ by at least as many tokens as their signatures by bits."""
    return F.aggregate(tokens, F.lit(0).cast("long"), lambda acc, t: acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.hash(t))))


def _tuple(*names: str) -> Column:
    return F.struct(*names)


def _small(table: DataFrame, numbers: str | None = None) -> DataFrame:
    """A written ``table``, to be broadcast if its rows and the ``numbers`` in its lists are few enough."""
    held = table.agg(F.count("*").alias("rows"), F.sum(F.size(numbers) if numbers else F.lit(0)).alias("numbers")).first()
    return F.broadcast(table) if held["rows"] <= BROADCAST_ROWS and (held["numbers"] or 0) <= BROADCAST_NUMBERS else table


def _sets(docs: DataFrame, asked: DataFrame, k: int, count: int) -> DataFrame:
    """(id, tokens) of the lines ``asked`` (id, doc_id, line_no)."""
    wanted = asked.groupBy("doc_id").agg(F.collect_list(F.struct("id", "line_no")).alias("wanted"))
    wanted = _small(written(wanted, "wanted", count), "wanted")
    # The lines wanted are taken out before they are opened: an explode would copy the whole text for each.
    parts = docs.join(wanted, "doc_id").select("wanted", F.split("text", "\n", -1).alias("all"))
    some = parts.select(F.explode(F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), F.get("all", w["line_no"]).alias("line")))).alias("w"))
    return some.select("w.id", _words(F.col("w.line")).alias("words")).select("id", _tokens(F.col("words"), k).alias("tokens"))


def _posted(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], reach: Callable[[Column], Column]) -> DataFrame:
    """(token, id, pos) of the prefixes of ``classes`` (id, n, prefix, ...); ``sets`` gives the tokens of some classes.

    A token is heavy if it stands in more than HEAVY prefixes, or in more of the sets that hold
    such a one there. Heavy tokens come last, so a prefix without one stays as it is.
    """
    posted = classes.select("id", F.posexplode("prefix").alias("pos", "token")).select("token", "id", "pos")
    heavy = written(posted.groupBy("token").count().filter(F.col("count") > HEAVY).select("token"), "heavy")
    if heavy.isEmpty():
        return posted

    def held(heavy: DataFrame) -> DataFrame:
        """The tokens of the classes that hold a heavy token in their prefix."""
        some = written(posted.join(_small(heavy), "token", "left_semi").select("id").distinct(), "held")
        return written(sets(classes.join(_small(some), "id", "left_semi")), "sets")

    each = held(heavy).select(F.explode(F.transform("tokens", _entry)).alias("token"))
    heavy = heavy.unionByName(each.groupBy("token").count().filter(F.col("count") > HEAVY).select("token")).distinct()
    heavy = written(heavy, "heavy")
    again = held(heavy)
    each = again.select("id", F.explode("tokens").alias("t")).withColumn("token", _entry(F.col("t")))
    last = each.join(_small(heavy).withColumn("heavy", F.lit(1)), "token", "left")
    whole = last.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("heavy", F.lit(0)).alias("heavy"), "t"))).alias("all"))
    fresh = whole.select("id", F.posexplode(F.slice("all", F.lit(1), reach(F.size("all")))).alias("pos", "e")).select(_entry(F.col("e.t")).alias("token"), "id", "pos")
    return posted.join(_small(again.select("id")), "id", "left_anti").select("token", "id", "pos").unionByName(fresh)


def matches(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(doc_id, line_no) of the lines that go: an earlier line has a Jaccard similarity of num/den or more.

    ``docs``: (doc_id, text) with distinct doc_id.
    """
    n = F.size("tokens")
    reach = lambda n: n - F.ceil(n * num / den).cast("int") + 1
    # Lines without tokens are sets of their own.
    own = F.when(F.col("tokens").isNull(), F.xxhash64("doc_id", "line_no")).otherwise(F.xxhash64("tokens"))
    prefix = F.transform(F.slice("tokens", F.lit(1), reach(n)), _entry)
    short = _lines(docs, k).select("doc_id", "line_no", own.alias("set"), n.alias("n"), F.when(F.col("tokens").isNotNull(), prefix).alias("prefix"), _signature(F.col("tokens")).alias("sig"))
    short = written(short, "lines")
    count = short.count()
    # Lines of equal sets are one class, named by its first line.
    classes = short.filter("prefix is not null").groupBy("set").agg(
        F.min(_tuple("doc_id", "line_no")).alias("first"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("sig").alias("sig"), F.count("*").alias("lines")
    )
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes", count)
    sets = lambda some: _sets(docs, some.select("id", "first.*"), k, count)
    # Entries are flat and narrow, size and place in one number: they are most of what is shuffled.
    place = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("size")
    posted = _posted(classes, sets, reach).withColumn("c", F.count("*").over(Window.partitionBy("token"))).filter("c > 1")
    met = posted.join(classes.select("id", "first", "n", "sig"), "id").select("token", "first", place, "sig")
    # Each entry stands beside the first line of its list.
    head = F.min(_tuple("first", "size", "sig")).over(Window.partitionBy("token"))
    met = written(met.withColumn("head", head).select("token", "first", "size", "sig", F.col("head.first").alias("first_"), F.col("head.size").alias("size_"), F.col("head.sig").alias("sig_")), "met")

    def pairs(both: DataFrame) -> DataFrame:
        """(late, early) of entries (first, size, sig and the same of the other), whose sizes, places and signatures leave the threshold in reach."""
        both = both.filter("first_ < first")
        (s, x), (t, y) = ((F.shiftright(c, 32), F.col(c).bitwiseAND(0x7FFFFFFF)) for c in ("size", "size_"))
        both = both.filter(F.least(s, t) * den >= F.greatest(s, t) * num)
        both = both.filter(F.least(s - x, t - y) * (num + den) >= num * (s + t))
        both = both.filter(F.bit_count(F.col("sig").bitwiseXOR(F.col("sig_"))) * (num + den) <= (den - num) * (s + t))
        return both.select(F.col("first").alias("late"), F.col("first_").alias("early")).distinct()

    def matched(found: DataFrame) -> DataFrame:
        found = written(found, "pairs")
        named = written(found.select(F.explode(F.array("late", "early")).alias("id")).distinct(), "paired", count)
        some = written(_sets(docs, named.select("id", "id.*"), k, count), "sets")
        x = some.select(F.col("id").alias("late"), F.col("tokens").alias("x"))
        y = some.select(F.col("id").alias("early"), F.col("tokens").alias("y"))
        shared = F.size(F.array_intersect("x", "y"))
        near = found.join(x, "late").join(y, "early").select("late", shared.alias("shared"), (F.size("x") + F.size("y")).alias("both"))
        return near.filter(F.col("shared") * den >= (F.col("both") - F.col("shared")) * num).select("late").distinct()

    # Most lines that go match the first line of one of their lists; only the others meet all.
    easy = written(matched(pairs(met)), "easy", count)
    rest = met.select("token", "first", "size", "sig").join(_small(easy), met["first"] == easy["late"], "left_anti")
    others = met.select("token", *(F.col(c).alias(f"{c}_") for c in ("first", "size", "sig")))
    hard = matched(pairs(rest.join(others, "token")))
    late = easy.unionByName(hard).distinct()
    # A class goes with its first line, or but for its first line.
    gone = classes.join(_small(written(late, "late", count)), classes["first"] == F.col("late"), "left")
    gone = gone.filter("late is not null or lines > 1").select("set", "first", F.col("late").isNotNull().alias("all_go"))
    each = short.select("doc_id", "line_no", "set").join(gone, "set")
    return each.filter(F.col("all_go") | (_tuple("doc_id", "line_no") > F.col("first"))).select("doc_id", "line_no")


def dedup_lines(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` (doc_id, text, ...) with repeated lines removed, and ``n_lines``, ``n_removed``.

    Lines end at line feeds. A line goes if an earlier one (of a lesser doc_id, or higher in the
    same text) has a Jaccard similarity of at least num/den on distinct k-word shingles,
    whether or not that one goes too. A line of fewer than k words has its whole sequence as its
    one shingle, so it goes if an earlier line has the same words; a line without words stays. What is left is
    joined by line feeds; a text of which every line goes becomes empty, and its row stays.

    Null texts stay null, with 0 lines. Documents without a doc_id, and rows that repeat
    one, keep all their lines and take none from others: they have no place in the order.
    Columns named n_lines or n_removed are replaced. An empty table gives no rows.
    """
    plain = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    lone = plain.join(plain.groupBy("doc_id").count().filter("count > 1"), "doc_id", "left_anti") if _repeats(plain) else plain
    return _without(docs, matches(lone, k, num, den), "doc_id", docs.columns)


def dedup_rows(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """As ``dedup_lines``, but every row takes part, whatever its doc_id.

    Rows that repeat a doc_id are documents of their own, in the order in which they are
    read; rows without one come last.
    """
    keyed, key = row_keyed(docs)
    plain = keyed.filter("text is not null").select(F.col(f"`{key}`").alias("doc_id"), "text")
    return _without(keyed, matches(plain, k, num, den), key, docs.columns)


def _without(docs: DataFrame, lines: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The ``columns`` of ``docs`` without ``lines`` (doc_id, line_no), whose doc_id stands in column ``key``."""
    kept = [c for c in columns if c.lower() not in ("n_lines", "n_removed")]
    # Names that no column of ``docs`` has.
    free = "_".join(["gone", *(c for c in kept if c.lower().startswith("gone"))])
    found = lines.groupBy(F.col("doc_id").alias(f"{free}_id")).agg(F.collect_list("line_no").alias(f"{free}_lines"))
    # Texts are shuffled only if the lines that go are too many to be sent to them.
    found = _small(written(found, "gone"), f"{free}_lines")
    held = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys([*kept, key])))
    joined = held.join(found, F.col(f"`{key}`") == F.col(f"`{free}_id`"), "left")
    gone = F.col(f"`{free}_lines`")
    # Split in a step of its own: inside the lambda below the text would be split once for each line that stays.
    joined = joined.withColumn(f"{free}_all", F.when(gone.isNotNull(), F.split("text", "\n", -1)))
    all_lines = F.col(f"`{free}_all`")
    stay = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), gone)
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(all_lines, i)), "\n"))
    # Counted by their ends: texts that keep all lines are not split again.
    n_lines = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        *(text.alias("text") if c == "text" else F.col(f"`{c}`") for c in kept),
        F.coalesce(n_lines, F.lit(0)).alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).alias("n_removed"),
    )


def _repeats(docs: DataFrame) -> bool:
    """Whether a doc_id comes twice."""
    return not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()


def digest(cleaned: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept_md5)"""
    return cleaned.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))
