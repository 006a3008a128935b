"""Audit of how quality filters interact, by the Hart-Mas-Colell potential of their removal game.

The filters are the players; a coalition is worth the documents that it removes. One pass over the texts gives each
document the set of filters it fails, and a part of the corpus shrinks to the counts of these sets. From them come the
worths of all coalitions and, by recursion over the coalitions, their potentials: the potential of a coalition is its worth
plus the potentials of the coalitions with one filter less, divided by its size. A filter's Shapley value is the potential
of all filters minus the potential without it; what a step of an order removes is the difference of two coalitions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words are parted by these characters.
_SPACES = " \t\n\x0b\x0c\r"
_GAP = r"[\x20\x09-\x0D]+"

#: A rule tells from ``text`` (never null) and from ``n_words`` and ``n_distinct``, its words, whether a document fails.
RULES: Mapping[str, Column | str] = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": r"100 * char_length(regexp_replace(text, '[^A-Z]+', '')) > 3 * char_length(text)",
    "D": r"text rlike '[#$%&*|]'",
}
#: The filter that a text fails if a smaller id has the same one.
COPIES = "E"


def failures(docs: DataFrame, rules: Mapping[str, Column | str] = RULES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``(doc_id, part, digest, mask)`` of every row: bit i of ``mask`` is set if the text fails rule i; ``digest`` is its SHA-256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    trimmed = F.btrim("text", F.lit(_SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _GAP))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", words).withColumns({"n_words": F.size("words").cast("long"), "n_distinct": F.size(F.array_distinct("words")).cast("long")}).drop("words")
    bits = [F.when(F.expr(rule) if isinstance(rule, str) else rule, 1 << i).otherwise(0) for i, rule in enumerate(rules.values())]
    return rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(bits, F.lit(0)).cast("int").alias("mask"))


def _labelled(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """``(digest, mask, part, good, toxic, doc_id, n)``: equal rows as one with their number, with the flags of their id.

    Rows without an id carry a hash in the key of the join, so that they don't meet in one task."""
    lone = F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    rows = failed.groupBy("doc_id", lone.alias("lone"), "digest", "mask", "part").agg(F.count("*").alias("n"))
    flag = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    joined = rows.join(known.withColumn("lone", F.lit(0).cast("long")), ["doc_id", "lone"], "left")
    return joined.select("digest", "mask", "part", "doc_id", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def _with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``(part, mask, good, toxic, n)``, where ``bit`` is set for rows whose text a smaller id has.

    The copies of a text first become one row for each part and flag, which keeps how many of them have the least id;
    only these rows meet by text, so a text with any number of copies is no burden to one task."""
    groups = rows.groupBy("digest", "mask", "part", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_nameless")
    )
    first = F.col("least") == F.min("least").over(Window.partitionBy("digest"))
    groups = groups.withColumn("fit", F.col("n_nameless") + F.when(first, F.col("n_least")).otherwise(0))
    cases = F.array(F.struct(F.col("mask").alias("mask"), F.col("fit").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("fit")).alias("n")))
    return groups.select("part", "good", "toxic", F.explode(cases).alias("case")).select("part", "good", "toxic", "case.*").where("n > 0")


def coalition_worths(counts: DataFrame, n_filters: int) -> DataFrame:
    """``(part, n, all, good, toxic)`` of ``counts(part, mask, good, toxic, n)``: arrays over the 2^n coalitions (a coalition
    is the sum of its filters' bits) of the documents, the good and the toxic ones that each removes."""
    sets = counts.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))
    of = sets.groupBy("part").agg(F.sum("n").alias("n"), F.collect_list(F.struct("mask", F.col("n").alias("all"), "good", "toxic")).alias("sets"))  # 2^n rows at most
    every = F.sequence(F.lit(0), F.lit((1 << n_filters) - 1))

    def worth(c: str) -> Column:
        hit = lambda s: F.aggregate("sets", F.lit(0).cast("long"), lambda sum, x: sum + F.when(x["mask"].bitwiseAND(s) != 0, x[c]).otherwise(0))
        return F.transform(every, hit).alias(c)

    return of.select("part", "n", *map(worth, ("all", "good", "toxic")))


def potentials(worth: Column, n_filters: int) -> Column:
    """Hart-Mas-Colell potentials of all coalitions, n! times, which makes them whole numbers: each coalition's follows from
    those with one filter less, which have smaller numbers."""
    scale = math.factorial(n_filters)

    def extended(known: Column, s: Column) -> Column:
        less = [F.when(s.bitwiseAND(1 << i) != 0, F.get(known, s - (1 << i))).otherwise(0) for i in range(n_filters)]
        total = sum(less, F.get(worth, s) * scale)
        return F.concat(known, F.array(F.call_function("div", total, F.bit_count(s))))

    return F.aggregate(F.sequence(F.lit(1), F.lit((1 << n_filters) - 1)), F.array(F.lit(0).cast("long")), extended)


def _steps(names: str) -> Column:
    """All orders of the filters and their steps as a constant array."""
    rows = []
    for order in permutations(names):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << names.index(name)
            rows.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before, "after": before | bit})
            before |= bit
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,bit:int,before:int,after:int>>")


def audit_filters(docs: DataFrame, labels: DataFrame, rules: Mapping[str, Column | str] = RULES, copies: str = COPIES, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What each filter does at each step of every order, for each value of ``part_col``: ``(part, filter_order, step, kept,
    removed, redundant, unique_fails, good_lost, toxic_lost, shapley)``.

    The filters are ``rules`` and, last, ``copies``; names have one letter, so that an order is a word. ``shapley`` is the
    Shapley value times the number of orders. A null text counts as empty and equals an empty one; a null part is the part
    ''. Rows without an id never are later copies and make none; repeated rows with one id count each, and none of them is
    a later copy of the other. An id with several rows in ``labels`` (``doc_id, quality, toxic``) is good or toxic if one of
    them says so. Extra columns are ignored; an empty table has no parts, so no rows.

    Texts are read once and not shuffled: their digests and sets of failed filters are.
    """
    names = "".join([*rules, copies])
    if len(set(names)) != len(rules) + 1 or len(names) > 6:
        raise ValueError("filters need different names of one letter, and there can be six at most (720 orders)")
    n, full = len(names), (1 << len(names)) - 1
    counts = _with_copies(_labelled(failures(docs, rules, id_col, text_col, part_col), labels), 1 << len(rules))
    games = coalition_worths(counts, n).withColumn("potential", potentials(F.col("all"), n))
    rows = games.select("*", F.explode(_steps(names)).alias("s")).select("*", "s.*")
    at = lambda c, s: F.get(F.col(c), s)
    bit, before, after = F.col("bit"), F.col("before"), F.col("after")
    gone = lambda c: at(c, after) - at(c, before)
    last = lambda c: at(c, F.lit(full)) - at(c, F.lit(full) - bit)
    return rows.select(
        "part", "filter_order", "step", (F.col("n") - at("all", after)).alias("kept"), gone("all").alias("removed"), (at("all", bit) - gone("all")).alias("redundant"),
        last("all").alias("unique_fails"), gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), last("potential").alias("shapley"),
    )
