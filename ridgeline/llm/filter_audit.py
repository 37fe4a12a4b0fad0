"""What each filter of a chain removes in every order, by the subset-zeta transform.

Method: each document's failed filters are a mask. Documents are counted by part and mask; the zeta transform over subsets turns
the 2**k counts of a part into the survivors of every subset of the k filters (k passes over an array). A step of an order is then the
difference of two neighbouring subsets, for documents as for labelled ones, and a filter's Shapley sum
weighs its differences by the orders that pass through them. Only DataFrame functions.

A filter is a Boolean column (null: passed). duplicate_of_smaller() marks equal values without gathering
a group of copies: rows are counted before they meet, then by value and kind.

Defined results: null and empty texts are equal to each other; a null part is the empty string; a null id is smaller than none
and has no smaller one, and no label; rows that share an id count each, and of copies that share the smallest id none fails; an id with
several labels has those that any of its rows gives. Very long texts are used whole. Empty tables give no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col
#: Rows without an id are dealt over so many groups in the join with the labels.
_SPREAD = 4_096


def text_filters(text: Column) -> dict[str, Column]:
    """Filters of a text by letter; True where it fails. Words are maximal runs of other than white space."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))
    upper = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * upper.cast("long") > 10 * F.length(text).cast("long"),
        "D": F.length(F.translate(text, "#$%&*|", "")) < F.length(text),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Mapping[str, Column], duplicate: str | None = None, part: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of failed filters; bit i stands for the i-th filter, the last for `duplicate`.

    duplicate: the letter of a further filter, failed where a row of a smaller id has the same text.
    """
    bits = [F.when(F.coalesce(f, F.lit(False)), 1 << i).otherwise(0) for i, f in enumerate(filters.values())]
    mask = sum(bits[1:], bits[0]) if bits else F.lit(0)
    part = F.coalesce(part if part is not None else C("lang"), F.lit(""))
    digest = F.sha2(F.coalesce(C(text_col), F.lit("")), 256) if duplicate else F.lit("")
    seen = docs.select(C(id_col).alias("id"), part.alias("part"), mask.cast("int").alias("mask"), digest.alias("same"))
    # rows without an id have no partner in the join; the second key keeps them from meeting in one task
    apart = F.when(C("id").isNull(), F.pmod(F.xxhash64("same", "part"), F.lit(_SPREAD)).cast("int")).otherwise(0)
    counted = seen.groupBy("id", "part", "mask", "same").agg(F.count("*").alias("n")).withColumn("apart", apart)
    known = labels.where(C("doc_id").isNotNull()).groupBy(C("doc_id").alias("id")).agg(F.max((C("quality") == 1).cast("int")).alias("good"), F.max((C("toxic") == 1).cast("int")).alias("toxic"))
    kinds = counted.join(known.withColumn("apart", F.lit(0)), ["id", "apart"], "left").withColumns({c: F.coalesce(C(c), F.lit(0)) for c in ("good", "toxic")})
    kind = ["part", "mask", "good", "toxic"]
    if duplicate:
        least = F.min("id").over(Window.partitionBy("same"))
        groups = kinds.groupBy("same", *kind).agg(F.min("id").alias("id"), F.sum("n").alias("n"), F.sum(F.when(C("id").isNotNull(), C("n")).otherwise(0)).alias("with_id"), F.coalesce(F.min_by("n", "id"), F.lit(0)).alias("at_id"))
        groups = groups.withColumn("failed", C("with_id") - F.when(C("id") == least, C("at_id")).otherwise(0))
        both = F.array(F.struct(C("mask"), (C("n") - C("failed")).alias("n")), F.struct((C("mask") + (1 << len(filters))).alias("mask"), C("failed").alias("n")))
        kinds = groups.select("part", "good", "toxic", F.explode(both).alias("b")).select("part", "good", "toxic", "b.*").where("n > 0")
    return kinds.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(C("n") * C("good")).alias("good"), F.sum(C("n") * C("toxic")).alias("toxic"))


def _summed(counts: str, bit: int, size: int) -> Column:
    """One pass of the zeta transform: to each mask with this bit the value of the mask without it is added."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.get(counts, m) + F.when(m.bitwiseAND(bit) > 0, F.get(counts, m - bit)).otherwise(0))


def _dense(of_mask: str, c: str, size: int) -> Column:
    """The array of a figure by mask, zero where no document has the mask."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at(of_mask, m)[c], F.lit(0).cast("long")))


def survivors(counts: DataFrame, k: int) -> DataFrame:
    """part, kept, kept_good, kept_toxic: arrays that hold for every set of filters (its mask as index) the documents that none of them removes."""
    names = {"n": "kept", "good": "kept_good", "toxic": "kept_toxic"}
    out = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("__at"))  # at most 2**k entries
    out = out.select("part", *(_dense("__at", c, 1 << k).alias(c) for c in names))
    for bit in range(k):  # each pass reads the array of the pass before as a column, so that no pass is repeated within the next
        out = out.select("part", *(_summed(c, 1 << bit, 1 << k).alias(c) for c in names))
    # a document survives a set if its mask lies within the complement: the transformed array read from its end
    return out.select("part", *(F.reverse(c).alias(name) for c, name in names.items()))


def audit(kept: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    kept: as from survivors(), letters: the filters' names in the order of their bits.
    """
    k, full = len(letters), (1 << len(letters)) - 1
    bit = {f: 1 << i for i, f in enumerate(letters)}
    steps = []
    for order in itertools.permutations(letters):
        before = 0
        for i, f in enumerate(order):
            steps.append({"filter_order": "".join(order), "step": i + 1, "own": bit[f], "before": before})
            before |= bit[f]
    shapley = []
    for own in bit.values():  # a set before the filter stands in so many orders: the ways to arrange it and what comes after
        sets = [s for s in range(full + 1) if not s & own]
        shapley.append(" + ".join(f"{math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count())} * (kept[{s}] - kept[{s + own}])" for s in sets))
    rows = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order string, step int, own int, before int>>")  # k * k! rows, by the filters alone
    each = kept.withColumn("__shapley", F.expr(f"array({', '.join(shapley)})")).select("*", F.explode(rows).alias("r")).select("*", "r.*")
    lost = lambda c, before, own: F.get(c, before) - F.get(c, before + own)
    own, before = C("own"), C("before")
    removed = lost("kept", before, own)
    columns = {
        "kept": F.get("kept", before + own), "removed": removed, "redundant": lost("kept", F.lit(0), own) - removed, "unique_fails": lost("kept", F.lit(full) - own, own),
        "good_lost": lost("kept_good", before, own), "toxic_lost": lost("kept_toxic", before, own), "shapley": F.get("__shapley", F.log2(own.cast("double")).cast("int")),
    }
    return each.select("part", "filter_order", "step", *(c.cast("long").alias(n) for n, c in columns.items()))


def audit_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five text filters A-D and E (a copy of a smaller id's text), by language."""
    return audit(survivors(mask_counts(docs, labels, text_filters(C("text")), duplicate="E"), 5), "ABCDE")
