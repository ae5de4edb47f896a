"""Column helpers for text, with the Unicode semantics of the specification's regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def bare(c: Column) -> Column:
    """Both ends are visible ASCII: there is nothing to strip, and no regular expression is needed to tell."""
    return F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")


def norm(c: Column) -> Column:
    """The key under which texts are the same entity."""
    return F.when(bare(c), F.lower(c)).otherwise(strip(F.lower(c)))


def drop_point_zero(c: Column) -> Column:
    """A year's text: every ".0" is deleted, wherever it stands."""
    return F.replace(c, F.lit(".0"), F.lit(""))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


#: Matches whose places are summed together.
_BLOCK = 64


def find_spans(text: Column, pattern: str) -> Column:
    """array<struct<text, start, end>> of a pattern's matches, in code points. Start i is what stands between and in the matches before:
    blocks of matches are summed first, so that no long array is copied for each match."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.filter(F.arrays_zip(find_all(text, pattern).alias("h"), gaps.alias("g")), lambda x: x["h"].isNotNull())
    empty = F.array().cast("array<struct<text:string,start:int,end:int>>")

    def size(x: Column) -> Column:
        return x["g"] + F.length(x["h"])

    def place(acc: Column, x: Column) -> Column:
        start, end = acc["at"] + x["g"], acc["at"] + size(x)
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(x["h"].alias("text"), start.alias("start"), end.alias("end"))).alias("out"))

    def begin(acc: Column, block: Column) -> Column:
        total = F.aggregate(block, F.lit(0), lambda s, x: s + size(x))
        return F.struct((acc["at"] + total).alias("at"), F.array_append(acc["out"], F.struct(acc["at"].alias("at"), block.alias("block"))).alias("out"))

    def spans(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / _BLOCK).cast("int")), lambda b: F.slice(p, b * _BLOCK + 1, F.lit(_BLOCK)))
        none = F.array().cast("array<struct<at:int,block:array<struct<h:string,g:int>>>>")
        begun = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), begin, lambda acc: acc["out"])
        each = F.transform(begun, lambda b: F.aggregate(b["block"], F.struct(b["at"].alias("at"), empty.alias("out")), place, lambda acc: acc["out"]))
        return F.when(F.size(p) > 0, F.flatten(each)).otherwise(empty)

    # as a lambda's variable the pairs are made once, not for each of their uses
    return F.get(F.transform(F.array(pairs), spans), F.lit(0))


def counted(found: Column) -> Column:
    """array<struct<x, n>>: the different elements of an array (none null) and how often each is there. Sorted, equal ones stand side by side, so
    a long array takes little more for each element than a short one."""

    def ends(s: Column) -> Column:
        return F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: F.coalesce(F.get(s, i) != F.get(s, i - 1), F.lit(True)))

    def runs(s: Column, e: Column) -> Column:
        return F.transform(e, lambda at, k: F.struct(F.get(s, at - 1).alias("x"), (at - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("long").alias("n")))

    # as lambdas' variables the sorted elements and their ends are made once
    each = F.flatten(F.transform(F.array(F.sort_array(found)), lambda s: F.flatten(F.transform(F.array(ends(s)), lambda e: runs(s, e)))))
    return F.when(F.size(found) > 0, each)


def is_number(c: Column) -> Column:
    """What both float() of the specification and a cast read as the same finite number."""
    return F.when(bare(c), c).otherwise(strip(c)).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")


def float_text(x: Column) -> Column:
    """A double as text in its shortest form with at least one decimal, for 1e-3 <= |x| < 1e16 and 0."""
    plain = x.cast("string")
    wide = F.regexp_replace(plain.cast("decimal(38,18)").cast("string"), r"(\.[0-9]+?)0+$", "$1")
    return F.when(F.abs(x) >= 1e7, wide).otherwise(plain)


def left(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def path_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def pick(k: Column, *values: Column) -> Column:
    """The k-th of the values; null beyond them."""
    out = F.when(k == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(k == i, value)
    return out


def _counted(rules: list[Column]) -> tuple[list[Column], list[Column]]:
    """Whether each rule holds, and how many hold before it (one more: how many in all)."""
    holds, at = [F.coalesce(rule, F.lit(False)) for rule in rules], [F.lit(0)]
    for one in holds:
        at.append(at[-1] + one.cast("int"))
    return holds, at


def beyond(rules: list[Column], more: Column) -> Column:
    """What `more` (array<struct<text, kind>>) gives behind the rules, as spots() takes it: a column of its own, as its lambdas keep what they stand in
    from being compiled."""
    base = _counted(rules)[1][-1]
    return F.transform(more, lambda x, i: F.struct(F.lit(len(rules)).alias("k"), (base + i).alias("at"), x["text"].alias("text"), x["kind"].alias("kind")))


def spots(rules: list[Column], more: Column | None = None, wanted: list[Column | bool] | None = None) -> Column:
    """array<struct<k, at, text, kind>>: for each rule its number and how many hold before it, null where it doesn't hold; behind them those of `more`
    (what beyond() made; null: none). Exploded, this is narrow: what a rule gives is worked out after it, for that rule alone. wanted: of each rule
    a further condition, without which it counts for those behind it but isn't told; False: nothing of it is asked."""
    holds, at = _counted(rules)
    none = F.lit(None).cast("string")
    told = [(k, h if w is True else h & w) for k, (h, w) in enumerate(zip(holds, wanted or [True] * len(holds))) if w is not False]
    found = F.array(*[F.when(h, F.struct(F.lit(k).alias("k"), at[k].alias("at"), none.alias("text"), none.alias("kind"))) for k, h in told])
    return found if more is None else F.concat(found, F.coalesce(more, F.array().cast("array<struct<k:int,at:int,text:string,kind:string>>")))


def numbered_ord(at: Column) -> Column:
    """A place behind its row's `ord`, so that texts sort as places do."""
    return F.concat("ord", F.lit("/"), F.lpad(at.cast("string"), 8, "0"))
