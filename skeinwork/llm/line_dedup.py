"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

Lines without a word are left out of the matching and always stay. A window is the shortest run of
lines that holds MIN_WORDS words from its first line on, or up to its last one; its fingerprint is the
least line hash in it, at its first place. Any repeated run of MIN_WORDS words or more holds a whole
window, so both places of the run select the same line.

1. Select: the windows and the positions that are their minima.
2. Join: positions meet on their fingerprints; those whose fingerprint is in one place alone are done.
   What is left of a window around its position tells which of a fingerprint's many positions can match:
   the first position with the same window is the partner. A group of n equal windows has n - 1 partners'
   pairs, never all pairs; windows of two documents that agree on the distance of their lines are one match.
3. Extend: each match is compared line by line, from its windows both ways, up to REACH lines beyond
   them (a longer run has windows there too, and so matches of its own). Runs of equal lines that hold
   MIN_WORDS words go from the later document (or the later place in it).

A repeated run is the union of the windows in it, each of which has a partner that begins earlier, so
no line of a repeated run is lost; what a match covers beyond its windows is an earlier run's repeat too.
First is the order of doc_id and line.

Only hashes, ids and positions are shuffled until the texts that change are rewritten. Partners that
many documents match with are dealt out with as many copies as they need.

Defined cases: a null text stays null, an empty one empty; a null id comes before all others; rows
equal in id and text are one document and get the same result; an empty table gives an empty result;
other columns are carried through, whatever their names and kinds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import WORD, cut, packed, read

#: Words of a run that is sure to be found.
MIN_WORDS = 50
#: Matches with one partner that are compared in one place, about.
MATCHES = 2000
#: Lines that are compared before and after the windows of a match.
REACH = 64


def _lines(docs: DataFrame) -> DataFrame:
    """id, th, pos, h (two longs, 128 bits), n: each line of each different document once."""
    text = F.coalesce(docs["text"], F.lit(""))
    each = docs.select(docs["doc_id"].alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    h = F.struct(F.xxhash64("line").alias("a"), F.xxhash64(F.lit(7), "line").alias("b"))
    each = each.select("id", "th", "pos", h.alias("h"), F.regexp_count("line", F.lit(WORD)).alias("n"))
    return each.repartition("id", "th").dropDuplicates(["id", "th", "pos"])


def select(lines: DataFrame, min_words: int) -> DataFrame:
    """id, th, s, e, p, print: each window (lines with words, by number, from s to e) with the place p of its least line hash."""
    doc = W.partitionBy("id", "th")
    runs = []
    for order, frame, whole in (
        ("begin", (0, min_words - 1), lambda w: F.max("end").over(w) - F.col("begin") >= min_words),
        ("end", (1 - min_words, 0), lambda w: F.col("end") - F.min("begin").over(w) >= min_words),
    ):
        w = doc.orderBy(order).rangeBetween(*frame)
        least = F.min(F.struct("h", "k")).over(w)
        run = lines.select("id", "th", F.min("k").over(w).alias("s"), F.max("k").over(w).alias("e"), least.alias("least"), whole(w).alias("whole"))
        runs.append(run.where("whole").select("id", "th", "s", "e", F.col("least.k").alias("p"), F.col("least.h").alias("print")))
    return runs[0].union(runs[1])


def equal_runs(own: Column, other: Column, words: Column, start: Column, min_words: int) -> Column:
    """array<struct<s, e>>: the maximal runs of own lines, from number `start` on, that equal other's one by one, with min_words words or more."""
    lines = F.zip_with(F.zip_with(own, other, lambda x, y: F.coalesce(x == y, F.lit(False))), words, lambda same, n: F.struct(same.alias("same"), n.alias("n")))
    none = F.array().cast("array<struct<s:int,e:int>>")

    def closed(acc: Column) -> Column:
        run = F.struct(acc["s"].alias("s"), (acc["at"] - 1).alias("e"))
        return F.when(acc["n"] >= min_words, F.array_append(acc["out"], run)).otherwise(acc["out"])

    def step(acc: Column, x: Column) -> Column:
        at = acc["at"] + 1
        longer = F.struct(at.alias("at"), acc["s"].alias("s"), (acc["n"] + x["n"]).alias("n"), acc["out"].alias("out"))
        return F.when(x["same"], longer).otherwise(F.struct(at.alias("at"), at.alias("s"), F.lit(0).alias("n"), closed(acc).alias("out")))

    return F.aggregate(lines, F.struct(start.alias("at"), start.alias("s"), F.lit(0).alias("n"), none.alias("out")), step, closed)


def removals(docs: DataFrame, min_words: int = MIN_WORDS, matches: int = MATCHES, reach: int = REACH) -> tuple[DataFrame, DataFrame]:
    """(lines, gone): the lines table and the (id, th, pos) that later repeated runs cover."""
    lines = cut(_lines(docs), "lines")
    cum = F.sum("n").over(W.partitionBy("id", "th").orderBy("pos"))
    number = F.row_number().over(W.partitionBy("id", "th").orderBy("pos")) - 1
    full = lines.where("n > 0").select("id", "th", "pos", "h", "n", cum.alias("end"), number.alias("k")).withColumn("begin", F.col("end") - F.col("n"))
    windows = cut(select(full, min_words), "line-windows")
    # fingerprints in more than one place; a table of its own, so that a join with a very frequent one can be split
    place = F.struct("id", "th", "p")
    prints = windows.groupBy("print").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    prints = cut(prints.where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("print").alias("again")), "line-prints")
    met = windows.join(prints, F.col("print") == F.col("again")).groupBy(F.col("id").alias("mid"), F.col("th").alias("mth")).agg(F.collect_list(F.struct("s", "e", "p")).alias("windows"))
    # the documents that have such positions, as arrays of their lines
    each = full.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("k", "h", "n", "pos"))).alias("x"))
    own = each.join(met, each["id"].eqNullSafe(met["mid"]) & (each["th"] == met["mth"]))
    own = cut(own.select("id", "th", F.col("x.h").alias("h"), F.col("x.n").alias("n"), F.col("x.pos").alias("pos"), "windows"), "line-documents")
    around = own.select("id", "th", "h", F.explode("windows").alias("w"))
    run = F.slice("h", F.col("w.s") + 1, F.col("w.e") - F.col("w.s") + 1)
    content = F.struct(F.xxhash64(run).alias("a"), F.xxhash64(F.lit(7), run).alias("b"), (F.col("w.p") - F.col("w.s")).alias("at"))
    near = cut(around.select("id", "th", F.col("w.s").alias("s"), F.col("w.e").alias("e"), content.alias("content")).distinct(), "line-near")
    spot = F.struct("id", "th", "s")
    firsts = near.groupBy("content").agg(F.min(spot).alias("first"), F.max(spot).alias("last"))
    firsts = cut(firsts.where(~F.col("first").eqNullSafe(F.col("last"))).select(F.col("content").alias("of"), "first"), "line-firsts")
    later = near.join(firsts, F.col("content") == F.col("of")).where(~spot.eqNullSafe(F.col("first")))
    later = later.select("id", "th", F.col("first.id").alias("qid"), F.col("first.th").alias("qth"), (F.col("s") - F.col("first.s")).alias("shift"), "s", "e").distinct()
    # windows of one match that touch are compared together
    along = W.partitionBy("id", "th", "qid", "qth", "shift").orderBy("s", "e")
    apart = F.col("s") > F.coalesce(F.max("e").over(along.rowsBetween(W.unboundedPreceding, -1)), F.lit(-2)) + 1
    pairs = later.withColumn("island", F.sum(apart.cast("int")).over(along.rowsBetween(W.unboundedPreceding, W.currentRow)))
    pairs = pairs.groupBy("id", "th", "qid", "qth", "shift", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    pairs = cut(pairs.withColumn("lo", F.greatest(F.lit(0), F.col("shift"), F.col("s") - reach)).withColumn("hi", F.col("e") + reach).select("id", "th", "qid", "qth", "shift", "lo", "hi"), "line-pairs")
    # a partner of many matches comes in as many copies, each for a part of them
    copies = pairs.groupBy(F.col("qid").alias("cid"), F.col("qth").alias("cth")).agg(F.ceil(F.count("*") / matches).cast("int").alias("copies"))
    partner = own.join(copies, own["id"].eqNullSafe(copies["cid"]) & (own["th"] == copies["cth"]))
    partner = cut(partner.select(F.col("id").alias("pid"), F.col("th").alias("pth"), F.col("h").alias("ph"), "copies"), "line-partners")
    counts = partner.select(F.col("pid").alias("nid"), F.col("pth").alias("nth"), "copies")
    dealt = pairs.join(counts, pairs["qid"].eqNullSafe(counts["nid"]) & (pairs["qth"] == counts["nth"]))
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("id", "th", "shift", "lo"), F.col("copies")).cast("int")).select(*pairs.columns, "copy")
    partner = partner.withColumn("pcopy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    dealt = dealt.join(partner, dealt["qid"].eqNullSafe(partner["pid"]) & (dealt["qth"] == partner["pth"]) & (dealt["copy"] == partner["pcopy"]))
    there = F.slice("ph", F.col("lo") - F.col("shift") + 1, F.least(F.col("hi"), F.size("ph") - 1 + F.col("shift")) - F.col("lo") + 1)
    dealt = dealt.select(F.col("id").alias("did"), F.col("th").alias("dth"), "lo", there.alias("there"))
    both = dealt.join(own, dealt["did"].eqNullSafe(own["id"]) & (dealt["dth"] == own["th"]))
    n = F.least(F.size("there"), F.size("h") - F.col("lo"))
    here = {c: F.slice(c, F.col("lo") + 1, n) for c in ("h", "n")}
    runs = both.select("id", "th", "pos", F.explode(equal_runs(here["h"], F.slice("there", F.lit(1), n), here["n"], F.col("lo"), min_words)).alias("run"))
    gone = runs.select("id", "th", F.explode(F.slice("pos", F.col("run.s") + 1, F.col("run.e") - F.col("run.s") + 1)).alias("pos")).distinct()
    return lines, gone


def _deduped(docs: DataFrame, min_words: int, matches: int, reach: int) -> DataFrame:
    """row (docs' columns, `text` and any `n_chars` as they are then) and n, the lines that went."""
    lines, gone = removals(docs, min_words, matches, reach)
    goes = gone.select(F.col("id").alias("gid"), F.col("th").alias("gth"), F.col("pos").alias("gpos"))
    flagged = lines.join(goes, lines["id"].eqNullSafe(goes["gid"]) & (lines["th"] == goes["gth"]) & (lines["pos"] == goes["gpos"]), "left")
    flagged = flagged.select("id", "th", "pos", (F.col("gpos").isNotNull() & (F.col("n") > 0)).alias("go"))
    per = flagged.groupBy("id", "th").agg(F.sort_array(F.collect_list(F.struct("pos", "go"))).alias("flags"), F.sum(F.col("go").cast("long")).alias("n")).where("n > 0")
    per = per.select("id", "th", F.col("flags.go").alias("go"), "n")
    rows = packed(docs, doc=F.col("doc_id"), of=F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    both = rows.join(per, rows["doc"].eqNullSafe(per["id"]) & (rows["of"] == per["th"]), "left")
    stay = F.filter(F.zip_with(F.split("row.text", "\n", -1), F.col("go"), lambda line, go: F.struct(line.alias("line"), go.alias("go"))), lambda x: ~x["go"])
    text = F.when(F.col("n").isNotNull(), F.array_join(F.transform(stay, lambda x: x["line"]), "\n")).otherwise(F.col("row.text"))
    both = both.select("row", "n", text.alias("text"))
    out = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        out = out.withField("n_chars", F.when(F.col("n").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")))
    return both.select(out.alias("row"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, matches: int = MATCHES, reach: int = REACH) -> DataFrame:
    """docs with the later repeated runs cut out of `text` (and `n_chars`, where there is one, as the new length), plus n_lines_removed, which
    takes the place of any column of that name."""
    kept = docs.drop("n_lines_removed")
    return _deduped(kept, min_words, matches, reach).select("row.*", F.col("n").alias("n_lines_removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without later repeated runs, and with no further column."""
    return _deduped(docs, MIN_WORDS, MATCHES, REACH).select("row.*")


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "text", "n_lines_removed")
