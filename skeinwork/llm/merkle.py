"""Merkle manifest of a dataset: one tree a language over its documents, one over the languages; proofs for every document.

Built from the bottom: leaves are numbered in their tree's order, runs of ARITY consecutive nodes become
one node, and each level is a table of runs (a parent's number with its children). Proofs come from the
top: at each level the runs meet what their parents inherited, and each child puts its own siblings before
it. So a proof is read off its leaf's row, and nothing but digests and numbers is ever shuffled.

Numbers in a tree come from ranges that are sorted side by side, shifted by the counts of the ranges
before, so a language that holds most of all rows is as many ranges'. Runs are grouped by (tree, number of
the run): eight rows a group. Tables of runs fall to an eighth from level to level.

Defined cases: a null in any column is `-`; an empty text is `0:`; a null language is a tree of its own,
before all others; null ids come first in a tree, and rows of one id in the order of their leaves (rows
equal in all five columns have equal leaves, so whichever comes first gives the same digests, though
proofs differ by place); an empty table gives an empty result; columns other than the five are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.llm.common import cut, read

#: Children of a node.
ARITY = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts, concatenated."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as its UTF-8 length, a colon and itself, so that no two rows run together; `-` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return digest(*[field(c) for c in (doc_id, source, lang, n_chars, text)])


def leaves(docs: DataFrame, claimed: Column | None = None) -> DataFrame:
    """tree (the language), doc_id, digest, claimed: each row's leaf, and the leaf of what is claimed to be its text (by default the text itself)."""
    own = [docs[c] for c in FIELDS]
    other = leaf(*own[:4], claimed) if claimed is not None else F.col("digest")
    doc_id = docs["doc_id"].cast("long").alias("doc_id")
    return docs.select(docs["lang"].cast("string").alias("tree"), doc_id, leaf(*own).alias("digest"), *([other.alias("claimed")] if claimed is not None else []))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with `at`, their number in their tree from 0 in the given order, and `n`, their tree's size. Equal rows are dealt to ranges too: rows that
    agree in all of `order` are told apart by where they are read."""
    keys = [F.col("tree").asc_nulls_first(), *order]
    ranged = rows.withColumn("tie", F.xxhash64(F.monotonically_increasing_id()))
    ranged = ranged.repartitionByRange(*keys, F.col("tie").asc()).sortWithinPartitions(*keys, F.col("tie").asc())
    ranged = cut(ranged.drop("tie").withColumn("m", F.monotonically_increasing_id()), name)
    placed = ranged.withColumn("part", F.shiftright("m", 33))
    counts = placed.groupBy("tree", "part").agg(F.count("*").alias("rows"), F.min("m").alias("first"))
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    # a row for each range and tree in it; joined on both, so that no tree is one key
    starts = counts.select(F.col("tree").alias("tree_"), F.col("part").alias("part_"), (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    joined = placed.join(starts, placed["tree"].eqNullSafe(starts["tree_"]) & (placed["part"] == starts["part_"]))
    return joined.withColumn("at", F.col("m") + F.col("shift")).drop("m", "part", "tree_", "part_", "shift")


@dataclass(frozen=True)
class Trees:
    """levels: for each level, from the leaves up, its runs (tree, up, n, kids); tops: tree, height, digest and rest (a lone leaf's own columns)."""

    levels: list[DataFrame]
    tops: DataFrame


def build(nodes: DataFrame, name: str, arity: int = ARITY) -> Trees:
    """Trees over nodes (tree, at, n, digest and more, which the lowest runs keep): level by level, each stored, until every tree has one node."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    more = [c for c in nodes.columns if c not in ("tree", "at", "n")]
    levels: list[DataFrame] = []
    lone = nodes.where("n = 1").select("tree", F.lit(0).alias("height"), "digest", F.struct(*more).alias("rest"))
    none = F.lit(None).cast(lone.schema["rest"].dataType)
    tops = [lone]
    height = 0
    while most > 1:
        kids = F.array_sort(F.collect_list(F.struct("at", *more)))
        runs = nodes.where("n > 1").groupBy("tree", F.expr(f"at div {arity}").alias("up"), "n").agg(kids.alias("kids"))
        levels.append(cut(runs, f"{name}-level"))
        height, most = height + 1, -(-most // arity)
        size = F.expr(f"(n + {arity - 1}) div {arity}").alias("n")
        nodes = levels[-1].select("tree", F.col("up").alias("at"), size, digest(F.array_join("kids.digest", "")).alias("digest"))
        more = ["digest"]
        tops.append(nodes.where("n = 1").select("tree", F.lit(height).alias("height"), "digest", none.alias("rest")))
    out = tops[0]
    for top in tops[1:]:
        out = out.union(top)
    return Trees(levels, cut(out, f"{name}-tops"))


def _siblings(kids: Column, i: Column) -> Column:
    """What stands before and after child i of a run."""
    hexes = F.transform(kids, lambda k: k["digest"])
    return F.struct(F.array_join(F.slice(hexes, F.lit(1), i), "").alias("before"), F.array_join(F.slice(hexes, i + 2, F.size(hexes)), "").alias("after"))


def _pushed(runs: DataFrame, inherited: DataFrame) -> DataFrame:
    """tree, kid, proof and what else is inherited, for every child: its siblings before its parent's proof. inherited: tree, at, proof, ..."""
    above = inherited.withColumnsRenamed({"tree": "tree_", "at": "at_"})
    met = runs.join(above, runs["tree"].eqNullSafe(above["tree_"]) & (runs["up"] == above["at_"]))
    met = met.select("tree", "kids", *[c for c in inherited.columns if c not in ("tree", "at")], F.posexplode("kids").alias("i", "kid"))
    return met.withColumn("proof", F.concat(F.array(_siblings(F.col("kids"), F.col("i"))), F.col("proof"))).drop("kids", "i")


def push(trees: Trees, inherited: DataFrame, name: str) -> DataFrame:
    """rest (a leaf's own columns), proof and what else is inherited, for every leaf. inherited: tree, height, rest and proof of every top, and more."""
    names = [c for c in inherited.columns if c not in ("tree", "height", "rest")]
    found = inherited.where("height = 0").select("rest", *names)
    at = None
    for height in range(len(trees.levels), 0, -1):
        top = inherited.where(F.col("height") == height).select("tree", F.lit(0).cast("long").alias("at"), *names)
        down = _pushed(trees.levels[height - 1], top if at is None else at.union(top))
        if height == 1:
            rest = F.struct(*[F.col(f"kid.{f}").alias(f) for f in inherited.schema["rest"].dataType.names])
            return found.union(down.select(rest.alias("rest"), *names))
        at = cut(down.select("tree", F.col("kid.at").alias("at"), *names), f"{name}-proofs")
    return found


NO_PROOF = "array<struct<before:string,after:string>>"


def manifest(docs: DataFrame, claimed: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (for each level up to the root the hex digests before and after one's own), and claimed, if given."""
    own = numbered(cut(leaves(docs, claimed), "merkle-leaves"), [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], "merkle-order")
    low = build(own, "merkle", arity)
    # the languages' tops are the leaves of one more tree
    of = low.tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    high = build(numbered(of, [F.col("lang").asc_nulls_first()], "merkle-langs"), "merkle-root", arity)
    start = high.tops.select("tree", "height", "rest", F.array().cast(NO_PROOF).alias("proof"), F.col("digest").alias("root"))
    down = push(high, start, "merkle-root").select(F.col("rest.lang").alias("lang"), "proof", "root")
    met = low.tops.join(down, low.tops["tree"].eqNullSafe(down["lang"])).select("tree", "height", "rest", "proof", F.col("digest").alias("subroot"), "root")
    rows = push(low, cut(met, "merkle-subroots"), "merkle")
    more = [F.col("rest.claimed").alias("claimed")] if claimed is not None else []
    return rows.select(F.col("rest.doc_id").alias("doc_id"), F.col("rest.digest").alias("leaf"), "subroot", "root", "proof", *more)


def fold(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give: at each level the siblings around one's own digest become the next one."""
    return F.aggregate(proof, start, lambda own, p: digest(p["before"], own, p["after"]))


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["before"], p["after"])), ""), 256)


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    rows = manifest(docs, F.when(tampered & docs["doc_id"].isNotNull(), F.translate("text", _UPPER, _LOWER)).otherwise(F.col("text")))
    folded = rows.withColumn("folded_root", fold(F.col("claimed"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Every level by grouping the one below; proofs by joining each ancestor's run; folds level by level. The CRC goes byte by byte.
def _levels(name: str, base: str) -> str:
    """A recursive CTE over (tree, lvl, pos, digest): runs of ARITY become their parent until a tree has one node."""
    return f"""{name}(tree, lvl, pos, digest) AS ({base} UNION ALL
      SELECT tree, lvl + 1, pos // {ARITY}, sha256(string_agg(digest, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, lvl, pos // {ARITY})"""


def _field(c: str) -> str:
    return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in (*FIELDS[:4], text)) + ")"


ORACLE = f"""WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab),
    d AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda h: CAST(ascii(h) AS BIGINT))),
      lambda c, y: xor(tab[(xor(c, y) & 255) + 1], c >> 8)), 4294967295) % 3 = 0 AS tampered FROM documents, tab),
    l AS (SELECT doc_id, lang, {_leaf("text")} AS leaf, {_leaf(f"CASE WHEN tampered THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END")} AS claimed,
      row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM d),
    {_levels("low", "SELECT lang, 0, pos, leaf FROM l")},
    s AS (SELECT tree AS lang, arg_max(digest, lvl) AS subroot, max(lvl) AS height FROM low GROUP BY tree),
    {_levels("high", "SELECT 0, 0, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1, subroot FROM s")},
    o AS (SELECT lang, subroot, height, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS nth FROM s),
    nodes AS (SELECT o.lang, low.lvl, low.pos, digest FROM low JOIN o ON o.lang IS NOT DISTINCT FROM low.tree WHERE lvl < height
      UNION ALL SELECT o.lang, height + lvl, pos, digest FROM high, o WHERE lvl < (SELECT max(lvl) FROM high)),
    f(doc_id, lang, lvl, pos, own, siblings) AS (SELECT doc_id, lang, 0, CASE WHEN height = 0 THEN nth ELSE pos END, claimed, '' FROM l JOIN o USING (lang)
      UNION ALL SELECT f.doc_id, f.lang, f.lvl + 1, CASE WHEN f.lvl + 1 = any_value(o.height) THEN any_value(o.nth) ELSE f.pos // {ARITY} END,
        sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.own ELSE n.digest END, '' ORDER BY n.pos)), f.siblings || coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (WHERE n.pos <> f.pos), '')
      FROM f JOIN o ON o.lang IS NOT DISTINCT FROM f.lang JOIN nodes n ON n.lang IS NOT DISTINCT FROM f.lang AND n.lvl = f.lvl AND n.pos // {ARITY} = f.pos // {ARITY}
      GROUP BY f.doc_id, f.lang, f.lvl, f.pos, f.own, f.siblings)
    SELECT l.doc_id, leaf, subroot, root, sha256(siblings) AS proof_sha256, own AS folded_root, own = root AS verified
    FROM l JOIN o ON o.lang IS NOT DISTINCT FROM l.lang JOIN f ON f.doc_id = l.doc_id AND f.lvl = height + (SELECT max(lvl) FROM high), (SELECT arg_max(digest, lvl) AS root FROM high)"""
