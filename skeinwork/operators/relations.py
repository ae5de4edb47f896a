"""Relationships from entities that stand near each other, from patterns and from rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.storage import cut
from skeinwork.functions.text import bare, drop_point_zero, find_all, norm, numbered_ord, pick, spots, strip, truthy
from skeinwork.operators.entities import RELATION_COLUMNS, SECTION_COLUMNS, _columns

#: Words that suggest a relationship, and the default patterns with type and confidence.
INDICATORS = ("and", "with", "of", "in", "at", "for", "by", "to")
PATTERNS = (
    (r"(\w+)\s+(?:is|are|was|were)\s+(?:a|an|the)?\s*(\w+)", "IS_A", 0.8),
    (r"(\w+)\s+(?:works for|employed by)\s+(\w+)", "WORKS_FOR", 0.9),
    (r"(\w+)\s+(?:located in|based in)\s+(\w+)", "LOCATED_IN", 0.85),
    (r"(\w+)\s+(?:owns|possesses|has)\s+(\w+)", "OWNS", 0.8),
    (r"(\w+)\s+(?:created|developed|built)\s+(\w+)", "CREATED", 0.85),
)

FIELDS = {"source": "string", "target": "string", "type": "string", "confidence": "double", "context": "string", "year": "string", "column": "string", "source_type": "string", "target_type": "string", "section": "string", "value": "string", "unit": "string", "evidence": "string"}
_STRUCT = "struct<" + ",".join(f"`{k}`:{v}" for k, v in FIELDS.items()) + ">"


def relation(source: Column, target: Column, kind: Column | str, confidence, **more) -> Column:
    given = {"source": source, "target": target, "type": F.lit(kind) if isinstance(kind, str) else kind, "confidence": confidence if isinstance(confidence, Column) else F.lit(confidence), **more}
    return F.struct(*[(given[k] if isinstance(given.get(k), Column) else F.lit(given.get(k))).cast(v).alias(k) for k, v in FIELDS.items()])


def _if(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast(f"array<{_STRUCT}>"))


def _rows(chunks: DataFrame, found: Column) -> DataFrame:
    # an outer explode, as Spark would filter by the array's size for the other and make every array twice
    each = chunks.select("chunk_id", "source_doc", "ord", found.alias("__found")).select("chunk_id", "source_doc", "ord", F.posexplode_outer("__found").alias("at", "__r")).where("__r is not null")
    return each.select("chunk_id", "source_doc", F.concat("ord", F.lit("/"), F.lpad(F.col("at").cast("string"), 8, "0")).alias("ord"), "__r.*")


def cooccurrence(chunks: DataFrame, entities: DataFrame, window_size: int = 100, min_confidence: float = 0.5) -> DataFrame:
    """Pairs of a chunk's entities whose starts are `window_size` or less apart. A range join: starts fall into bins of window + 1
    characters, and an entity meets its own bin and the next one alone."""
    width = window_size + 1
    e = entities.select("chunk_id", "ord", "text", "type", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("end", F.lit(0)).alias("end")).withColumn("bin", F.expr(f"start div {width}"))
    # what follows an entity within the window, all that a pair's context can be, is read from the text once for each entity
    bodies = chunks.select("chunk_id", "source_doc", F.col("text").alias("body"))
    follows = F.when(F.col("body").isNotNull(), F.substring(F.col("body"), F.col("end") + 1, F.lit(window_size)))
    e = cut(e.join(bodies, "chunk_id").withColumn("follows", follows).drop("body"), "spans")
    a = e.select("chunk_id", *[F.col(c).alias(f"a_{c}") for c in ("ord", "text", "type", "start", "end")], "source_doc", "follows", F.explode(F.array(F.col("bin"), F.col("bin") + 1)).alias("bin"))
    b = e.select("chunk_id", *[F.col(c).alias(f"b_{c}") for c in ("ord", "text", "type", "start")], "bin")
    after = (F.col("b_start") > F.col("a_start")) | ((F.col("b_start") == F.col("a_start")) & (F.col("b_ord") > F.col("a_ord")))
    pairs = a.join(b, ["chunk_id", "bin"]).where(after & (F.col("b_start") - F.col("a_start") <= window_size))
    between = F.when(F.col("a_end") < F.col("b_start"), strip(F.substring(F.col("follows"), F.lit(1), F.col("b_start") - F.col("a_end")))).otherwise("")
    distance = F.abs(F.col("b_start") - F.col("a_start"))

    def scored(context: Column) -> Column:
        lower = F.lower(context)
        hits = F.lit(0)
        for word in INDICATORS:
            hits = hits + lower.contains(word).cast("int")
        score = F.least(F.lit(1.0), F.lit(0.5) + F.greatest(F.lit(0.0), 1 - distance / window_size) * 0.3 + hits * 0.1)
        return F.struct(context.alias("context"), F.round(score, 6).alias("confidence"))

    # as a lambda's variable the text between is made once, not for each of its uses
    pairs = pairs.withColumn("__c", F.get(F.transform(F.array(between), scored), F.lit(0)))
    out = pairs.select("chunk_id", "source_doc", F.concat("a_ord", F.lit(">"), "b_ord").alias("ord"), F.col("a_text").alias("source"), F.col("b_text").alias("target"), F.lit("CO_OCCURS").alias("type"), "__c.confidence", "__c.context", F.col("a_type").alias("source_type"), F.col("b_type").alias("target_type"))
    return out.where(F.col("confidence") >= min_confidence)


def _quick(pattern: str) -> str:
    """A pattern that begins with a word and white space, without the attempts that can't succeed: from within a word, or with less of it."""
    head = r"(\w+)\s+"
    return r"(?<!\w)(\w++)\s++" + pattern[len(head) :] if pattern.startswith(head + "(?:") else pattern


def _verbs(patterns: Sequence[str]) -> str | None:
    """What a text must hold to match any of the patterns, if each is a word, white space and one of some words, with more behind them: white space and such words.
    None: one has another form, and nothing is known of it."""
    import re

    found = []
    for pattern in patterns:
        m = re.fullmatch(r"\(\\w\+\)\\s\+\(\?:([\w |]+)\)\\s\+(.*)", pattern)
        # alternatives outside groups would be others to the whole pattern
        if not m or "\\(" in m[2] or "[" in m[2] or "|" in re.sub(r"\([^()]*\)", "", m[2]):
            return None
        found.append(m[1])
    return r"(?iU)\s(?:" + "|".join(found) + r")\s" if found else None


def _from_match(pattern: str, kind: str, confidence: float):
    return lambda m: relation(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2), kind, confidence, context=m)


def pattern_relations(chunks: DataFrame, patterns=PATTERNS) -> DataFrame:
    """Pattern matches: group 1 is the source, group 2 the target, the whole the context. Patterns with fewer groups give nothing."""
    import re

    parts, used = [], [p for p in patterns if re.compile(p[0]).groups >= 2]
    for pattern, kind, confidence in used:
        p = "(?iU)" + _quick(pattern)
        # the groups are read from the match, which is short, not from the text again
        found, verbs = F.transform(find_all(F.col("text"), p), _from_match(p, kind, confidence)), _verbs([pattern])
        parts.append(found if verbs is None else F.when(F.col("text").rlike(verbs), found).otherwise(F.array().cast(f"array<{_STRUCT}>")))
    chunks, verbs = chunks.where(F.col("text").isNotNull()), _verbs([p for p, _, _ in used])
    if verbs is not None:
        # most texts hold none of these words: one plain search tells for all patterns
        chunks = chunks.where(F.col("text").rlike(verbs))
    return _rows(chunks, F.concat(*parts) if parts else _if(F.lit(False)))


def section_relations(rows: DataFrame) -> DataFrame:
    """Hierarchy, year, perspective and tags of subjective-section rows."""
    c = _columns(rows, *SECTION_COLUMNS)
    year = drop_point_zero(F.coalesce(c["year"], F.lit("")))
    tags = F.filter(F.transform(F.split(F.coalesce(c["tags"], F.lit("")), ","), strip), lambda t: t != "")
    sub = truthy(c["subsection"])
    found = F.concat(
        _if(truthy(c["section"]) & sub, relation(c["section"], c["subsection"], "HAS_SUBSECTION", 1.0, year=year)),
        _if(sub & (year != ""), relation(c["subsection"], year, "IN_YEAR", 1.0)),
        _if(sub & truthy(c["perspective"]), relation(c["subsection"], c["perspective"], "HAS_PERSPECTIVE", 0.9, year=year, section=c["section"])),
        F.when(sub, F.transform(tags, lambda t: relation(c["subsection"], t, "TAGGED_WITH", 0.8, year=year, section=c["section"]))).otherwise(_if(F.lit(False))),
    )
    return _rows(rows, found)


def entity_types(entities: DataFrame) -> DataFrame:
    """For each exact text the type of its first entity."""
    return entities.groupBy("text").agg(F.min_by("type", "ord").alias("kind"))


#: What row_relations asks of entities; confidence is for dedup.
TYPED = ("text", "type", "confidence", "ord")


def row_relations(rows: DataFrame, entities: DataFrame | None = None, carried: Sequence[str] = (), kind: str | None = None) -> DataFrame:
    """The relation that an entity-relation row states, and its section and year. Types of ends are those of the first entity of that text;
    without entities a source has none and a target what its row says, and no row is shuffled. carried: further columns of the rows that
    their relations keep. kind: the only type that is asked for; columns that only others are made of aren't read."""
    c = _columns(rows, "source", "relation", "target", "target_type", "section", "year", "value", "unit", "evidence_note")
    wide = rows.select("chunk_id", "source_doc", "ord", *carried, *[v.alias(k) for k, v in c.items()])
    if entities is None:
        wide = wide.withColumns({"source_kind": F.lit(None).cast("string"), "target_kind": F.lit(None).cast("string")})
    else:
        kinds = entity_types(entities)
        wide = wide.join(kinds.select(F.col("text").alias("source"), F.col("kind").alias("source_kind")), "source", "left")
        wide = wide.join(kinds.select(F.col("text").alias("target"), F.col("kind").alias("target_kind")), "target", "left")
    col = F.col
    year = drop_point_zero(F.coalesce("year", F.lit("")))
    filled = lambda n: truthy(col(n)) & (bare(col(n)) | (strip(col(n)) != ""))
    rules = [truthy(col("source")) & truthy(col("relation")) & truthy(col("target")), truthy(col("source")) & truthy(col("section")), truthy(col("source")) & (year != "")]
    named = F.replace(F.upper("relation"), F.lit(" "), F.lit("_"))
    asked = [kind in (None, "IN_SECTION"), kind in (None, "IN_YEAR")]
    wanted = [F.coalesce(named == kind, F.lit(False)), *asked] if kind is not None else None
    section, at_year = (x if a else F.lit(None).cast("string") for x, a in zip((col("section"), year), asked))
    each = wide.select("*", F.explode(spots(rules, wanted=wanted)).alias("x")).where("x is not null").select("*", "x.k", "x.at")
    k, none = col("k"), F.lit(None)
    stated = lambda x: F.when(k == 0, x)
    fields = {
        "source": col("source"), "target": pick(k, col("target"), section, at_year), "type": pick(k, named, F.lit("IN_SECTION"), F.lit("IN_YEAR")),
        "confidence": F.when(k == 1, 0.9).otherwise(1.0), "year": F.when(k < 2, year), "section": stated(col("section")), "source_type": stated(col("source_kind")), "target_type": stated(F.coalesce("target_kind", "target_type")),
        "value": F.when((k == 0) & filled("value"), col("value")), "unit": F.when((k == 0) & filled("value") & filled("unit"), col("unit")), "evidence": F.when((k == 0) & filled("evidence_note"), col("evidence_note")),
    }
    return each.select("chunk_id", "source_doc", numbered_ord(col("at")).alias("ord"), *[fields.get(n, none).cast(t).alias(n) for n, t in FIELDS.items()], *carried)


def content_mentions(rows: DataFrame, entities: DataFrame) -> DataFrame:
    """What a row's content mentions: MENTIONS_<TYPE> from its subsection, else its section."""
    c = _columns(rows, "section", "subsection", "year")
    subject = F.when(truthy(c["subsection"]), c["subsection"]).otherwise(c["section"])
    r = rows.select("chunk_id", "source_doc", subject.alias("subject"), drop_point_zero(F.coalesce(c["year"], F.lit(""))).alias("year")).where(truthy(F.col("subject")))
    e = entities.where((F.col("column") == "content") & (F.length("text") > 2)).select("chunk_id", "ord", "text", "type", "confidence")
    return e.join(r, "chunk_id").select("chunk_id", "source_doc", "ord", F.col("subject").alias("source"), F.col("text").alias("target"), F.concat(F.lit("MENTIONS_"), "type").alias("type"), "confidence", "year")


def generic_relations(rows: DataFrame, columns: list[str], key_column: str | None = None) -> DataFrame:
    """From the key column (else the first) to each other column; without a key column the first links to itself too."""
    key = F.col(key_column or columns[0]).cast("string")
    cells = []
    for name in columns:
        if name != key_column:
            value = F.coalesce(F.col(name).cast("string"), F.lit("None"))
            cells.append(F.when(strip(value) != "", relation(key, value, f"HAS_{name.upper()}", 1.0, column=name)))
    return _rows(rows.where(truthy(key)), F.filter(F.array(*cells), lambda x: x.isNotNull()))


def table_relations(rows: DataFrame, entities: DataFrame, columns: list[str] | None = None, key_column: str | None = None) -> DataFrame:
    names = columns or [c for c in rows.columns if c not in ("chunk_id", "source_doc", "ord")]
    if SECTION_COLUMNS <= set(names):
        return section_relations(rows).unionByName(content_mentions(rows, entities), allowMissingColumns=True)
    if RELATION_COLUMNS <= set(names):
        return row_relations(rows, entities)
    return generic_relations(rows, names, key_column)


def dedup(relations: DataFrame) -> DataFrame:
    """One row for each (source, target, type), texts compared without case: the most confident, the first of equals."""
    w = W.partitionBy(norm(F.col("source")), norm(F.col("target")), "type").orderBy(F.col("confidence").desc(), "ord")
    return relations.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unique_row_relations(rows: DataFrame) -> DataFrame:
    """dedup(row_relations(rows)). All that a row states has its source, so rows are shuffled by it before they state anything: fewer and
    narrower than their relations, which are then sorted once, and by a hash of their keys first: it tells them apart at once, where names
    begin alike. Rows without a source state nothing."""
    keyed = rows.where(truthy(F.col("source").cast("string"))).withColumn("__source", norm(F.col("source").cast("string"))).repartition("__source")
    keys = [F.col("__source"), norm(F.col("target")), F.col("type")]
    w = W.partitionBy(F.xxhash64("__source"), *keys).orderBy(F.col("confidence").desc(), "ord")
    each = row_relations(keyed, carried=["__source"])
    return each.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__source")


_EXTRACTORS = {"cooccurrence": cooccurrence, "pattern": pattern_relations, "csv": table_relations}


def extractor(kind: str):
    if kind not in _EXTRACTORS:
        raise ValueError(f"unknown relationship extractor {kind!r}; known: {', '.join(_EXTRACTORS)}")
    return _EXTRACTORS[kind]
