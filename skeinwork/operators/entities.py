"""Entities from texts (by pattern), rows (by column) and model responses, and their deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skeinwork.functions.text import beyond, counted, drop_point_zero, find_all, find_spans, float_text, is_number, norm, numbered_ord, pick, spots, strip, truthy

#: Patterns, words and markers of the specification. Words of a run are possessive: a group that may give words back takes a part of the
#: stack for each, and a run of some thousand words then ends the executor, which a StackOverflowError is fatal to.
CAPITALISED = r"\b[A-Z][a-z]++\b(?:(?U:\s)++[A-Z][a-z]++\b)*+"
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
URL = r"https?://(?:www\.)?[-a-zA-Z0-9@:%._\+~#=]{1,256}\.[a-zA-Z0-9()]{1,6}\b[-a-zA-Z0-9()@:%_\+.~#?&/=]*"
NUMBER = r"(?U)\b\d+(?:\.\d+)?\b"
BRAND = r"\b[A-Z][a-z]+(?:(?U:\s)+[A-Z][a-z]+)?\b"
PERCENTAGE = r"(?U)~?\d+(?:\.\d+)?%"
RANK = r"(?U)#\d+"
STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might can this that these those i you he she it we they them their"
).split()
COMPANY_MARKS = ("PT ", "Tbk", "Corporation", "Inc", "Ltd")
PLACES = ("Domestic", "Export", "Indonesia")
DEPARTMENT_MARKS = ("unit", "committee", "department")
SECTION_COLUMNS = frozenset(("section", "subsection", "year", "perspective", "content", "tags"))
RELATION_COLUMNS = frozenset(("source", "relation", "target", "target_type"))

FIELDS = {
    "text": "string", "type": "string", "column": "string", "is_key": "boolean", "confidence": "double", "start": "int", "end": "int",
    "section": "string", "year": "string", "parent_section": "string", "relation": "string", "entity_category": "string", "value": "double",
    "unit": "string", "derived_from": "string", "extraction_method": "string",
}
_STRUCT = "struct<" + ",".join(f"`{k}`:{v}" for k, v in FIELDS.items()) + ">"


def entity(text: Column, kind: Column | str, confidence: float, **more) -> Column:
    """One entity struct; fields that aren't given are null."""
    given = {"text": text, "type": F.lit(kind) if isinstance(kind, str) else kind, "confidence": F.lit(confidence), **more}
    return F.struct(*[(given[k] if isinstance(given.get(k), Column) else F.lit(given.get(k))).cast(v).alias(k) for k, v in FIELDS.items()])


def _rows(chunks: DataFrame, found: Column) -> DataFrame:
    """chunk_id, source, ord and the fields of each entity. ord orders entities over all chunks: the chunk's, then the place in it."""
    each = chunks.select("chunk_id", "source_doc", "ord", F.posexplode(found).alias("at", "__e"))
    return each.select("chunk_id", F.col("source_doc").alias("source"), F.concat("ord", F.lit("/"), F.lpad(F.col("at").cast("string"), 8, "0")).alias("ord"), "__e.*")


def _spans(text: Column, pattern: str, kind: str, confidence: float) -> Column:
    return F.transform(find_spans(text, pattern), lambda m: entity(m["text"], kind, confidence, start=m["start"], end=m["end"]))


def _named(text: Column) -> Column:
    return F.length(text).between(2, 50) & ~F.lower(text).isin(STOP_WORDS)


def capitalised(text: Column) -> Column:
    ok = F.filter(find_spans(text, CAPITALISED), lambda m: _named(m["text"]))
    return F.transform(ok, lambda m: entity(m["text"], "NAMED_ENTITY", 0.7, start=m["start"], end=m["end"]))


def keyword_entities(chunks: DataFrame, emails: bool = True, urls: bool = True, numbers: bool = True) -> DataFrame:
    """Capitalised phrases, then e-mails, URLs and numbers of each chunk, in one scan. chunks: chunk_id, source_doc, ord, text."""
    text = F.col("text")
    parts = [capitalised(text)]
    # most texts hold none of these: a plain search tells
    none = F.array().cast(f"array<{_STRUCT}>")
    if emails:
        parts.append(F.when(text.contains("@"), _spans(text, EMAIL, "EMAIL", 1.0)).otherwise(none))
    if urls:
        parts.append(F.when(text.contains("://"), _spans(text, URL, "URL", 1.0)).otherwise(none))
    if numbers:
        parts.append(F.when(text.rlike(r"(?U)\d"), _spans(text, NUMBER, "NUMBER", 1.0)).otherwise(none))
    return _rows(chunks.where(F.col("text").isNotNull()), F.concat(*parts))


def keyword_counts(chunks: DataFrame) -> DataFrame:
    """chunk_id, text, type, confidence, n: keyword_entities() without their places, counted in each row of chunks (chunk_id, text), so that no row is shuffled."""
    text = F.col("text")

    def told(found: Column, kind: str, confidence: float) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("text"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence")))

    none = F.array().cast("array<struct<text:string,type:string,confidence:double>>")
    found = F.concat(
        told(F.filter(find_all(text, CAPITALISED), _named), "NAMED_ENTITY", 0.7),
        F.when(text.contains("@"), told(find_all(text, EMAIL), "EMAIL", 1.0)).otherwise(none),
        F.when(text.contains("://"), told(find_all(text, URL), "URL", 1.0)).otherwise(none),
        F.when(text.rlike(r"(?U)\d"), told(find_all(text, NUMBER), "NUMBER", 1.0)).otherwise(none),
    )
    # as a lambda's variable what is found is made once
    each = F.flatten(F.transform(F.array(found), lambda x: F.coalesce(counted(x), F.array())))
    # an outer explode, as Spark would filter by the array's size for the other and make every array twice
    out = chunks.where(text.isNotNull()).select("chunk_id", each.alias("__found")).select("chunk_id", F.explode_outer("__found").alias("__e")).where("__e is not null")
    return out.select("chunk_id", "__e.x.*", "__e.n")


def classify(text: Column, from_source: bool) -> Column:
    """An entity's type by its text, first rule that holds."""
    company = F.lit(False)
    for mark in COMPANY_MARKS:
        company = company | text.contains(mark)
    department = F.lit(False)
    for mark in DEPARTMENT_MARKS:
        department = department | F.lower(text).contains(mark)
    acronym = (F.length(text) <= 5) & (text == F.upper(text)) & (text != F.lower(text))
    return (
        F.when(company, "ORGANIZATION")
        .when(text.rlike(r"^[A-Z][a-z]+(?:(?U:\s)+[A-Z][a-z]+)?$"), "ORGANIZATION" if from_source else "PRODUCT")
        .when(acronym, "TECHNOLOGY")
        .when(text.isin(*PLACES), "LOCATION")
        .when(department, "DEPARTMENT")
        .otherwise("ENTITY")
    )


def target_type(raw: Column, text: Column) -> Column:
    kind = F.lower(F.coalesce(raw, F.lit("entity")))
    return F.when(kind == "entity", classify(text, False)).when(kind == "concept", "CONCEPT").when(kind == "data", "METRIC").otherwise("ENTITY")


def evidence(note: Column) -> Column:
    """array<struct<text, kind>>: brands (once each), percentages and ranks of a note."""
    brands = F.filter(F.array_distinct(F.transform(find_all(note, BRAND), strip)), lambda x: F.length(x) > 2)

    def told(found: Column, kind: str) -> Column:
        return F.transform(found, lambda x: F.struct(x.alias("text"), F.lit(kind).alias("kind")))

    return F.concat(told(brands, "BRAND"), told(find_all(note, PERCENTAGE), "PERCENTAGE"), told(find_all(note, RANK), "RANK"))


def _if(condition: Column, *items: Column) -> Column:
    return F.when(condition, F.array(*items)).otherwise(F.array().cast(f"array<{_STRUCT}>"))


def relation_entities(rows: DataFrame) -> DataFrame:
    """Entities of entity-relation rows (source, relation, target, target_type and, if there, section, year, value, unit, evidence_note)."""
    c = _columns(rows, "source", "relation", "target", "target_type", "section", "year", "value", "unit", "evidence_note")
    number = F.when(is_number(c["value"]), F.expr("try_cast(value as double)")) if "value" in rows.columns else F.lit(None).cast("double")
    named = rows.select("chunk_id", "source_doc", "ord", *[v.alias(k) for k, v in c.items()], number.alias("number"))
    c = {k: F.col(k) for k in c}
    number = F.col("number")
    rules = [truthy(c["source"]), truthy(c["target"]), truthy(c["section"]), truthy(c["year"]), truthy(c["value"]) & number.isNotNull()]
    # a null note has no evidence, and nothing is looked for in it
    note = c["evidence_note"]
    # a column first, so that the explode is compiled; an outer one, as Spark would filter by the array's size for the other and make every array twice
    named = named.withColumn("xs", spots(rules, F.when(note.isNotNull(), beyond(rules, evidence(note)))))
    each = named.select("*", F.explode_outer("xs").alias("x")).where("x is not null").select("*", "x.k", "x.at", F.col("x.text").alias("noted"), F.col("x.kind").alias("noted_kind"))
    k, none = F.col("k"), F.lit(None)
    metric = F.when(truthy(c["unit"]), F.concat(float_text(number), F.lit(" "), c["unit"])).otherwise(float_text(number))
    fields = {
        "text": pick(k, c["source"], c["target"], c["section"], drop_point_zero(c["year"]), metric, F.col("noted")),
        "type": pick(k, classify(c["source"], True), target_type(c["target_type"], c["target"]), F.lit("SECTION"), F.lit("YEAR"), F.lit("METRIC"), F.col("noted_kind")),
        "column": pick(k, *map(F.lit, ("source", "target", "section", "year", "value", "evidence_note"))),
        "is_key": k < 2, "confidence": F.when(k == 2, 0.9).when(F.col("noted_kind") == "BRAND", 0.7).otherwise(1.0),
        "section": F.when((k != 2) & (k != 3), c["section"]), "year": F.when(k != 3, c["year"]), "relation": F.when(k < 2, c["relation"]),
        "entity_category": F.when(k == 1, c["target_type"]), "value": F.when(k == 4, number), "unit": F.when(k == 4, c["unit"]), "derived_from": F.when(k == 5, "evidence"),
    }
    return each.select("chunk_id", F.col("source_doc").alias("source"), numbered_ord(F.col("at")).alias("ord"), *[fields.get(n, none).cast(t).alias(n) for n, t in FIELDS.items()])


def section_entities(rows: DataFrame) -> DataFrame:
    """Entities of subjective-section rows; those of the content are its capitalised phrases."""
    c = _columns(rows, *SECTION_COLUMNS)
    here = {"section": c["section"], "year": c["year"]}
    tags = F.filter(F.transform(F.split(F.coalesce(c["tags"], F.lit("")), ","), strip), lambda t: t != "")
    words = F.filter(find_spans(F.coalesce(c["content"], F.lit("")), CAPITALISED), lambda m: F.length(m["text"]).between(2, 50) & ~F.lower(m["text"]).isin(STOP_WORDS))
    found = F.concat(
        _if(truthy(c["section"]), entity(c["section"], "SECTION", 1.0, column="section", is_key=True, year=c["year"])),
        _if(truthy(c["subsection"]), entity(c["subsection"], "SUBSECTION", 1.0, column="subsection", is_key=True, parent_section=c["section"], year=c["year"])),
        _if(truthy(c["perspective"]), entity(c["perspective"], "PERSPECTIVE", 0.9, column="perspective", is_key=False, **here)),
        _if(truthy(c["year"]), entity(drop_point_zero(c["year"]), "YEAR", 1.0, column="year", is_key=False)),
        F.transform(tags, lambda t: entity(t, "TAG", 0.8, column="tags", is_key=False, **here)),
        F.transform(words, lambda m: entity(m["text"], classify(m["text"], False), 0.7, column="content", is_key=False, start=m["start"], end=m["end"], **here)),
    )
    return _rows(rows, found)


def generic_entities(rows: DataFrame, columns: list[str], key_columns: list[str] | None = None) -> DataFrame:
    """One entity for each row and column, empty ones too."""
    keys = key_columns or columns[:1]
    cells = [entity(F.coalesce(F.col(c).cast("string"), F.lit("None")), f"CSV_{c.upper()}", 1.0, column=c, is_key=c in keys) for c in columns]
    return _rows(rows, F.array(*cells))


def row_entities(rows: DataFrame, columns: list[str] | None = None, key_columns: list[str] | None = None) -> DataFrame:
    """The extractor that a table's columns ask for."""
    names = columns or [c for c in rows.columns if c not in ("chunk_id", "source_doc", "ord")]
    if SECTION_COLUMNS <= set(names):
        return section_entities(rows)
    if RELATION_COLUMNS <= set(names):
        return relation_entities(rows)
    return generic_entities(rows, names, key_columns)


def _columns(rows: DataFrame, *names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("string") if n in rows.columns else F.lit(None).cast("string") for n in names}


def parse_responses(responses: DataFrame) -> DataFrame:
    """Entities of a model's answer lines "ENTITY: t | TYPE: y | CONFIDENCE: c"; other lines are passed over. responses: chunk_id, source_doc, ord, response."""
    lines = F.filter(F.transform(F.split("response", "\n"), strip), lambda x: x.startswith("ENTITY:"))
    cut = responses.select("chunk_id", "source_doc", "ord", F.posexplode(lines).alias("at", "line")).withColumn("p", F.split("line", r"\|")).where(F.size("p") >= 3)
    # a tag goes wherever it stands in its part
    part = lambda k, tag: strip(F.replace(F.get("p", F.lit(k)), F.lit(tag), F.lit("")))
    score = part(2, "CONFIDENCE:")
    rows = cut.select(
        "chunk_id", F.col("source_doc").alias("source"), F.concat("ord", F.lit("/"), F.lpad(F.col("at").cast("string"), 8, "0")).alias("ord"),
        part(0, "ENTITY:").alias("text"), F.upper(part(1, "TYPE:")).alias("type"), F.when(is_number(score), score.try_cast("double")).alias("confidence"), F.lit("llm").alias("extraction_method"),
    )
    return rows.where("confidence is not null")


def model_prompt(text: Column, types: list[str]) -> Column:
    """What a model is asked for; its answer is read by parse_responses()."""
    head = f"Find the entities of these types in the text below: {', '.join(types)}\n\nText:\n"
    tail = "\n\nAnswer with one line for each entity:\nENTITY: <text> | TYPE: <type> | CONFIDENCE: <score>\n"
    return F.concat(F.lit(head), text, F.lit(tail))


def model_entities(chunks: DataFrame, client, types: list[str]) -> DataFrame:
    """Entities that a model names. client: a callable from a list of prompts to a list of answers, called in Arrow batches; None: no entities."""
    import pyarrow as pa

    if client is None:
        answered = chunks.limit(0).select("chunk_id", "source_doc", "ord", F.lit("").alias("response"))
    else:

        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(client(b.column(3).to_pylist())), pa.string())], names=["chunk_id", "source_doc", "ord", "response"])

        asked = chunks.where(strip(F.col("text")) != "").select("chunk_id", "source_doc", "ord", model_prompt(F.col("text"), types).alias("prompt"))
        answered = asked.mapInArrow(run, "chunk_id string, source_doc string, ord string, response string")
    return parse_responses(answered)


def dedup(entities: DataFrame) -> DataFrame:
    """One row for each type and normalised text: the first, with the largest confidence of all."""
    names = [c for c in entities.columns if c not in ("type", "confidence")]
    first = F.min_by(F.struct(*names), "ord")
    # by the key first: it tells rows apart in the sort, which the few types don't
    out = entities.groupBy(norm(F.col("text")).alias("key"), "type").agg(first.alias("e"), F.max("confidence").alias("confidence"))
    return out.select(*[F.col(c) if c in ("type", "confidence") else F.col(f"e.{c}").alias(c) for c in entities.columns])


def summary(entities: DataFrame) -> DataFrame:
    return entities.groupBy("type").agg(F.count("*").alias("n"))


def samples(entities: DataFrame, n: int = 5) -> DataFrame:
    """The first n entities of each type."""
    rank = F.row_number().over(W.partitionBy("type").orderBy("ord"))
    return entities.withColumn("rank", rank).where(F.col("rank") <= n).select("type", "rank", "text")


_EXTRACTORS = {"keyword": keyword_entities, "llm": model_entities, "csv": row_entities}


def extractor(kind: str):
    if kind not in _EXTRACTORS:
        raise ValueError(f"unknown entity extractor {kind!r}; known: {', '.join(_EXTRACTORS)}")
    return _EXTRACTORS[kind]
