"""Fixed values of the specification, written out once more for the SQL: a wrong constant in the operators doesn't stay green by being read from there."""

STOP_WORDS = (
    "the a an and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might can this that these those i you he she it we they them their"
).split()
COMPANY_MARKS = ("PT ", "Tbk", "Corporation", "Inc", "Ltd")
DEPARTMENT_MARKS = ("unit", "committee", "department")
PLACES = ("Domestic", "Export", "Indonesia")

#: Relationships: words that raise a co-occurrence's confidence; patterns with the type and confidence of what they tell.
LINK_WORDS = ("and", "with", "of", "in", "at", "for", "by", "to")
PATTERNS = (
    (r"(\w+)\s+(?:is|are|was|were)\s+(?:a|an|the)?\s*(\w+)", "IS_A", 0.8),
    (r"(\w+)\s+(?:works for|employed by)\s+(\w+)", "WORKS_FOR", 0.9),
    (r"(\w+)\s+(?:located in|based in)\s+(\w+)", "LOCATED_IN", 0.85),
    (r"(\w+)\s+(?:owns|possesses|has)\s+(\w+)", "OWNS", 0.8),
    (r"(\w+)\s+(?:created|developed|built)\s+(\w+)", "CREATED", 0.85),
)

#: Questions: patterns of intents, in order; words that name a type of node; words that are no keywords; words for times.
INTENTS = (
    ("entity_lookup", (r"\bwhat is\b", r"\bwho is\b", r"\bdefine\b", r"\bexplain\b")),
    ("relationship", (r"\bhow.*related\b", r"\brelationship between\b", r"\bconnection between\b", r"\blink between\b")),
    ("aggregation", (r"\btotal\b", r"\bsum\b", r"\bcount\b", r"\baverage\b", r"\bhow many\b", r"\bhow much\b")),
    ("temporal", (r"\bin \d{4}\b", r"\bduring\b", r"\bwhen\b", r"\btimeline\b")),
    ("comparison", (r"\bcompare\b", r"\bversus\b", r"\bvs\b", r"\bdifference between\b")),
)
TYPE_WORDS = (
    ("ORGANIZATION", ("company", "corporation", "firm", "business")),
    ("PRODUCT", ("product", "brand", "line")),
    ("METRIC", ("revenue", "profit", "sales", "growth", "performance")),
)
QUESTION_STOP_WORDS = "the is at which on a an and or but in with to for of as by from".split()
TIMES = r"\b(last year|this year|previous year|recent|latest)\b"

#: Layouts of contexts.
HEAD = {"vector": "\n=== RELEVANT ENTITIES ===\n", "graph": "\n=== KNOWLEDGE GRAPH CONTEXT ===\n", "hybrid": "\n=== HYBRID CONTEXT (Vector + Graph) ===\n\n--- Most Relevant Entities ---\n"}
EDGE_HEAD = {"vector": "\n\n=== RELEVANT RELATIONSHIPS ===\n", "hybrid": "\n\n--- Key Relationships ---\n"}
CUT_MARK = "\n\n[... context truncated ...]"
