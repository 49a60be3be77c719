"""Column functions over text, and the fixed rules that they follow."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented small letters and what they are folded to.
ACCENTED, FOLDED = "àáâãäåāăąçćčďèéêëēėęěìíîïīłñńňòóôõöøōőřśšťùúûüūůűýÿźżž", "aaaaaaaaacccdeeeeeeeeiiiiilnnnoooooooorsstuuuuuuuyyzzz"
NOT_WORD = "[^\\p{L}\\p{N}]+"


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits without their accents, in order."""
    return F.array_remove(F.split(F.translate(F.lower(text), ACCENTED, FOLDED), NOT_WORD), "")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters: the count used where no tokenizer is given."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def sanitised_query(text: Column) -> Column:
    """A full-text query without operators: ?()&| give way to spaces, quotes
    are doubled, * and : go at both ends, and blanks are collapsed."""
    flat = F.replace(F.translate(text, "?()&|", "     "), F.lit('"'), F.lit('""'))
    return F.trim(F.regexp_replace(F.regexp_replace(flat, "^[*:]+|[*:]+$", ""), "\\s+", " "))


def overlap(wanted: Column, present: Column) -> Column:
    """Share of the distinct wanted words that are present."""
    return F.size(F.array_intersect(wanted, present)) / F.greatest(F.size(F.array_distinct(wanted)), F.lit(1))


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


# Words and phrases of the query-complexity rule.
QUESTION_WORDS = ["how", "why", "what", "when", "where", "which", "explain"]
TECHNICAL_WORDS = ["implement", "architecture", "design", "pattern", "refactor", "optimize", "debug", "trace", "flow"]


def query_complexity(text: Column) -> Column:
    """0 to 1: length, question words, several parts, technical words, negation."""
    low = F.lower(text)
    words = F.filter(F.split(low, "\\s+"), lambda w: w != "")
    n = F.size(words)
    score = (
        F.when(n > 10, 0.3).when(n > 5, 0.1).otherwise(0.0)
        + F.when(F.arrays_overlap(words, F.array(*map(F.lit, QUESTION_WORDS))), 0.2).otherwise(0.0)
        + F.when(F.contains(low, F.lit(" and ")) | F.contains(low, F.lit(",")), 0.2).otherwise(0.0)
        + F.when(any_of(low, TECHNICAL_WORDS), 0.2).otherwise(0.0)
        + F.when(any_of(low, [" not ", "without"]), 0.1).otherwise(0.0)
    )
    return F.least(F.lit(1.0), score)


# Phrases that refer to an earlier part of a conversation.
CONTINUATIONS = [
    "that (?:function|class|file|code|method|module) (?:we|from|i|you|earlier)",
    "the (?:function|class|file|code|method|module) from (?:before|earlier)",
    "what was (?:that|the) .+",
    "continue with .+",
    "back to (?:the|that) .+",
    "as we discussed",
    "remember (?:when|that|the)",
    "like (?:we|i) (?:mentioned|said|discussed)",
    "the (?:thing|stuff|code) (?:we|i) (?:were|was) (?:working on|looking at)",
    "earlier (?:we|i|you)",
    "(?:that|the) (?:same|previous) .+",
]


def is_continuation(text: Column) -> Column:
    return F.lower(text).rlike("|".join(CONTINUATIONS))


# Name patterns of entities in a query, with the group that holds the name.
ENTITIES = [("\\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\\b", 1), ("\\b([a-z]+(?:_[a-z]+)+)\\b", 1), ("`([^`]+)`", 1), ('"([^"]+)"', 1), ("'([^']+)'", 1)]


def entities(text: Column) -> Column:
    """Names in a query, in the order of the patterns, first spelling kept."""
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(g)) for p, g in ENTITIES])
    low = F.transform(found, lambda x: F.lower(x))
    return F.filter(found, lambda x, i: (F.array_position(low, F.lower(x)) == i + 1) & (x != ""))


# Language by file extension.
LANGUAGES = {
    "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "go": "go", "rs": "rust",
    "java": "java", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "md": "markdown", "json": "json", "yaml": "yaml",
    "yml": "yaml", "toml": "toml", "sql": "sql", "sh": "shell", "html": "html", "css": "css", "rb": "ruby", "php": "php",
}


def language(path: Column, default: str | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    found = F.element_at(known, F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1)))
    return found if default is None else F.coalesce(found, F.lit(default))


# Kinds of files in order of precedence, by parts of the name and by folders above.
FILE_KINDS = [
    ("test", ["test", "spec"], ["tests", "__tests__"]),
    ("fe_component", [], ["components", "pages", "views", "screens"]),
    ("fe_client", ["client"], ["api"]),
    ("be_handler", [], ["handlers", "controllers", "routes"]),
    ("contract", ["contract", "interface"], ["types"]),
    ("shared_type", [], ["shared", "common"]),
    ("endpoint", ["endpoint", "route"], []),
]


def node_type(path: Column) -> Column:
    """What a file is by ``FILE_KINDS``: the first kind that fits, else ``file``."""
    parts = F.split(F.lower(path), "/")
    name = F.element_at(parts, -1)
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.array(*map(F.lit, n)).cast("array<string>").alias("names"), F.array(*map(F.lit, f)).cast("array<string>").alias("folders")) for k, n, f in FILE_KINDS])
    fits = F.filter(kinds, lambda x: F.exists(x["names"], lambda p: F.contains(name, p)) | F.arrays_overlap(parts, x["folders"]))
    return F.coalesce(F.get(fits, F.lit(0))["kind"], F.lit("file"))


# Import statements by language, with the group that holds the name.
IMPORTS = {
    "python": "(?m)^(?:from|import)\\s+([\\w.]+)",
    "typescript": "(?:import|from)\\s+['\"](\\.[^'\"]*)['\"]",
    "javascript": "(?:import|from)\\s+['\"](\\.[^'\"]*)['\"]",
    "go": '"([^"/]*/[^"]*)"',
    "rust": "(?m)^use\\s+([\\w:]+)",
}


def imports(content: Column, lang: Column) -> Column:
    """Imported paths of a file, by its language."""
    out = F
    for name, pattern in IMPORTS.items():
        found = F.regexp_extract_all(content, F.lit(pattern), F.lit(1))
        if name == "python":
            found = F.transform(found, lambda x: F.concat(F.replace(x, F.lit("."), F.lit("/")), F.lit(".py")))
        if name == "rust":
            found = F.transform(found, lambda x: F.concat(F.replace(x, F.lit("::"), F.lit("/")), F.lit(".rs")))
        out = out.when(lang == name, found)
    return out.otherwise(F.array().cast("array<string>"))


# Marks of interfaces and types, by language (confidence 0.9) and for all (0.6).
CONTRACTS: dict[str, dict[str, list[str]]] = {
    "python": {
        "abstract_class": ["class\\s+\\w+\\s*\\([^)]*ABC[^)]*\\)", "@abstractmethod", "from\\s+abc\\s+import"],
        "protocol": ["class\\s+\\w+\\s*\\([^)]*Protocol[^)]*\\)", "typing\\.Protocol", "typing_extensions\\.Protocol"],
        "dataclass": ["@dataclass", "@dataclasses\\.dataclass"],
        "type_alias": [":\\s*TypeAlias\\s*=", "=\\s*TypeVar\\s*\\(", "=\\s*NewType\\s*\\("],
        "schema": ["class\\s+\\w+\\s*\\([^)]*BaseModel[^)]*\\)", "class\\s+\\w+\\s*\\([^)]*Schema[^)]*\\)", "@schema"],
        "enum": ["class\\s+\\w+\\s*\\([^)]*Enum[^)]*\\)"],
    },
    "typescript": {
        "interface": ["(?m)^\\s*(?:export\\s+)?interface\\s+\\w+"],
        "type_alias": ["(?m)^\\s*(?:export\\s+)?type\\s+\\w+\\s*="],
        "abstract_class": ["(?m)^\\s*(?:export\\s+)?abstract\\s+class\\s+\\w+"],
        "enum": ["(?m)^\\s*(?:export\\s+)?(?:const\\s+)?enum\\s+\\w+"],
    },
    "go": {"interface": ["(?m)^\\s*type\\s+\\w+\\s+interface\\s*\\{"], "struct": ["(?m)^\\s*type\\s+\\w+\\s+struct\\s*\\{"]},
    "rust": {"trait": ["(?m)^\\s*(?:pub\\s+)?trait\\s+\\w+"], "struct": ["(?m)^\\s*(?:pub\\s+)?struct\\s+\\w+"], "enum": ["(?m)^\\s*(?:pub\\s+)?enum\\s+\\w+"]},
    "java": {"interface": ["(?m)^\\s*(?:public\\s+)?interface\\s+\\w+"], "abstract_class": ["(?m)^\\s*(?:public\\s+)?abstract\\s+class\\s+\\w+"], "enum": ["(?m)^\\s*(?:public\\s+)?enum\\s+\\w+"]},
}
CONTRACT_WORDS = ["interface", "abstract", "protocol", "trait", "contract", "schema", "typedef", "@api", "@public", "@export"]


def contract_matches(content: Column, lang: Column) -> Column:
    """Array of struct(contract_type, confidence) of all marks found."""
    found = []
    for name, kinds in CONTRACTS.items():
        for kind, patterns in kinds.items():
            hit = (lang == name) & reduce(lambda a, b: a | b, [content.rlike(p) for p in patterns])
            found.append(F.when(hit, F.struct(F.lit(kind).alias("contract_type"), F.lit(0.9).alias("confidence"))))
    low = F.lower(content)
    for word in CONTRACT_WORDS:
        found.append(F.when(F.contains(low, F.lit(word)), F.struct(F.lit("unknown").alias("contract_type"), F.lit(0.6).alias("confidence"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


# Base types by language, with the group that holds the names.
BASES = {
    "python": ["class\\s+\\w+\\s*\\(([^)]+)\\)"],
    "typescript": ["extends\\s+([\\w,\\s]+)", "implements\\s+([\\w,\\s]+)"],
    "javascript": ["extends\\s+(\\w+)"],
    "java": ["extends\\s+(\\w+)", "implements\\s+([\\w,\\s]+)"],
    "go": ["//\\s*implements:\\s*([\\w,\\s]+)"],
    "rust": ["impl\\s+(\\w+)\\s+for"],
}


def contract_dependencies(content: Column, lang: Column) -> Column:
    """Distinct base types that a contract names, in order."""
    out = F
    for name, patterns in BASES.items():
        found = F.concat(*[F.regexp_extract_all(content, F.lit(p), F.lit(1)) for p in patterns])
        names = F.flatten(F.transform(found, lambda x: F.transform(F.split(x, ","), lambda y: F.trim(F.regexp_replace(y, "\\s+", " ")))))
        out = out.when(lang == name, F.array_distinct(F.filter(names, lambda y: (y != "") & (y != "object"))))
    return out.otherwise(F.array().cast("array<string>"))


# Forms of ledger entries: type, pattern, confidence.
LEDGER_LINES = [
    ("todo", "(?m)^[-*][ \\t]*\\[ \\][ \\t]*(\\S.*)$", 0.9),
    ("decision", "(?m)^DECISION:[ \\t]*(\\S.*)$", 0.95),
    ("todo", "(?m)^TODO:[ \\t]*(\\S.*)$", 0.95),
    ("question", "(?m)^QUESTION:[ \\t]*(\\S.*)$", 0.95),
]
LEDGER_BLOCK = "(?im)^Ledger:[ \\t]*\\n((?:[-*][ \\t]+.+\\n?)+)"
LEDGER_SECTIONS = [("decision", "decisions?"), ("todo", "todos?"), ("question", "(?:open\\s+)?questions?"), ("file", "files?\\s+touched")]


def _first_group(pattern: str, block: Column) -> Column:
    return F.regexp_extract(block, pattern, 1)


def _entry(kind: str, sure: float, content: Column) -> Column:
    return F.struct(F.lit(kind).alias("entry_type"), F.trim(content).alias("content"), F.lit(sure).alias("confidence"))


def ledger_entries(text: Column) -> Column:
    """Array of struct(entry_type, content, confidence): sections of ledger
    blocks, open task-list items, and lines with a prefix."""
    found = []
    blocks = F.regexp_extract_all(text, F.lit(LEDGER_BLOCK), F.lit(1))
    clean = lambda y: F.trim(F.regexp_replace(y, "^[\\s'\"\\[\\]]+|[\\s'\"\\[\\]]+$", ""))
    for kind, name in LEDGER_SECTIONS:
        pattern = f"(?i)[-*]\\s*{name}:\\s*\\[?([^\\]\\n]*)\\]?"
        first = F.transform(blocks, partial(_first_group, pattern))
        items = F.flatten(F.transform(first, lambda x: F.transform(F.split(x, ","), clean)))
        good = F.filter(items, lambda y: (y != "") & ~F.lower(y).isin("none", "n/a"))
        found.append(F.transform(good, partial(_entry, kind, 1.0)))
    for kind, pattern, sure in LEDGER_LINES:
        found.append(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), partial(_entry, kind, sure)))
    return F.concat(*found)


def ancestors(path: Column) -> Column:
    """All folders above a path."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(
        F.array().cast("array<string>")
    )


def command_type(name: Column) -> Column:
    """What a project command does, by its name; the first rule that fits."""
    low = F.lower(name)
    # Name parts by command type.
    rules = {"test": ["test", "spec", "jest", "pytest"], "build": ["build", "compile", "bundle"], "lint": ["lint", "eslint", "check"], "format": ["format", "prettier", "fmt"], "run": ["start", "dev", "serve", "run"]}
    out = F
    for kind, parts in rules.items():
        out = out.when(any_of(low, parts), kind)
    return out.otherwise("other")


def escaped_xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
