"""Column functions over code, tasks, prompts and sizes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import CONTRACT_WORDS, CONTRACTS, any_of, token_estimate

#: A contract's signature has so many lines at most.
SIGNATURE_LINES = 6
# Fixed value: default weight of a sure contract.
BOOST = 1.5


def _first(array: Column, holds) -> Column:
    """Index (from 1) of the first element for which a condition holds, or null."""
    return F.get(F.filter(F.transform(array, lambda x, i: F.when(holds(x), i + 1)), lambda i: i.isNotNull()), F.lit(0))


def _let(value: Column, body) -> Column:
    """A body over a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def signature(content: Column, lang: Column) -> Column:
    """The first lines of code, comments left out in front, up to an opening
    brace or (Python) a colon at a line's end."""
    is_code = lambda x: ~F.trim(x).rlike(r"^\s*($|#|//|/\*|\*)")
    ends = lambda x: F.contains(x, F.lit("{")) | ((lang == "python") & x.rlike(r":\s*$"))
    # code begins among the first lines as a rule: the others are looked at where it does not
    start = lambda lines: F.coalesce(_first(F.slice(lines, 1, 8), is_code), _first(lines, is_code))
    until = lambda rest: F.array_join(F.slice(rest, F.lit(1), F.coalesce(_first(rest, ends), F.lit(SIGNATURE_LINES))), "\n")
    taken = lambda lines: _let(start(lines), lambda at: F.when(at.isNotNull(), _let(F.slice(lines, F.coalesce(at, F.lit(1)), SIGNATURE_LINES), until)))
    return F.regexp_replace(_let(F.split(content, "\n"), taken), r"^\s+|\s+$", "")


def contract_id(file_path: Column, symbol_name: Column, start_line: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", file_path, F.coalesce(symbol_name, F.lit("")), start_line.cast("string")), 256), 1, 16)


def best_contract(content: Column, lang: Column) -> Column:
    """The surest mark (struct contract_type, confidence), the first of equals; null
    without one. A language's own marks are surer than words: none is looked for
    once one is found."""
    out = F
    for name, kinds in CONTRACTS.items():
        for kind, patterns in kinds.items():
            hit = (lang == name) & reduce(lambda a, b: a | b, [content.rlike(p) for p in patterns])
            out = out.when(hit, F.struct(F.lit(kind).alias("contract_type"), F.lit(0.9).alias("confidence")))
    return out.when(any_of(F.lower(content), CONTRACT_WORDS), F.struct(F.lit("unknown").alias("contract_type"), F.lit(0.6).alias("confidence")))


def contract_boost(content: Column, lang: Column, is_contract: Column, boost: float = BOOST) -> Column:
    """1 + (boost - 1) * confidence for contracts, else 1."""
    sure = best_contract(content, lang)["confidence"]
    return F.when(is_contract & sure.isNotNull(), 1 + (boost - 1) * sure).otherwise(1.0)


# Definitions and names in code, each with the name as its group.
SYMBOLS = [r"\bclass\s+(\w+)", r"\bdef\s+(\w+)", r"\bfunction\s+(\w+)", r"\basync\s+(?:def|function)\s+(\w+)", r"\b(?:type|interface)\s+(\w+)", r"\bstruct\s+(\w+)", r"\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b"]


def symbols(code: Column) -> Column:
    """Distinct names that a piece of code defines or spells in CamelCase."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in SYMBOLS]))


# Task types by their phrases, and words that are no keywords.
TASKS = {"aggregation": ["find all", "list all", "every", "across"], "impact": ["impact", "affect", "dependency", "trace"], "comparison": ["compare", "diff", "difference"], "summarization": ["summarize", "overview", "understand"]}
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might must shall can need dare ought used to of in for on with at by from as into "
    "through during before after above below between under again further then once all any both each few more most other some such only own same so than too very just also now find list show get"
).split()


def task_analysis(task: Column) -> Column:
    """struct(task_type, keywords, complexity, task_tokens)."""
    low, n = F.lower(task), token_estimate(task)
    kind = F
    for name, parts in TASKS.items():
        kind = kind.when(any_of(low, parts), name)
    words = F.regexp_extract_all(task, F.lit(r"\b[a-zA-Z][a-zA-Z_]+\b"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    keywords = F.slice(F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w))), 1, 10)
    complexity = F.when((n > 200) | F.contains(low, F.lit("comprehensive")), "high").when(n > 50, "medium").otherwise("low")
    return F.struct(kind.otherwise("exploration").alias("task_type"), keywords.alias("keywords"), complexity.alias("complexity"), n.alias("task_tokens"))


# Phrases of audits and of interfaces.
AUDITS = ["all usages", "every instance", "audit", "find all", "list all", "comprehensive", "throughout", "across the repo", "everywhere"]
INTERFACES = ["interface", "contract", "schema", "api", "type", "endpoint", "protocol", "specification", "definition"]


def audit_gate(query: Column, entropy: Column, explicit: Column, threshold: float = 2.5) -> Column:
    """struct(mode, reason, confidence): an explicit mode, an audit's phrase, or
    the raw entropy against the threshold."""
    given = explicit.isNotNull() & ~explicit.isin("", "auto")
    audit = any_of(F.lower(query), AUDITS)
    high = entropy >= threshold
    mode = F.when(given, explicit).when(audit | high, "rlm").otherwise("pack")
    reason = F.when(given, "explicit").when(audit, "audit").when(high, "high_entropy").otherwise("low_entropy")
    sure = F.when(given, 1.0).when(audit, 0.9).otherwise(F.least(F.lit(1.0), F.abs(entropy - threshold) / threshold + 0.5))
    return F.struct(mode.alias("mode"), reason.alias("reason"), sure.alias("confidence"))


def touches_contract(query: Column) -> Column:
    return any_of(F.lower(query), INTERFACES)


def truncated(text: Column, most_tokens: int, suffix: str = "\n... [truncated]") -> Column:
    """struct(text, cut): a text within a number of tokens (a quarter of its characters), the suffix included."""
    room = max(0, most_tokens - len(suffix) // 4)
    long = token_estimate(text) > most_tokens
    return F.struct(F.when(long, F.concat(F.substring(text, 1, 4 * room), F.lit(suffix))).otherwise(text).alias("text"), long.alias("cut"))


def within_tokens(fields: dict[str, Column], soft: int = 8000, hard: int = 25000, keep: int = 5) -> dict[str, Column]:
    """List fields of a response, in order: each gives up its tail once the
    tokens so far pass ``soft``; past ``hard`` the first ``keep`` items stay."""
    size = lambda items: F.aggregate(items, F.lit(0).cast("long"), lambda a, x: a + token_estimate(x))
    total = sum((size(c) for c in fields.values()), F.lit(0).cast("long"))
    before, out = F.lit(0).cast("long"), {}
    for name, items in fields.items():
        fits = _fitting(items, before, size, soft)
        out[name] = F.when(total > hard, F.slice(items, 1, keep)).when(total > soft, fits).otherwise(items)
        before = before + size(items)
    return out


def _fitting(items: Column, before: Column, size, most: int) -> Column:
    """The items up to which the tokens, with those ``before``, stay within ``most``."""
    sums = F.transform(items, lambda x, i: F.struct(x.alias("x"), (before + size(F.slice(items, F.lit(1), i + 1))).alias("n")))
    return F.transform(F.filter(sums, lambda x: x["n"] <= most), lambda x: x["x"])


def readable_size(size: Column) -> Column:
    """Bytes with one digit and a unit."""
    out, units = F, ["B", "KB", "MB", "GB"]
    for n, unit in enumerate(units):
        out = out.when(size < 1024 ** (n + 1), F.concat(F.format_string("%.1f", F.bround(size / 1024**n, 1)), F.lit(f" {unit}")))
    return out.otherwise(F.concat(F.format_string("%.1f", F.bround(size / 1024**4, 1)), F.lit(" TB")))


def readable_duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60).cast("long")
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds.cast("double")), F.lit("s")))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m "), F.format_string("%.1f", (seconds - 60 * minutes).cast("double")), F.lit("s")))
        .otherwise(F.concat(F.floor(minutes / 60).cast("string"), F.lit("h "), (minutes % 60).cast("string"), F.lit("m")))
    )


# Project types by the first of these files that is there.
PROJECTS = [("package.json", "Node.js"), ("pyproject.toml", "Python"), ("Cargo.toml", "Rust"), ("go.mod", "Go")]


def project_type(names: Column) -> Column:
    """What kind of project the file names of a folder show; null if none does."""
    out = F
    for file, kind in PROJECTS:
        out = out.when(F.array_contains(names, file), kind)
    return out
