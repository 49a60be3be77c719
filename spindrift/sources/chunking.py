"""Files into chunks, symbols and references, in Arrow-batched Python."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import cut

# Chunk sizes in tokens.
LEAST, TARGET, MOST, OVERLAP = 200, 500, 1200, 50
#: Rows of a graph that a task holds at a time.
ROWS = 10_000
CHUNK = "chunk_id string, file_path string, content string, start_line int, end_line int, symbol_name string, symbol_type string, language string, token_count int"


def tokens(text: str) -> int:
    return len(text) // 4


def line_chunks(lines: list[str], first: int = 1, target: int = TARGET, overlap: int = OVERLAP) -> Iterator[tuple[int, int]]:
    """Line ranges of about ``target`` tokens, ended at a blank line, a line
    without indentation or a closed comment, or at twice the target."""
    start, size = 0, 0
    for i, line in enumerate(lines):
        size += tokens(line + "\n")
        following = lines[i + 1] if i + 1 < len(lines) else None
        rest = not line.strip() or following is None or not following.startswith((" ", "\t")) or line.rstrip().endswith("*/")
        if (size >= target and rest) or size >= 2 * target:
            yield first + start, first + i
            start, size = i + 1, 0
            while overlap and start > 0 and size + tokens(lines[start - 1]) <= overlap and start - 1 > i - 8 and tokens(lines[start - 1]):
                start -= 1
                size += tokens(lines[start])
    if start < len(lines) and any(x.strip() for x in lines[start:]):
        yield first + start, first + len(lines) - 1


# Starts of outer definitions where no parser is at hand.
STARTS = {
    "typescript": re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(class|interface|function|type|enum)\s+(\w+)"),
    "javascript": re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(class|function)\s+(\w+)"),
    "go": re.compile(r"^(func|type)\s+(?:\([^)]*\)\s*)?(\w+)"),
    "rust": re.compile(r"^(?:pub\s+)?(?:async\s+)?(fn|struct|trait|enum|impl)\s+(\w+)"),
    "java": re.compile(r"^(?:public\s+)?(?:abstract\s+)?(class|interface|enum)\s+(\w+)"),
}


def spans(content: str, language: str) -> list[tuple[int, int, str, str]]:
    """Outer definitions: first and last line, name, kind."""
    if language == "python":
        try:
            body = ast.parse(content).body
        except (SyntaxError, ValueError):
            return []
        kinds = {ast.ClassDef: "class_definition", ast.FunctionDef: "function_definition", ast.AsyncFunctionDef: "function_definition"}
        found = [(min([n.lineno, *(d.lineno for d in n.decorator_list)]), n.end_lineno, n.name, kinds[type(n)]) for n in body if type(n) in kinds]
        return found
    if language not in STARTS:
        return []
    lines, out, i = content.split("\n"), [], 0
    while i < len(lines):
        m = STARTS[language].match(lines[i])
        if not m:
            i += 1
            continue
        depth, j, opened = 0, i, False
        while j < len(lines):
            depth += lines[j].count("{") - lines[j].count("}")
            opened |= "{" in lines[j]
            if (opened and depth <= 0) or (not opened and lines[j].rstrip().endswith(";")):
                break
            j += 1
        j = min(j, len(lines) - 1)
        out.append((i + 1, j + 1, m[2], m[1]))
        i = j + 1
    return out


def chunk_file(path: str, content: str, language: str) -> list[tuple]:
    """Chunks of one file: definitions of fitting size, larger ones split, the
    header before the first; files without definitions by lines."""
    lines = content.split("\n")
    found = spans(content, language)
    ranges: list[tuple[int, int, str | None, str | None]] = []
    if not found:
        ranges = [(a, b, None, "text_block") for a, b in line_chunks(lines)]
    else:
        head = "\n".join(lines[: found[0][0] - 1])
        if tokens(head) >= LEAST:
            ranges.append((1, found[0][0] - 1, None, "module_header"))
        for a, b, name, kind in found:
            size = tokens("\n".join(lines[a - 1 : b]))
            if size > MOST:
                ranges += [(x, y, name, kind) for x, y in line_chunks(lines[a - 1 : b], a)]
            elif size >= LEAST:
                ranges.append((a, b, name, kind))
    out = []
    for a, b, name, kind in ranges:
        text = "\n".join(lines[a - 1 : b])
        body = hashlib.sha256(text.encode()).hexdigest()[:8]
        out.append((hashlib.sha256(f"{path}:{body}".encode()).hexdigest()[:16], path, text, a, b, name, kind, language, tokens(text)))
    return out


def chunks(files: DataFrame) -> DataFrame:
    """All chunks of ``files`` (file_path, content, language)."""

    def run(batches):
        import pandas as pd

        names = [c.split()[0] for c in CHUNK.split(", ")]
        for pdf in batches:
            rows = [r for f in pdf.itertuples(index=False) for r in chunk_file(f.file_path, f.content or "", f.language or "text")]
            yield pd.DataFrame(rows, columns=names)

    return files.select("file_path", "content", "language").mapInPandas(run, CHUNK).dropDuplicates(["chunk_id"])


# What a definition's first word makes it, and references by language.
KINDS = {"class": "class", "interface": "interface", "trait": "interface", "type": "type", "enum": "type", "struct": "type", "impl": "type", "function": "function", "func": "function", "fn": "function"}
BASES = re.compile(r"\b(extends|implements)\s+([\w,\s]+?)\s*(?=\{|\bimplements\b|$)", re.M)
IMPORTED = {
    "typescript": re.compile(r"import\s+(?:type\s+)?\{([^}]*)\}|import\s+(\w+)\s+from"), "javascript": re.compile(r"import\s+\{([^}]*)\}|import\s+(\w+)\s+from"),
    "go": re.compile(r'^\s*(?:import\s+)?"[^"]*?([\w-]+)"', re.M), "rust": re.compile(r"^use\s+[\w:]*?(?:\{([^}]*)\}|(\w+));", re.M), "java": re.compile(r"^import\s+[\w.]*?(\w+);", re.M),
}
CALL = re.compile(r"\b(\w+)\s*\(")
NO_CALLS = {"if", "for", "while", "switch", "match", "return", "catch", "func", "fn", "function", "class", "interface", "type", "enum", "struct", "trait", "impl", "new", "super", "constructor"}


def graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of code files: files, classes, functions, methods,
    interfaces and types, what they contain, import, call, inherit and
    implement. Python is parsed, other languages go by the forms of their outer
    definitions. References are resolved in a join over all symbols, so the
    order of files does not matter."""
    kinds = [pa.string()] * 6 + [pa.int32()] * 2
    names = ["kind", "src", "name", "node_id", "node_type", "file_path", "start_line", "end_line"]
    table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # one file's text and tree at a time; what was found of the others leaves the task as it grows
        rows: list[tuple] = []
        for batch in batches:
            for path, content, language in zip(*batch.columns, strict=True):
                path, content, language = path.as_py(), content.as_py() or "", language.as_py()
                rows += _file_graph(path, content) if language == "python" else _outline_graph(path, content, language)
                if len(rows) >= ROWS:
                    yield table(rows)
                    rows.clear()
        if rows:
            yield table(rows)

    rows = files.where(F.col("language").isin("python", *STARTS)).select("file_path", "content", "language")
    # each file is parsed once, for its nodes, what they contain and what they refer to
    rows = cut(rows.mapInArrow(run, "kind string, src string, name string, node_id string, node_type string, file_path string, start_line int, end_line int"))
    nodes = rows.where("kind = 'node'").select("node_id", "node_type", "name", "file_path", "start_line", "end_line")
    from ..operators.graph import resolved

    symbols = nodes.where("node_type <> 'file'").withColumn("name", F.element_at(F.split("name", "\\."), -1))
    contains = rows.where("kind = 'CONTAINS'").select("src", F.col("node_id").alias("dst"), F.lit("CONTAINS").alias("edge_type"))
    refs = rows.where("kind IN ('CALLS', 'IMPORTS', 'INHERITS', 'IMPLEMENTS')").select("src", "name", "file_path", F.col("kind").alias("edge_type"))
    found = resolved(refs, symbols).where("src <> dst").select("src", "dst", "edge_type").distinct()
    return nodes, contains.unionByName(found)


def _outline_graph(path: str, content: str, language: str) -> list[tuple]:
    """Nodes and references of a file by the forms of its outer definitions."""
    file_id = f"file:{path}"
    lines = content.split("\n")
    rows = [("node", None, path, file_id, "file", path, 1, len(lines))]
    if language in IMPORTED:
        for found in IMPORTED[language].finditer(content):
            for name in re.findall(r"\w+", " ".join(x for x in found.groups() if x)):
                rows.append(("IMPORTS", file_id, name, None, None, path, 1, 1))
    for first, last, name, word in spans(content, language):
        kind = KINDS[word]
        if language == "go" and kind == "type":
            kind = "interface" if re.search(r"\binterface\b", lines[first - 1]) else "type"
        node = f"{kind}:{path}:{name}"
        body = "\n".join(lines[first - 1 : last])
        rows.append(("node", None, name, node, kind, path, first, last))
        if kind not in ("interface", "type"):
            rows.append(("CONTAINS", file_id, None, node, None, path, first, first))
        for how, bases in BASES.findall(lines[first - 1]):
            edge = "INHERITS" if how == "extends" else "IMPLEMENTS"
            rows += [(edge, node, base, None, None, path, first, first) for base in re.findall(r"\w+", bases)]
        if kind in ("function", "class"):
            called = dict.fromkeys(c for c in CALL.findall(body) if c not in NO_CALLS and c != name)
            rows += [("CALLS", node, c, None, None, path, first, first) for c in called]
    return rows


def _file_graph(path: str, content: str) -> list[tuple]:
    try:
        module = ast.parse(content)
    except (SyntaxError, ValueError):
        return []
    file_id = f"file:{path}"
    rows = [("node", None, path, file_id, "file", path, 1, content.count("\n") + 1)]

    def refs(owner: str, node: ast.AST) -> None:
        for x in ast.walk(node):
            if isinstance(x, ast.Call):
                f = x.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    rows.append(("CALLS", owner, name, None, None, path, x.lineno, x.lineno))

    for n in module.body:
        if isinstance(n, ast.Import | ast.ImportFrom):
            for a in n.names:
                rows.append(("IMPORTS", file_id, a.name.split(".")[-1], None, None, path, n.lineno, n.lineno))
        elif isinstance(n, ast.ClassDef):
            cid = f"class:{path}:{n.name}"
            rows += [("node", None, n.name, cid, "class", path, n.lineno, n.end_lineno), ("CONTAINS", file_id, None, cid, None, path, n.lineno, n.lineno)]
            for b in n.bases:
                name = b.id if isinstance(b, ast.Name) else b.attr if isinstance(b, ast.Attribute) else None
                if name:
                    rows.append(("INHERITS", cid, name, None, None, path, n.lineno, n.lineno))
            for m in n.body:
                if isinstance(m, ast.FunctionDef | ast.AsyncFunctionDef):
                    mid = f"method:{path}:{n.name}.{m.name}"
                    rows += [("node", None, f"{n.name}.{m.name}", mid, "method", path, m.lineno, m.end_lineno), ("CONTAINS", cid, None, mid, None, path, m.lineno, m.lineno)]
                    refs(mid, m)
        elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
            fid = f"function:{path}:{n.name}"
            rows += [("node", None, n.name, fid, "function", path, n.lineno, n.end_lineno), ("CONTAINS", file_id, None, fid, None, path, n.lineno, n.lineno)]
            refs(fid, n)
        else:
            refs(file_id, n)
    return rows
