"""Code chunker: definitions with their comments, the header before them, and what lies between.

Python is parsed. The other languages are read by their definition lines and braces, which is an
approximation of a syntax tree: strings and comments are passed over, macros aren't expanded.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

from corpusgraph.operators.chunking.base import REGISTRY, ChunkError, Options, Part, Source, chunker, lines_of, size
from corpusgraph.operators.chunking.config import brace_end, with_comments


@dataclass(frozen=True)
class Language:
    """Definition lines by kind; groups: name, and optionally params and result."""

    functions: str
    types: str
    comments: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"|'(?:\\.|[^'\\\n]){1,4}'"
    above: str = r"(?://|/\*|\*|@|#\[|///|template)"


MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|async|export|default|declare|pub(?:\([^)]*\))?|unsafe|extern|const|inline|virtual|sealed|synchronized|native|override)\s+)*"
LANGUAGES = {
    "go": Language(r"func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)(?:\[[^\]]*\])?\s*\((?P<params>[^)]*)\)(?P<result>[^{\n]*)", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?:struct|interface)", strings=r"|`[^`]*`|'(?:\\.|[^'\\])+'"),
    "javascript": Language(MODS + r"(?:function\s*\*?\s*(?P<name>\w+)\s*\((?P<params>[^)]*)\)|(?:const|let|var)\s+(?P<name2>\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>))", MODS + r"class\s+(?P<name>\w+)(?:\s+extends\s+(?P<parent>[\w.]+))?", strings=r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "typescript": Language(MODS + r"(?:function\s*\*?\s*(?P<name>\w+)\s*(?:<[^>]*>)?\((?P<params>[^)]*)\)(?:\s*:\s*(?P<result>[^{\n]+))?|(?:const|let|var)\s+(?P<name2>\w+)[^=\n]*=\s*(?:async\s*)?(?:function\b|\([^)]*\)[^=\n]*=>|\w+\s*=>))", MODS + r"(?:class|interface|enum|namespace|type)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\s+extends\s+(?P<parent>[\w.]+))?(?:\s+implements\s+(?P<impl>[\w., ]+))?", strings=r"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "java": Language(MODS + r"(?:<[^>]+>\s*)?(?P<result>[\w<>\[\], ?.]+?)\s+(?P<name>\w+)\s*\((?P<params>[^)]*)\)[^;{]*(?=\{)", MODS + r"(?:class|interface|enum|record|@interface)\s+(?P<name>\w+)(?:<[^>]*>)?(?:\([^)]*\))?(?:\s+extends\s+(?P<parent>[\w.<>]+))?(?:\s+implements\s+(?P<impl>[\w.<>, ]+))?"),
    "rust": Language(MODS + r"fn\s+(?P<name>\w+)(?:<[^>]*>)?\s*\((?P<params>[^)]*)\)(?:\s*->\s*(?P<result>[^{;]+))?", MODS + r"(?:struct|enum|trait|union|mod|impl(?:<[^>]*>)?(?:\s+[\w:<>, ]+\s+for)?|macro_rules!)\s+(?P<name>\w+)"),
    "c": Language(r"(?!(?:if|for|while|switch|return|else|typedef|struct|enum|union)\b)(?P<result>[A-Za-z_][\w\s*]*?[\s*])(?P<name>\w+)\s*\((?P<params>[^;{)]*)\)\s*(?=\{)", r"(?:typedef\s+)?(?:struct|enum|union)\s+(?P<name>\w+)?\s*(?=\{)", above=r"(?://|/\*|\*)"),
    "cpp": Language(r"(?!(?:if|for|while|switch|return|else|typedef|struct|enum|union|class|namespace)\b)(?P<result>[A-Za-z_][\w\s*&:<>,]*?[\s*&])(?P<name>[\w:~]+)\s*\((?P<params>[^;{)]*)\)[^;{]*(?=\{)", r"(?:template\s*<[^>]*>\s*)?(?:class|struct|enum(?:\s+class)?|union|namespace)\s+(?P<name>\w+)?(?:\s*:\s*(?:public|private|protected)?\s*(?P<parent>[\w:]+))?[^;{]*(?=\{)"),
}


def visibility(name: str, line: str, language: str) -> str:
    if language == "go":
        return "public" if name[:1].isupper() else "private"
    if language == "rust":
        return "public" if "pub" in line.split() or line.lstrip().startswith("pub") else "private"
    if language == "python":
        return "private" if name.startswith("_") and not name.endswith("__") else "public"
    return next((v for v in ("private", "protected") if re.search(rf"\b{v}\b", line)), "public")


def braces(text: str, language: str) -> list[tuple[int, int, dict]]:
    """(start, end, metadata) of the outermost definitions."""
    rules = LANGUAGES[language]
    found, at = [], 0
    hidden = [m.span() for m in re.finditer(rf'"(?:\\.|[^"\\\n])*"|{rules.comments}{rules.strings}', text, re.DOTALL)]
    k = 0
    for m in re.finditer(rf"^[ \t]*(?:(?P<type_>(?P<typed>{_renamed(rules.types, 't_')}))|(?P<func_>{rules.functions}))", text, re.MULTILINE):
        start = m.start() + len(m[0]) - len(m[0].lstrip())
        while k < len(hidden) and hidden[k][1] <= start:
            k += 1
        if start < at or (k < len(hidden) and hidden[k][0] <= start):
            continue
        g = {a: b for a, b in m.groupdict().items() if b is not None}
        is_type = "type_" in g
        semi, brace = text.find(";", m.end()), text.find("{", m.end())
        if brace < 0 or (0 <= semi < brace and not is_type) or (is_type and 0 <= semi < brace and "\n\n" not in text[m.end() : semi] and language in ("rust", "typescript", "c", "cpp")):
            end = text.find("\n", semi if semi >= 0 else m.end())
            end = len(text) if end < 0 else end + 1
            if not is_type and "=>" not in m[0]:
                continue
        else:
            try:
                end = brace_end(text, m.end(), rules.comments, rules.strings)
            except ChunkError:
                end = len(text)
            tail = re.match(r"[^\S\n]*[\w*, ]*;?[^\S\n]*\n?", text[end:])
            end += tail.end() if tail else 0
        line = m[0].strip()
        name = g.get("t_name") if is_type else g.get("name") or g.get("name2")
        params = [p.strip() for p in re.split(r",(?![^<(\[]*[>)\]])", g.get("params", "")) if p.strip()]
        meta = {
            "language": language, "signature": " ".join(line.split()), "visibility": visibility(name or "", line, language), "is_async": "async" in line.split("(")[0].split(), "is_static": "static" in line.split("(")[0].split(),
            "is_exported": "export" in line.split() or (language == "go" and (name or "")[:1].isupper()), "is_generator": "function*" in line.replace(" ", ""),
        }
        if is_type:
            meta |= {"class_name": name, "parent_class": g.get("t_parent"), "implements": [x.strip() for x in g.get("t_impl", "").split(",") if x.strip()]}
        else:
            receiver = re.sub(r"[*\s]", " ", g.get("recv", "")).split()
            meta |= {"function_name": name, "parameters": params, "return_type": (g.get("result") or "").strip() or None, "class_name": receiver[-1] if receiver else None}
        found.append((max(at, with_comments(text, m.start(), rules.above)), end, meta))
        at = end
    return found


def _renamed(pattern: str, prefix: str) -> str:
    return re.sub(r"\(\?P<(\w+)>", lambda m: f"(?P<{prefix}{m[1]}>", pattern)


def python(text: str) -> list[tuple[int, int, dict]]:
    """(start, end, metadata) of top-level functions and classes, decorators included."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError) as x:
        raise ChunkError(f"PARSE_ERROR {x}") from x
    lines = lines_of(text)
    out = []
    for node in tree.body:
        if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            continue
        first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
        start, end = with_comments(text, lines[first - 1].start, "#"), lines[min(node.end_lineno, len(lines)) - 1].end
        meta = {"language": "python", "decorators": [ast.unparse(d) for d in node.decorator_list], "docstring": ast.get_docstring(node), "visibility": visibility(node.name, "", "python"), "is_async": isinstance(node, ast.AsyncFunctionDef)}
        if isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            meta |= {"class_name": node.name, "parent_class": bases[0] if bases else None, "implements": bases[1:], "signature": f"class {node.name}({', '.join(bases)})" if bases else f"class {node.name}"}
        else:
            result = ast.unparse(node.returns) if node.returns else None
            meta |= {"function_name": node.name, "parameters": [a.arg for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]], "return_type": result, "signature": f"def {node.name}({ast.unparse(node.args)})" + (f" -> {result}" if result else ""), "is_generator": any(isinstance(x, ast.Yield | ast.YieldFrom) for x in ast.walk(node))}
        out.append((start, end, meta))
    return out


BY_MIME = {
    "text/x-go": "go", "text/x-python": "python", "text/javascript": "javascript", "application/javascript": "javascript", "text/typescript": "typescript", "text/x-java": "java", "text/x-rust": "rust",
    "text/x-c": "c", "text/x-c++": "cpp", "text/x-c-header": "c", "text/x-c++-header": "cpp", "text/javascript-jsx": "javascript", "text/typescript-jsx": "typescript",
}
BY_SUFFIX = {".go": "go", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp"}


#: Strategies of further languages: functions of a text that give (start, end, metadata) of its outermost definitions.
STRATEGIES: dict[str, Callable[[str], list[tuple[int, int, dict]]]] = {"python": python}


def register_language(name: str, find: Callable[[str], list[tuple[int, int, dict]]] | Language, mimes: str = "", suffixes: str = "") -> None:
    """Adds a language, or another strategy for a known one: a function, or the patterns of its definition lines."""
    if isinstance(find, Language):
        LANGUAGES[name] = find
        STRATEGIES.pop(name, None)
    else:
        STRATEGIES[name] = find
    BY_MIME.update({m: name for m in mimes.split()})
    BY_SUFFIX.update({s: name for s in suffixes.split()})
    REGISTRY.replace("code", mimes=frozenset(BY_MIME), suffixes=tuple(BY_SUFFIX), languages=frozenset([*LANGUAGES, *STRATEGIES]))


def language_of(source: Source) -> str | None:
    """By type, then language name, then extension."""
    suffix = "." + source.path.lower().rsplit(".", 1)[-1] if "." in source.path else ""
    named = source.language.lower()
    return BY_MIME.get(source.mime.lower()) or (named if named in LANGUAGES or named in STRATEGIES else None) or BY_SUFFIX.get(suffix)


@chunker("code", 100, mimes=" ".join(BY_MIME), suffixes=" ".join(BY_SUFFIX), languages=" ".join([*LANGUAGES, "python"]))
def code(source: Source, options: Options) -> list[Part]:
    """A part per outermost definition; the rest of the file in parts without a name. Large ones are cut at lines."""
    text, language = source.text, language_of(source)
    found = STRATEGIES[language](text) if language in STRATEGIES else braces(text, language)
    starts = [x.start for x in lines_of(text)]
    line = lambda k: bisect_right(starts, k)
    parts, at = [], 0
    for start, end, meta in [*found, (len(text), len(text), None)]:
        if text[at:start].strip():
            parts.append(Part(at, start, "code", {"code": {"language": language, "line_start": line(at), "line_end": line(max(at, start - 1))}}))
        if meta is not None:
            parts.append(Part(max(at, start), end, "code", {"code": meta | {"line_start": line(start), "line_end": line(max(start, end - 1))}}))
        at = max(at, end)
    if not found and size(text) <= options.max_size:
        return [Part(0, len(text), "code", {"code": {"language": language, "line_start": 1, "line_end": len(starts)}})]
    return parts
