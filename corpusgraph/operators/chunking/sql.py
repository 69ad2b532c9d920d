"""SQL chunker: statements, grouped by the table that they are about."""

from __future__ import annotations

import re

from corpusgraph.functions.text import DIALECTS
from corpusgraph.operators.chunking.base import Options, Part, Source, chunker

NAME = r"([\"`\[]?[\w.$]+[\"`\]]?(?:\.[\"`\[]?[\w$]+[\"`\]]?)*)"
OPT = r"(?:OR\s+(?:REPLACE|ALTER)\s+)?(?:TEMP(?:ORARY)?\s+|UNIQUE\s+|MATERIALIZED\s+|GLOBAL\s+|LOCAL\s+)*"
IF = r"(?:IF\s+(?:NOT\s+)?EXISTS\s+)?"
#: (statement, object, pattern, group of the table, group of the routine)
STATEMENTS = [
    ("CREATE", "TABLE", rf"CREATE\s+{OPT}TABLE\s+{IF}{NAME}", 1, 0),
    ("ALTER", "TABLE", rf"ALTER\s+TABLE\s+{IF}(?:ONLY\s+)?{NAME}", 1, 0),
    ("DROP", "TABLE", rf"DROP\s+TABLE\s+{IF}{NAME}", 1, 0),
    ("CREATE", "INDEX", rf"CREATE\s+{OPT}INDEX\s+(?:CONCURRENTLY\s+)?{IF}{NAME}\s+ON\s+{NAME}", 2, 0),
    ("CREATE", "VIEW", rf"CREATE\s+{OPT}VIEW\s+{IF}{NAME}", 1, 0),
    ("CREATE", "TRIGGER", rf"CREATE\s+{OPT}TRIGGER\s+{IF}{NAME}\s+(?:BEFORE|AFTER|INSTEAD\s+OF).*?\bON\s+{NAME}", 2, 0),
    ("CREATE", "FUNCTION", rf"CREATE\s+{OPT}FUNCTION\s+{NAME}", 0, 1),
    ("CREATE", "PROCEDURE", rf"CREATE\s+{OPT}PROCEDURE\s+{NAME}", 0, 1),
    ("INSERT", "TABLE", rf"INSERT\s+INTO\s+{NAME}", 1, 0),
    ("UPDATE", "TABLE", rf"UPDATE\s+{NAME}", 1, 0),
    ("DELETE", "TABLE", rf"DELETE\s+FROM\s+{NAME}", 1, 0),
    ("SELECT", "", r"(?:SELECT|WITH)\b", 0, 0),
]
RULES = [(s, o, re.compile(p, re.IGNORECASE | re.DOTALL), t, f) for s, o, p, t, f in STATEMENTS]
TOKEN = re.compile(r"'(?:''|\\'|[^'])*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|(\$\w*\$).*?\1|;", re.DOTALL)


def statements(text: str) -> list[tuple[int, int]]:
    """Ranges of the statements; quotes, comments and dollar-quoted bodies hide semicolons."""
    out, at = [], 0
    for m in TOKEN.finditer(text):
        if m[0] == ";":
            end = m.end()
            if (feed := re.match(r"[ \t]*\n", text[end:])) is not None:
                end += feed.end()
            out.append((at, end))
            at = end
    if text[at:].strip():
        out.append((at, len(text)))
    return out


def dialect(text: str) -> str | None:
    up = text.upper()
    best = max(DIALECTS, key=lambda d: sum(w in up for w in DIALECTS[d]))
    return best if any(w in up for w in DIALECTS[best]) else None


def describe(statement: str) -> dict:
    bare = re.sub(r"\A(?:\s|--[^\n]*\n|/\*.*?\*/)+", "", statement, flags=re.DOTALL)
    clean = lambda s: re.sub(r"[\"`\[\]]", "", s)
    for kind, what, rule, table, routine in RULES:
        if m := rule.match(bare):
            return {"statement_type": kind, "object_type": what or None, "table_name": clean(m[table]) if table else None, "procedure_name": clean(m[routine]) if routine else None}
    word = re.match(r"\w+", bare)
    return {"statement_type": word[0].upper() if word else None}


@chunker("sql", 32, mimes="application/sql text/x-sql application/x-sql", suffixes=".sql .ddl .dml", languages="sql plsql plpgsql")
def sql(source: Source, options: Options) -> list[Part]:
    """The statements of each table together, tables in order of appearance; then the others one by one."""
    text, tables, alone = source.text, {}, []
    lang = dialect(text)
    for a, b in statements(text):
        about = describe(text[a:b])
        if about.get("table_name"):
            tables.setdefault(about["table_name"], []).append((a, b, about))
        else:
            alone.append((a, b, about))
    out = []
    for spans in tables.values():
        joined = all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
        out.append(Part(spans[0][0], spans[-1][1], "sql", {"sql": spans[0][2] | {"sql_dialect": lang}}, None if joined else "".join(text[a:b] for a, b, _ in spans)))
    return out + [Part(a, b, "sql", {"sql": about | {"sql_dialect": lang}}) for a, b, about in alone]
