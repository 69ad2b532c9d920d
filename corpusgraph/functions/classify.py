"""MIME type, language, kind and processing mode of files, as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgraph.functions.paths import extension

#: Bytes looked at to tell text from binary, and the largest file that is chunked.
PEEK, MOST_BYTES = 4096, 100 * 1024 * 1024

#: MIME types by extension.
MIME = dict(
    pair.split("=")
    for pair in """
.go=text/x-go .py=text/x-python .js=text/javascript .ts=text/typescript .tsx=text/typescript-jsx .jsx=text/javascript-jsx
.rs=text/x-rust .rb=text/x-ruby .java=text/x-java .kt=text/x-kotlin .swift=text/x-swift .c=text/x-c .cpp=text/x-c++
.h=text/x-c-header .hpp=text/x-c++-header .cs=text/x-csharp .php=text/x-php .scala=text/x-scala .clj=text/x-clojure
.ex=text/x-elixir .exs=text/x-elixir .erl=text/x-erlang .hs=text/x-haskell .lua=text/x-lua .pl=text/x-perl .r=text/x-r
.sql=text/x-sql .sh=text/x-shellscript .bash=text/x-shellscript .zsh=text/x-shellscript .fish=text/x-shellscript
.ps1=text/x-powershell .vim=text/x-vim .zig=text/x-zig .md=text/markdown .markdown=text/markdown .rst=text/x-rst
.adoc=text/asciidoc .tex=text/x-tex .yaml=text/yaml .yml=text/yaml .toml=text/toml .ini=text/ini .cfg=text/ini
.conf=text/plain .env=text/plain .properties=text/x-java-properties .json=application/json .jsonl=application/x-ndjson
.ndjson=application/x-ndjson .csv=text/csv .tsv=text/tab-separated-values .xml=application/xml .pdf=application/pdf
.docx=application/vnd.openxmlformats-officedocument.wordprocessingml.document
.xlsx=application/vnd.openxmlformats-officedocument.spreadsheetml.sheet
.pptx=application/vnd.openxmlformats-officedocument.presentationml.presentation
.doc=application/msword .xls=application/vnd.ms-excel .ppt=application/vnd.ms-powerpoint
.odt=application/vnd.oasis.opendocument.text .ods=application/vnd.oasis.opendocument.spreadsheet
.odp=application/vnd.oasis.opendocument.presentation .rtf=application/rtf .jpg=image/jpeg .jpeg=image/jpeg .png=image/png
.gif=image/gif .webp=image/webp .svg=image/svg+xml .ico=image/x-icon .bmp=image/bmp .tiff=image/tiff .tif=image/tiff
.heic=image/heic .heif=image/heif .avif=image/avif .mp3=audio/mpeg .wav=audio/wav .flac=audio/flac .aac=audio/aac
.ogg=audio/ogg .mp4=video/mp4 .mov=video/quicktime .avi=video/x-msvideo .mkv=video/x-matroska .webm=video/webm
.zip=application/zip .tar=application/x-tar .gz=application/gzip .tgz=application/gzip .bz2=application/x-bzip2
.xz=application/x-xz .7z=application/x-7z-compressed .rar=application/vnd.rar .jar=application/java-archive
.war=application/java-archive .ear=application/java-archive .exe=application/x-executable .dll=application/x-executable
.so=application/x-sharedlib .dylib=application/x-sharedlib .a=application/x-archive .o=application/x-object
.wasm=application/wasm
""".split()
)
#: Web types that the platform's own table supplies.
MIME |= {".html": "text/html", ".htm": "text/html", ".css": "text/css", ".txt": "text/plain"}

#: Languages by extension.
LANGUAGE = {
    ".go": "go", ".py": "python", ".js": "javascript", ".ts": "typescript", ".java": "java", ".c": "c", ".cpp": "cpp", ".cc": "cpp",
    ".cxx": "cpp", ".rs": "rust", ".rb": "ruby", ".php": "php", ".cs": "csharp", ".swift": "swift", ".kt": "kotlin", ".kts": "kotlin",
    ".scala": "scala", ".sh": "bash", ".bash": "bash", ".sql": "sql",
}

#: MIME types by kind.
STRUCTURED = ("application/json", "application/x-ndjson", "text/csv", "text/tab-separated-values", "text/yaml", "application/yaml", "application/xml", "text/xml")
DOCUMENT = (
    "application/pdf", "text/html", "text/markdown", "text/asciidoc", "application/rtf", "application/msword", MIME[".docx"], MIME[".pptx"], MIME[".xlsx"],
    MIME[".xls"], MIME[".ppt"], MIME[".odt"], MIME[".ods"], MIME[".odp"],
)
ARCHIVE = ("application/zip", "application/x-tar", "application/gzip", "application/x-bzip2", "application/x-xz", "application/x-7z-compressed", "application/vnd.rar", "application/java-archive")
BINARY = ("application/octet-stream", "application/x-executable", "application/x-sharedlib", "application/x-archive", "application/x-object", "application/wasm")
TEXT = ("application/javascript", "application/x-ndjson", "application/x-yaml", "application/yaml", "text/x-rst", "text/x-tex")

#: The leading bytes (hex) of formats that are told by content.
MAGIC = (
    ("89504e470d0a1a0a", "image/png"), ("ffd8ff", "image/jpeg"), ("474946383761", "image/gif"), ("474946383961", "image/gif"), ("424d", "image/bmp"),
    ("504b0304", "application/zip"), ("1f8b08", "application/x-gzip"), ("526172211a0700", "application/x-rar-compressed"), ("526172211a070100", "application/x-rar-compressed"),
    ("255044462d", "application/pdf"), ("25215053", "application/postscript"), ("4f67675300", "application/ogg"), ("494433", "audio/mpeg"), ("0061736d", "application/wasm"), ("1a45dfa3", "video/webm"),
)


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key]


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def likely_text(peek: Column) -> Column:
    """No zero byte and valid UTF-8; empty is text."""
    return (F.octet_length(peek) == 0) | (~F.contains(peek, F.lit(b"\x00")) & F.is_valid_utf8(peek.cast("string")))


def sniffed(peek: Column) -> Column:
    """The MIME type by content: magic bytes, then markup, then text or binary; null if empty."""
    out = F.when(F.octet_length(peek) == 0, F.lit(None).cast("string"))
    head = F.lower(F.hex(F.substring(peek, 1, 16)))
    for magic, mime in MAGIC:
        out = out.when(head.startswith(magic), F.lit(mime))
    start = F.substring(peek, 1, 512).cast("string")
    out = out.when(start.rlike(r"(?i)^[\t\n\x0c\r ]*(<!doctype html|<html|<head|<script|<iframe|<h1|<div|<font|<table|<a|<style|<title|<b|<body|<br|<p|<!--)[ >]"), F.lit("text/html"))
    out = out.when(start.rlike(r"^[\t\n\x0c\r ]*<\?xml"), F.lit("text/xml"))
    binary = F.substring(peek, 1, 512).cast("string").rlike(r"[\x00-\x08\x0b\x0e-\x1a\x1c-\x1f]")
    return out.when(binary, F.lit("application/octet-stream")).otherwise(F.lit("text/plain"))


def mime_type(path: Column, peek: Column | None = None) -> Column:
    """The extension's type where content says nothing better, else that of the content."""
    by_ext = _lookup(extension(path), MIME)
    if peek is None:
        return F.coalesce(by_ext, F.lit("application/octet-stream"))
    vague = lambda seen: seen.isNull() | seen.isin("application/octet-stream", "text/plain")
    return let(sniffed(peek), lambda seen: F.coalesce(F.when(vague(seen), by_ext), seen, by_ext, F.lit("application/octet-stream")))


def language(path: Column) -> Column:
    return F.coalesce(_lookup(extension(path), LANGUAGE), F.lit(""))


def kind_of(mime: Column) -> Column:
    return let(F.lower(mime), _kind)


def _kind(m: Column) -> Column:
    return (
        F.when(m.isin(*STRUCTURED), "structured").when(m.isin(*DOCUMENT), "document").when(m.startswith("image/"), "image").when(m.isin(*ARCHIVE), "archive")
        .when(m.startswith("audio/") | m.startswith("video/"), "media").when(m.isin(*BINARY), "binary").when(m.startswith("text/") | m.isin(*TEXT), "text").otherwise("unknown")
    )


def probe(path: Column, content: Column) -> Column:
    """struct(kind, mime, language): by type, then demoted to binary if the first bytes aren't text."""
    peek = F.substring(content, 1, PEEK)
    by_ext = kind_of(F.coalesce(_lookup(extension(path), MIME), F.lit("")))

    def final(kind: Column, mime: Column, text: Column) -> Column:
        shown = F.when(kind.isin("text", "structured", "document") & ~text, "binary").when((kind == "unknown") & text, "text").when(kind == "unknown", "binary").otherwise(kind)
        return F.struct(shown.alias("kind"), mime.alias("mime"), language(path).alias("language"))

    seen = lambda mime: F.struct(mime.alias("m"), kind_of(mime).alias("k"))
    first = lambda x: F.struct(x["m"].alias("m"), F.when(x["k"] == "unknown", by_ext).otherwise(x["k"]).alias("k"))
    return let(let(let(mime_type(path, peek), seen), first), lambda x: final(x["k"], x["m"], likely_text(peek)))


def decide(kind: Column, size: Column, use_vision: bool | None = None) -> Column:
    """struct(mode, reason): too large comes before everything else."""
    image = ("metadata_only", "vision_disabled") if use_vision is False else ("semantic_only", "image")
    pick = lambda mode, reason: F.struct(F.lit(mode).alias("mode"), F.lit(reason).alias("reason"))
    return let(kind, lambda k: _decided(k, size, image, pick))


def _decided(kind: Column, size: Column, image: tuple[str, str], pick: Callable) -> Column:
    return (
        F.when(size > MOST_BYTES, pick("metadata_only", "too_large")).when(kind.isin("text", "structured", "document"), pick("chunk", "")).when(kind == "image", pick(*image))
        .when(kind == "archive", pick("metadata_only", "archive")).when(kind == "media", pick("metadata_only", "media")).when(kind == "binary", pick("metadata_only", "binary"))
        .otherwise(pick("skip", "unsupported"))
    )


def degraded(mode: Column, load: Column, semantic: bool = True) -> Column:
    """struct(mode, embed) under load, the share of the work queue that is full."""
    m = mode if semantic else F.when(mode == "semantic_only", "metadata_only").otherwise(mode)
    m = F.when((load >= 0.95) & m.isin("chunk", "semantic_only"), "metadata_only").otherwise(m)
    return F.struct(m.alias("mode"), ((m == "chunk") & (load < 0.8)).alias("embed"))
