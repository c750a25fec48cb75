"""Chunks of files: by declaration where the language is known, else by size.

Line state (budgets, overlap, long lines) is a loop over one file, so a chunker is a generator that runs in Arrow batches; whatever
follows is a DataFrame. `register_language` adds languages.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tokens of a chunk, lines repeated at the start of the next one, tokens of an indexed text, reserve for a description, least budget.
MAX_TOKENS, OVERLAP, MAX_INDEXED, RESERVE, LEAST = 1200, 3, 1500, 50, 100
MIN_DECLARATION, MIN_GO = 10, 20


@dataclass(frozen=True)
class Chunk:
    content: str
    start_line: int
    end_line: int
    description: str = ""


@dataclass(frozen=True)
class Config:
    max_tokens: int = MAX_TOKENS
    overlap: int = OVERLAP


def estimate(text: str) -> int:
    return max(len(text.encode()) // 4, int(len(text.split()) * 1.3))


def split_long_line(line: str, most: int) -> list[str]:
    """Words in parts whose estimates sum to `most` at most; a larger word is a part of its own; a blank line stays.

    A part ends where the running sum of the estimates passes the sum before the part by more than `most`.
    """
    words = line.split()
    sums = list(accumulate(estimate(f"{w} ") for w in words))
    cuts = [0]
    while cuts[-1] < len(words):
        at = cuts[-1]
        cuts.append(max(at + 1, bisect_right(sums, most + (sums[at - 1] if at else 0))))
    return [" ".join(words[a:z]) for a, z in pairwise(cuts)] or [line]


def pack_lines(lines: list[str], budget: int, overlap: int) -> Iterator[tuple[str, int, int]]:
    """(content, first line, last line) from 0: whole lines up to a budget, long lines by words, the last `overlap` lines repeated."""
    first, used = 0, 0  # the open chunk is lines[first:i]
    for i, line in enumerate(lines):
        n = estimate(line)
        if n > budget:
            if i > first:
                yield "\n".join(lines[first:i]), first, i - 1
            for part in split_long_line(line, budget):
                yield part, i, i
            first, used = i + 1, 0
        else:
            if i > first and used + n > budget:
                yield "\n".join(lines[first:i]), first, i - 1
                first = max(first, i - overlap) if overlap else i
                used = estimate("\n".join(lines[first:i])) if overlap else 0
            used += n
    if first < len(lines):
        yield "\n".join(lines[first:]), first, len(lines) - 1


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def by_size(path: str, content: str, cfg: Config = Config()) -> list[Chunk]:
    budget = max(LEAST, cfg.max_tokens - RESERVE)
    return [Chunk(text, a + 1, z + 1, f"Code from {_base(path)} (lines {a + 1}-{z + 1})") for text, a, z in pack_lines(content.split("\n"), budget, cfg.overlap)]


def split_oversized(chunk: Chunk, cfg: Config = Config()) -> list[Chunk]:
    """Parts of one chunk within its budget, numbered in their descriptions; a chunk that fits stays as it is."""
    budget = max(LEAST, cfg.max_tokens - estimate(chunk.description) - 10)
    parts = list(pack_lines(chunk.content.split("\n"), budget, 0))
    if len(parts) == 1:
        return [replace(chunk, content=parts[0][0])]
    at = chunk.start_line
    return [Chunk(text, at + a, at + z, f"{chunk.description} (part {i + 1})") for i, (text, a, z) in enumerate(parts)]


@dataclass(frozen=True)
class Language:
    """How declarations of a brace language look: kind by pattern, whose group `name` is the name."""

    name: str
    extensions: tuple[str, ...]
    kinds: tuple[tuple[str, str], ...] = ()
    comment: str = "//"
    chunker: Callable[[str, str], list[Chunk]] | None = field(default=None, compare=False)


LANGUAGES: dict[str, Language] = {}


def register_language(language: Language) -> None:
    for e in language.extensions:
        LANGUAGES[e] = language


def language_of(path: str) -> Language | None:
    dot = _base(path).rfind(".")
    return LANGUAGES.get(_base(path)[dot:].lower()) if dot >= 0 else None


def clean_doc(text: str, most: int = 200) -> str:
    """First paragraph of a comment or docstring without its marks and tags, at most `most` characters."""
    out = []
    for line in text.strip().strip("\"'").splitlines():
        line = re.sub(r"^\s*(///?!?|/\*+|\*+/|\*|#+|--)\s?", "", line.strip()).removesuffix("*/").strip()
        if line.startswith("@"):
            continue
        if not line and out:
            break
        if line:
            out.append(line)
    return " ".join(out)[:most]


def describe(language: str, kind: str, name: str, path: str, doc: str) -> str:
    head = f"{language} {kind} {name} in {_base(path)}".replace("  ", " ")
    return f"{head}. {doc}" if doc else head


def _leading_comment(lines: list[str], at: int, mark: str) -> str:
    first = at
    while first and (lines[first - 1].strip().startswith((mark, "*", "/*"))):
        first -= 1
    return clean_doc("\n".join(lines[first:at]))


#: What holds no code, by language: comments, then texts in their order of precedence. A lifetime ('a) is no text.
_COMMENTS = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE, _ONE_CHARACTER = r'"(?:\\.|[^"\\\n])*"', r"'(?:\\(?:u\{[0-9A-Fa-f]+\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|[0-7]{1,3}|.)|[^'\\\n])'"
_NO_CODE = {
    "Go": rf"{_COMMENTS}|`[^`]*`|{_DOUBLE}|{_ONE_CHARACTER}",
    "Rust": rf'{_COMMENTS}|b?r(?P<r>#*)".*?"(?P=r)|"(?:\\.|[^"\\])*"|{_ONE_CHARACTER}',
    "Java": rf'{_COMMENTS}|"""(?:\\.|.)*?"""|{_DOUBLE}|{_ONE_CHARACTER}',
    "C++": rf'{_COMMENTS}|R"(?P<r>[^(\s]*)\(.*?\)(?P=r)"|{_DOUBLE}|{_ONE_CHARACTER}',
    "": rf"{_COMMENTS}|`(?:\\.|[^`\\])*`|{_DOUBLE}|'(?:\\.|[^'\\\n])*'",
}
_NO_CODE = {name: re.compile(p, re.DOTALL) for name, p in (_NO_CODE | {"C": _NO_CODE["C++"]}).items()}
#: Types that are written with braces, which open no body.
_BRACE_TYPES = re.compile(r"\b(?:interface|struct)\s*\{\s*\}")


def code_only(content: str, language: str) -> str:
    """The content with blanks for comments and texts, at the same places."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    code = _NO_CODE.get(language, _NO_CODE[""]).sub(blank, content)
    return _BRACE_TYPES.sub(blank, code) if language == "Go" else code


def _block_end(lines: list[str], at: int, same_line: bool = False) -> int:
    """The last line of the braces that open at or after line `at`, those within parentheses aside; a declaration that ends first is one
    line. `lines` hold code only. `same_line`: no declaration goes on after a line that ends outside of parentheses."""
    depth = inside = 0
    for i in range(at, len(lines)):
        for c in re.findall(r"[(){};]", lines[i]):
            if c in "()":
                inside += 1 if c == "(" else -1 if inside else 0
            elif inside and not depth:
                continue
            elif c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
                if depth <= 0:
                    return i
            elif not depth:
                return i
        if same_line and not depth and not inside:
            return i
    return len(lines) - 1 if depth else at


def by_braces(path: str, content: str, language: Language) -> list[Chunk]:
    """Every declaration, in order; one within another is a chunk of its own too. Comments and texts declare nothing."""
    lines, code, out = content.split("\n"), code_only(content, language.name).split("\n"), []
    patterns = [(kind, re.compile(p)) for kind, p in language.kinds]
    package = next((m[1] for m in map(re.compile(r"^package\s+(\w+)").match, code) if m), "")
    for i, line in enumerate(code):
        for kind, p in patterns:
            if m := p.match(line):
                end = _block_end(code, i, language.name == "Go")
                doc = _leading_comment(lines, i, language.comment)
                groups = m.groupdict()
                name = groups.get("name") or ""
                if language.name == "Go":
                    first = i
                    while kind == "function" and first and lines[first - 1].startswith("//"):
                        first -= 1
                    text = "\n".join(lines[first : end + 1])
                    kind_ = {"struct": "struct", "interface": "interface"}.get(groups.get("of") or "", kind)
                    owner = f"({groups['recv'].split()[-1]})." if groups.get("recv") else ""
                    said = f"Go {kind_} {owner}{name} in package {package} ({_base(path)})" + (f". {doc}" if doc and kind == "function" else "")
                    if estimate(text) >= MIN_GO:
                        out.append(Chunk(text, first + 1, end + 1, said))
                else:
                    text = "\n".join(lines[i : end + 1])
                    if estimate(text) >= MIN_DECLARATION:
                        out.append(Chunk(text, i + 1, end + 1, describe(language.name, kind, name, path, doc)))
                break
    return out


def python_declarations(path: str, content: str) -> list[Chunk]:
    lines, out = content.split("\n"), []
    for node in ast.walk(ast.parse(content)):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            text = "\n".join(lines[first - 1 : node.end_lineno])
            if estimate(text) >= MIN_DECLARATION:
                kind = "class" if isinstance(node, ast.ClassDef) else "function"
                out.append(Chunk(text, first, node.end_lineno, describe("Python", kind, node.name, path, clean_doc(ast.get_docstring(node) or ""))))
    return sorted(out, key=lambda c: (c.start_line, -c.end_line))


_MOD = r"^\s*(?:(?:pub(?:\([^)]*\))?|public|private|protected|static|final|abstract|async|export|default|inline|virtual|constexpr|unsafe|extern|const)\s+)*"
register_language(Language("Python", (".py",), comment="#", chunker=python_declarations))
register_language(Language("Go", (".go",), (("function", r"^func\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<name>\w+)"), ("type", r"^type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+(?P<of>struct|interface)?"))))
_SCRIPT = (("class", _MOD + r"class\s+(?P<name>\w+)"), ("function", _MOD + r"function\s*\*?\s*(?P<name>\w+)"), ("function", _MOD + r"(?:let|var)?\s*(?P<name>\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>\s*\{"), ("method", r"^\s+(?:async\s+|static\s+|get\s+|set\s+)*(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)\w+)\s*\([^)]*\)\s*(?::[^{]+)?\{"))
register_language(Language("JavaScript", (".js", ".jsx", ".mjs"), _SCRIPT))
register_language(Language("TypeScript", (".ts", ".tsx"), (("interface", _MOD + r"interface\s+(?P<name>\w+)"), ("type", _MOD + r"type\s+(?P<name>\w+)\s*="), ("enum", _MOD + r"enum\s+(?P<name>\w+)"), *_SCRIPT)))
register_language(Language("Rust", (".rs",), (("function", _MOD + r"fn\s+(?P<name>\w+)"), ("struct", _MOD + r"struct\s+(?P<name>\w+)"), ("enum", _MOD + r"enum\s+(?P<name>\w+)"), ("trait", _MOD + r"trait\s+(?P<name>\w+)"), ("impl", r"^\s*impl\b(?:<[^>]*>)?\s*(?P<name>[\w:<>, ]+?)\s*\{"), ("module", _MOD + r"mod\s+(?P<name>\w+)"))))
register_language(Language("Java", (".java",), (("class", _MOD + r"class\s+(?P<name>\w+)"), ("interface", _MOD + r"interface\s+(?P<name>\w+)"), ("enum", _MOD + r"enum\s+(?P<name>\w+)"), ("method", _MOD + r"[\w<>\[\], ]+\s+(?P<name>(?!if\b|for\b|while\b|switch\b|catch\b|return\b|new\b)\w+)\s*\([^;{]*\)\s*(?:throws [\w, ]+)?\{"))))
_C = (("struct", _MOD + r"(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{?$"), ("enum", _MOD + r"(?:typedef\s+)?enum\s+(?P<name>\w+)"), ("function", r"^[A-Za-z_][\w\s\*&:<>,~]*?\b(?P<name>(?!if\b|for\b|while\b|switch\b|return\b)[\w:~]+)\s*\([^;]*\)\s*(?:const\s*)?\{?$"))
register_language(Language("C", (".c", ".h"), _C))
register_language(Language("C++", (".cpp", ".hpp", ".cc"), (("class", _MOD + r"class\s+(?P<name>\w+)"), ("namespace", r"^\s*namespace\s+(?P<name>\w+)"), *_C)))


def chunk_file(path: str, content: str, cfg: Config = Config()) -> list[Chunk]:
    """By declaration, oversize ones split; by size where the language is unknown, can't be read or has no declarations."""
    language, found = language_of(path), []
    if language:
        try:
            found = language.chunker(path, content) if language.chunker else by_braces(path, content, language)
        except (SyntaxError, ValueError, RecursionError):
            found = []
    if not found:
        return by_size(path, content, cfg)
    return [p for c in found for p in (split_oversized(c, cfg) if estimate(c.content) + estimate(c.description) > cfg.max_tokens else [c])]


def rechunk(chunk: Chunk, path: str, most: int = MAX_INDEXED) -> list[Chunk]:
    """Parts of a chunk whose indexed text (description, blank line, content) is beyond `most` tokens."""
    if estimate(f"{chunk.description}\n\n{chunk.content}") <= most:
        return [chunk]
    parts = by_size(path, chunk.content, Config(max(LEAST, most - estimate(chunk.description) - 20)))
    return [Chunk(p.content, chunk.start_line + p.start_line - 1, chunk.start_line + p.end_line - 1, f"{chunk.description} (part {i + 1})") for i, p in enumerate(parts)]


_ITEM = pa.list_(pa.struct([("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("description", pa.string())]))


def chunk_files(files: DataFrame, cfg: Config = Config(), path: str = "file_path", content: str = "content") -> DataFrame:
    """(id, file_path, chunk_index, content, start_line, end_line, description): id is path:chunk_n, n from 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for p, text in zip(b.column("p").to_pylist(), b.column("t").to_pylist(), strict=True):
                made.append([vars(r) for c in chunk_file(p or "", text, cfg) for r in rechunk(c, p or "")] if text else [])
            yield pa.RecordBatch.from_arrays([b.column("p"), pa.array(made, _ITEM)], names=["file_path", "chunks"])

    rows = files.select(F.col(path).alias("p"), F.col(content).alias("t")).mapInArrow(run, "file_path string, chunks array<struct<content:string,start_line:int,end_line:int,description:string>>")
    out = rows.select("file_path", F.posexplode("chunks").alias("chunk_index", "c"))
    return out.select(F.concat("file_path", F.lit(":chunk_"), (F.col("chunk_index") + 1).cast("string")).alias("id"), "file_path", "chunk_index", "c.content", "c.start_line", "c.end_line", "c.description")
