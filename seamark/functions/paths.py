"""Rules on file paths as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the file rules.
CODE_EXTENSIONS = ".go .ts .tsx .js .jsx .py .rs .java .c .cpp .h .hpp .rb .php .swift .kt .scala .md .yaml .yml .json .toml".split()
TEST_SUFFIXES = "_test.go .test.ts .test.tsx .test.js .test.jsx .spec.ts .spec.tsx .spec.js .spec.jsx _test.py _spec.rb test.java tests.java _test.rs".split()
TEST_DIRS = "_tests __tests__ tests test spec specs".split()
IGNORED = ".git .seamark node_modules vendor __pycache__ .idea .vscode dist build *.min.js *.bundle.js go.sum package-lock.json yarn.lock".split()
KNOWN_DIRS = "node_modules vendor __pycache__ dist build .git .seamark .idea .vscode".split()
SKIP_TESTS = "_test.go .test.js .test.ts .test.tsx .spec.js .spec.ts _test.py _test.rs".split()
SKIP_GENERATED = ".pb.go .pb.gw.go .generated.go .gen.go .mock.go _mock.go _string.go _enumer.go .d.ts".split()
SKIP_DIRS = "vendor/ third_party/ thirdparty/ external/ testdata/ test_data/ fixtures/ mocks/ c-deps/ docs/ examples/ benchmarks/".split()
SKIP_EXTENSIONS = ".md .txt .rst .json .yaml .yml .toml .sql .csv .svg .png .jpg .gif .wasm .map".split()
MANY_FILES, MOST_BYTES = 1000, 1 << 20


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """In lower case, with its dot; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def _ends(x: Column, suffixes: list[str]) -> Column:
    return x.rlike("(" + "|".join(map(re.escape, suffixes)) + ")$")


def is_code_file(path: Column) -> Column:
    return extension(path).isin(CODE_EXTENSIONS)


def is_test_file(path: Column) -> Column:
    """By suffix of the name, test_*.py, or a test directory that isn't the first one of a relative path."""
    name = F.lower(basename(path))
    return _ends(name, TEST_SUFFIXES) | name.rlike(r"^test_.*\.py$") | dirname(path).rlike("/(" + "|".join(TEST_DIRS) + ")(/|$)")


def glob_regex(pattern: str) -> str:
    """A whole-name regular expression for *, ? and [classes]."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 1) if c == "[" else -1
        if c == "[" and end > 0:
            inner = pattern[i + 1 : end]
            out += "[" + ("^" + inner[1:] if inner[:1] == "^" else inner).replace("\\", "\\\\") + "]"
            i = end
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def active_patterns(patterns: list[str]) -> list[str]:
    """Those that can match: globs and paths, and of plain names the hidden and the known ones."""
    return [p for p in patterns if "*" in p or "/" in p or p.startswith(".") or p in KNOWN_DIRS]


def should_ignore(relative: Column, patterns: list[str] | None = None) -> Column:
    """Whether a component of a path relative to the root matches a pattern."""
    some = active_patterns(IGNORED if patterns is None else patterns)
    if not some:
        return F.lit(False)
    any_of = "|".join(f"(?:{glob_regex(p)[1:-1]})" for p in some)
    return (relative != ".") & F.exists(F.split(relative, "/"), lambda part: part.rlike(f"^(?:{any_of})$"))


def should_smart_skip(relative: Column) -> Column:
    name = basename(relative)
    within = F.lit(False)
    for d in SKIP_DIRS:
        within = within | relative.contains(d)
    return _ends(name, SKIP_TESTS + SKIP_GENERATED) | within | extension(relative).isin(SKIP_EXTENSIONS)


def is_worktree(path: Column) -> Column:
    return path.contains(".worktrees/")


def canonical_path(path: Column) -> Column:
    """Without the first .worktrees/<name>/ and what stands before it."""
    return F.regexp_replace(path, r"^.*?\.worktrees/[^/]*/", "")


def path_boost(path: Column, intent: Column) -> Column:
    """Product of the path factors for an intent."""
    p = F.lower(path)
    seeks = intent.isin("conceptual", "definition")
    factors = [
        F.when(intent == "conceptual", F.when(p.isin("readme.md", "readme", "readme.txt"), 1.5).when(p.endswith("/readme.md") & ~p.contains("example"), 1.2).otherwise(1.0)).otherwise(1.0),
        F.when(seeks & p.rlike("^(pkg|internal|lib)/") & ~p.contains("example") & ~p.contains("test"), 1.3).otherwise(1.0),
        F.when(seeks & (p.contains("/example") | p.startswith("example")), 0.7).otherwise(1.0),
        F.when((intent == "example") & (p.contains("example") | p.contains("demo")), 1.3).otherwise(1.0),
        F.when(p.endswith("_test.go") | p.contains("/test/"), 0.8).otherwise(1.0),
        F.when(p.contains(".worktrees/"), 0.5).otherwise(1.0),
        F.when(p.contains(".generated.") | p.contains(".pb.go"), 0.6).otherwise(1.0),
    ]
    out = factors[0]
    for f in factors[1:]:
        out = out * f
    return out
