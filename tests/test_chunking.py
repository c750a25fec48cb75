import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamark.operators import chunking as C
from seamark.operators import segments as S


def test_size_chunks_cover_all_lines_with_overlap():
    text = "\n".join(f"line {i} with some words in it" for i in range(60))
    chunks = C.by_size("a/b.txt", text, C.Config(160, 2))
    lines = text.split("\n")
    assert len(chunks) > 2 and chunks[0].start_line == 1 and chunks[-1].end_line == 60
    for c in chunks:
        assert c.content == "\n".join(lines[c.start_line - 1 : c.end_line]) and C.estimate(c.content) <= 130
        assert c.description == f"Code from b.txt (lines {c.start_line}-{c.end_line})"
    assert all(b.start_line == a.end_line - 1 for a, b in zip(chunks, chunks[1:]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 60).map(lambda n: "ab " * n), max_size=40), st.integers(0, 4))
def test_every_line_is_in_a_chunk(lines, overlap):
    parts = list(C.pack_lines(lines, 100, overlap))
    seen = set()
    for text, a, z in parts:
        assert a <= z and (a == z or text == "\n".join(lines[a : z + 1]))
        seen |= set(range(a, z + 1))
    assert seen == set(range(len(lines)))


def test_long_lines():
    assert len(C.split_long_line(" ".join(["word"] * 10), 5)) >= 2
    assert C.split_long_line("x" * 500, 5) == ["x" * 500]
    assert C.split_long_line("   ", 5) == ["   "]
    parts = C.by_size("f", "short\n" + "word " * 2000 + "\nlast", C.Config(200))
    assert [p.start_line for p in parts][0] == 1 and parts[-1].content == "last" and parts[-1].start_line == 3
    assert " ".join(p.content for p in parts[1:-1]).split() == ["word"] * 2000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=30), st.integers(1, 12))
def test_long_lines_are_filled_word_by_word(lengths, most):
    words, want, used = ["x" * n for n in lengths], [], 0
    for w in words:
        n = C.estimate(w + " ")
        if want and used + n <= most:
            want[-1] += f" {w}"
        else:
            want.append(w)
            used = 0
        used += n
    assert C.split_long_line(" ".join(words), most) == (want or [""])


@pytest.mark.parametrize("path,src,ends", [
    ("a.rs", "pub fn first<'a>(x: Foo, y: Bar) -> usize {\n    let s = r#\"a } b\"#;\n    let c = '}';\n    /* } */\n    x.len() + y.len() + 100\n}\nfn second() { let t = \"several\n}\n\"; t.len(); }\n", [6, 9]),
    ("a.go", "package a\n\nfunc F(x interface{}, f func(a struct{}) error) map[string]struct{} {\n\ts := `\n}\nfunc G() {\n`\n\treturn nil // } done here\n}\n\ntype Any = interface{}\n\nfunc H(a string) string {\n\treturn a + \"some more text to be long enough\" + \"}\"\n}\n", [9, 15]),
    ("a.js", "function f({a, b}, c = '}') {\n  const t = `x ${a} }\n function no() {`;\n  return a + b + c + 'some text to be long';\n}\n// function comment() { it is none, it is none, it is none }\n", [5]),
    ("A.java", "class A {\n  String t = \"\"\"\n    } class B { not a class at all, just a text\n  \"\"\";\n  char c = '}'; char d = '\\''; int x = 1 + 2 + 3;\n}\n", [6]),
    ("a.cpp", "int f(int a, int b) {\n  auto s = R\"x(}} int g(int a, int b) { )x\";\n  return a + b + 1000 + 2000;\n}\n", [4]),
])
def test_braces_in_texts_and_comments_count_nothing(path, src, ends):
    assert [c.end_line for c in C.chunk_file(path, src)] == ends


@pytest.mark.parametrize("budget,overlap", [(300, 3), (160, 0), (200, 1)])
def test_size_chunks_against_the_plain_rule(sf, budget, overlap):
    """Line after line into the open chunk, a line beyond the budget by words; a new chunk starts with the last lines of the one before."""
    import duckdb

    for (text,) in duckdb.sql(f"select text from '{sf}/documents.parquet'").fetchall():
        want, held, room = [], [], budget - 50
        lines = text.split("\n")
        for i, line in enumerate(lines):
            n = C.estimate(line)
            if n > room:
                want += [("\n".join(lines[j] for j in held), held[0] + 1, held[-1] + 1)] if held else []
                want += [(part, i + 1, i + 1) for part in C.split_long_line(line, room)]
                held, used = [], 0
                continue
            if not held:
                used = 0
            elif used + n > room:
                want.append(("\n".join(lines[j] for j in held), held[0] + 1, held[-1] + 1))
                held = held[len(held) - min(overlap, len(held)) :]
                used = C.estimate("\n".join(lines[j] for j in held)) if held else 0
            held, used = [*held, i], used + n
        want += [("\n".join(lines[j] for j in held), held[0] + 1, held[-1] + 1)] if held else []
        assert [(c.content, c.start_line, c.end_line) for c in C.by_size("x", text, C.Config(budget, overlap))] == want


def test_split_oversized_numbers_its_parts():
    c = C.Chunk("\n".join(f"line {i} of a long body" for i in range(100)), 11, 110, "Go function f in package p (f.go)")
    parts = C.split_oversized(c, C.Config(150))
    assert "\n".join(p.content for p in parts) == c.content
    assert parts[0].start_line == 11 and parts[-1].end_line == 110 and parts[1].description.endswith("(part 2)")
    assert C.split_oversized(C.Chunk("x", 1, 1, "d")) == [C.Chunk("x", 1, 1, "d")]
    assert all(C.estimate(f"{p.description}\n\n{p.content}") <= 300 for p in C.rechunk(C.Chunk(c.content * 9, 1, 900, "d"), "f", 300))


def test_python_declarations():
    src = 'import os\n\n\nclass A:\n    """Holds a value.\n\n    More.\n    """\n\n    def get(self, key, default=None):\n        """Gets it."""\n        return self.values.get(key, default) or os.environ.get(key)\n\n\n@wraps\ndef f(a, b):\n    total = a + b + 1 + 2 + 3\n    return total * a\n'
    got = [(c.description, c.start_line, c.end_line) for c in C.chunk_file("x/m.py", src)]
    assert got == [("Python class A in m.py. Holds a value.", 4, 12), ("Python function get in m.py. Gets it.", 10, 12), ("Python function f in m.py", 15, 18)]
    assert C.chunk_file("m.py", "def broken(:\n")[0].description.startswith("Code from m.py")


def test_go_declarations():
    src = "package store\n\n// Open opens the store at a path.\n// It may fail.\nfunc (s *Store) Open(path string) error {\n\tif path == \"}\" {\n\t\treturn errors.New(\"no path was given\")\n\t}\n\treturn s.connect(path, 10, true)\n}\n\ntype Reader interface {\n\tRead(path string, offset int64, size int64) ([]byte, error)\n\tClose() error\n\tName() string\n}\n\nfunc tiny() {}\n"
    got = [(c.description, c.start_line, c.end_line) for c in C.chunk_file("a/s.go", src)]
    assert got == [("Go function (*Store).Open in package store (s.go). Open opens the store at a path. It may fail.", 3, 10), ("Go interface Reader in package store (s.go)", 12, 16)]


@pytest.mark.parametrize("path,src,names", [
    ("a.rs", "/// Adds numbers together.\npub fn add(left: i32, right: i32) -> i32 {\n    let sum = left + right;\n    sum + 0\n}\n\nimpl Point {\n    pub fn norm(&self) -> f64 {\n        (self.x * self.x + self.y * self.y).sqrt()\n    }\n}\n", ["Rust function add in a.rs. Adds numbers together.", "Rust impl Point in a.rs", "Rust function norm in a.rs"]),
    ("a.ts", "export interface Shape { area(): number; name: string; other: boolean }\nexport class Box implements Shape {\n  area(): number { return this.w * this.h * 1 + 0; }\n}\nconst go = async (a) => {\n  return await fetch(a + '/x/y/z/');\n};\n", ["TypeScript interface Shape in a.ts", "TypeScript class Box in a.ts", "TypeScript method area in a.ts", "TypeScript function go in a.ts"]),
    ("A.java", "public class A {\n    /** Says hello to someone. */\n    public static String hello(String name) {\n        return \"hello \" + name + \"!\" + name;\n    }\n}\n", ["Java class A in A.java", "Java method hello in A.java. Says hello to someone."]),
    ("a.c", "// Computes a sum of two values.\nint add(int a, int b)\n{\n    int c = a + b;\n    return c + 0 + 0;\n}\n", ["C function add in a.c. Computes a sum of two values."]),
])
def test_brace_languages(path, src, names):
    assert [c.description for c in C.chunk_file(path, src)] == names


def test_registering_a_language():
    C.register_language(C.Language("Toy", (".toy",), (("rule", r"^rule (?P<name>\w+)"),)))
    got = C.chunk_file("x.toy", "rule big {\n one two three four five six seven eight nine\n}\n")
    assert [c.description for c in got] == ["Toy rule big in x.toy"]


def test_chunk_files_as_rows(spark):
    files = spark.createDataFrame([("a.txt", "x\ny"), ("b.txt", None), ("c.txt", "")], "file_path string, content string")
    assert [(r["id"], r["content"]) for r in C.chunk_files(files).collect()] == [("a.txt:chunk_1", "x\ny")]


def test_segments(spark):
    def segments(*texts):
        rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "id string, t string").select(S.segments(F.col("t")).alias("s")).collect()
        return [r["s"] for r in rows]

    two = "func a() {\n  return something longer here\n}\nfunc b() {\n  return something else\n}"
    none, null, single, pair, many = segments("", None, "only one line of text", two, "\n\n".join("a paragraph that is long enough " * 3 for _ in range(40)))
    assert none == null == [] and single == ["only one line of text"] and len(pair) == 2
    assert len(many) == 9  # of 40 the first, each fifth, the last
    df = spark.createDataFrame([([str(i) for i in range(25)],)], "x array<string>")
    assert df.select(S.sampled(F.col("x"))).first()[0] == ["0", "3", "6", "9", "12", "15", "18", "21", "24"]
    df = spark.createDataFrame([(1, "first line that is long\n\nsecond line that is long"), (2, None)], "id long, content string")
    assert [(r["chunk_id"], r["segment_idx"]) for r in S.segment_chunks(df).orderBy("segment_idx").collect()] == [("1", 0), ("1", 1)]


def test_pooling():
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 16))
    assert len(S.farthest(x, 5)) == 5 and S.farthest(x, 5)[0] == 0 and S.farthest(x[:3], 5) == [0, 1, 2]
    y = np.vstack([x[0], x[0] * 1.01, x[0] + 0.001, x[1], x[2]])
    assert S.merged(y, 0.95) == [[0, 1, 2], [3], [4]]
