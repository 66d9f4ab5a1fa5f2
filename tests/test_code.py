"""Source code: comments and string literals."""

from pyspark.sql import functions as F

from wordmend.operators.tokens import tokens
from wordmend.sources.documents import file_type, source_lang


def found(docs, path, text, **options):
    rows = tokens(docs({path: text}), ["path"], path="path", **options).orderBy("start").collect()
    for r in rows:
        assert text.encode()[r.start:r.end].decode() == r.word
    return [r.word for r in rows]


def test_file_types(spark):
    names = "test.md x.MDX main.rs app.tsx notes.txt a.py a.PYW b.h c.hpp d.cjs Makefile .md x/.md a.b/c"
    frame = spark.createDataFrame([(n,) for n in names.split()], "path string")
    got = {
        r.path: (r.t, r.l)
        for r in frame.select("path", file_type(F.col("path")).alias("t"), source_lang(F.col("path")).alias("l")).collect()
    }
    plain, code = ("plain_text", None), "source_code"
    assert got == {
        "test.md": ("markdown", None), "x.MDX": ("markdown", None), "main.rs": (code, "rust"),
        "app.tsx": (code, "tsx"), "notes.txt": plain, "a.py": (code, "python"),
        "a.PYW": (code, "python"), "b.h": (code, "c"), "c.hpp": (code, "cpp"),
        "d.cjs": (code, "javascript"), "Makefile": plain, ".md": plain, "x/.md": plain,
        "a.b/c": plain,
    }


def test_line_comments(docs):
    text = '\n// owls fly by night\nlet a = 1;\nlog!("a grey owl sleeps");\n'
    assert found(docs, "a.rs", text) == ["owls", "fly", "by", "night", "grey", "owl", "sleeps"]


def test_literals(docs):
    assert found(docs, "a.c", 'x "esc \\" q" y') == ["esc"]
    assert found(docs, "a.c", "unterminated 'abc def") == ["abc", "def"]
    assert found(docs, "a.c", '"foo\\nbar"') == ["foo", "bar"]
    assert found(docs, "a.c", '"foo\\ébar" "end\\') == ["foo", "bar", "end"]
    assert found(docs, "a.go", "'it' \"don't stop\" x") == ["it", "don", "stop"]


def test_slashes_in_a_literal_start_a_comment(docs):
    assert found(docs, "a.js", 'u = "http://host"') == ["http", "host", "host"]


def test_literal_in_a_comment_is_found_twice(docs):
    assert found(docs, "a.js", '// say "hello"') == ["say", "hello", "hello"]


def test_line_breaks_of_two_characters(docs):
    for path, text in (("a.rs", 'x // Teh cat\r\ny = "abc def";\r\n'), ("a.py", "x # Teh cat\r\ny = 'abc def'\r\n")):
        rows = tokens(docs({path: text}), ["path"], path="path").orderBy("start").collect()
        assert [r.word for r in rows] == ["Teh", "cat", "abc", "def"]
        assert [r.context for r in rows] == [" Teh cat"] * 2 + ["abc def"] * 2


def test_contexts_of_a_long_line_are_short(docs):
    """Whole contexts would take 20,000 times the line."""
    for text in ("// " + "grey owls fly " * 20_000, 's = "' + "grey owls fly " * 20_000 + '";'):
        rows = tokens(docs({"a.c": text}), ["path"], path="path").orderBy("start").collect()
        assert len(rows) == 60_000
        assert all(text[r.start : r.end] == r.word for r in rows[::997])
        assert all(len(r.context) <= 50 and r.word in r.context for r in rows)
        assert rows[30_000].context == "..." + text[rows[30_000].start - 20 : rows[30_000].end + 20] + "..."


def test_context_is_the_whole_comment_or_literal(docs):
    frame = docs({"a.c": 'f("one two"); // the comment'})
    got = {r.word: r.context for r in tokens(frame, ["path"], path="path").collect()}
    assert got == {"one": "one two", "two": "one two", "the": " the comment", "comment": " the comment"}


def test_python(docs):
    assert found(docs, "a.py", '# A Python comment\nprint("A string")') == ["Python", "comment", "string"]
    assert found(docs, "a.py", 's = "a # bb"') == ["bb"]
    assert found(docs, "a.py", "s = 'x' # it's one") == ["it", "one"]
    assert found(docs, "a.py", 'open = "never closed') == []


def test_no_compound_split_in_code(docs):
    assert found(docs, "a.java", "// camelCase snake_case it's") == ["camelCase", "snake", "case", "it"]


def test_block_comments_are_an_option(docs):
    text = 'int a; /* first\n second */ b("lit"); // last /* not\nplain */'
    assert found(docs, "a.c", text) == ["lit", "last", "not"]
    assert found(docs, "a.c", text, block_comments=True) == ["first", "second", "lit", "last", "not"]
    text = 'def f():\n  """doc string\n  more"""\n  x = "lit" # end'
    assert found(docs, "a.py", text, block_comments=True) == ["doc", "string", "more", "lit", "end"]


def test_long_comment_lines(docs):
    text = "x = 1; // " + "word " * 3000 + '"tail"'
    assert len(found(docs, "a.cpp", text)) == 3002
