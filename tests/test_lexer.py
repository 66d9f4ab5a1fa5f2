"""Comments and literals over lines against a lexer that reads character by character."""

import random
import re

import pytest
from pyspark.sql import functions as F

from wordmend.operators.lexer import split_blocks
from wordmend.operators.tokens import tokens

TICKED = {"javascript", "go"}


def lexed(text, lang):
    """For every character whether it is inside of a block: a comment or literal over lines."""
    inside = [False] * len(text)
    i = 0

    def block(start, end, escapes=False):
        for k in range(start, end):
            inside[k] = True
        for m in re.finditer(r"(?s)\\.", text[start:end]) if escapes else ():
            inside[start + m.start()] = inside[start + m.start() + 1] = False

    while i < len(text):
        rest = text[i:]
        raw = re.match(r'b?r(#*)"', rest) if lang == "rust" and not re.match(r"\w", text[i - 1] if i else " ") else None
        if rest[0] == "\\":
            # The character after it is a mark, unless it is the first of a pair.
            i += 1
            if rest[1:2] == "\\":
                i += 1
        elif raw:
            body = i + raw.end()
            end = re.compile('"' + raw[1]).search(text, body)
            block(body, end.start() if end else len(text))
            i = end.end() if end else len(text)
        elif lang in ("python", "java") and (rest[:3] == '"""' or (lang == "python" and rest[:3] == "'''")):
            end = re.compile(r"(?s)(?:[^\\]|\\.)*?" + rest[:3]).match(text, i + 3)
            block(i + 3, end.end() - 3 if end else len(text), escapes=True)
            i = end.end() if end else len(text)
        elif rest[0] in "\"'":
            quote = rest[0]
            found = re.compile(rf"(?s){quote}(?:[^{quote}\\\n]|\\.)*{quote}?").match(text, i)
            i = found.end()
        elif rest[0] == "`" and lang in TICKED:
            pattern = r"(?s)(?:[^`\\]|\\.)*" if lang != "go" else r"[^`]*"
            end = re.compile(pattern).match(text, i + 1).end()
            block(i + 1, end, escapes=lang != "go")
            i = end + 1
        elif (rest[0] == "#" and lang == "python") or (rest[:2] == "//" and lang != "python"):
            while i < len(text) and text[i] != "\n":
                i += 1
        elif rest[:2] == "/*" and lang != "python":
            start, depth = i, 1
            i += 2
            while i < len(text) and depth:
                if text.startswith("*/", i):
                    depth, i = depth - 1, i + 2
                elif lang == "rust" and text.startswith("/*", i):
                    depth, i = depth + 1, i + 2
                else:
                    i += 1
            block(start + 2, i - 2 if not depth else i)
        else:
            i += 1
    return inside


def words_inside(text, lang):
    """Words of the blocks with their byte offsets; an escape pair in a literal is a gap."""
    inside = lexed(text, lang)
    kept = "".join(c if b or c == "\n" else " " for c, b in zip(text, inside, strict=True))
    return [(m.group(), len(text[: m.start()].encode())) for m in re.finditer(r"[^\W\d_]+", kept)]


PIECES = {
    "all": ["\n", "\n", " ", " alpha ", " Beta", "'", '"', "/", "*", "//", "/*", "*/", "#", "é", "x", "\\"],
    "python": ['"""', "'''", '"""', "r'", "()"],
    "rust": ["/*", "*/", ' r"', ' r#"', ' br##"', '"#', '"##', "/* /*", "*/ */"],
    "javascript": ["`", "`", "${", "}"],
    "go": ["`", "`"],
    "java": ['"""', "/**"],
    "cpp": ["/*", "*/"],
}


@pytest.mark.parametrize("lang", sorted(set(PIECES) - {"all"}))
def test_blocks_of_random_source(spark, lang):
    draw = random.Random(lang)
    texts = ["".join(draw.choices(PIECES["all"] + PIECES[lang], k=draw.randrange(40))) for _ in range(400)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    made = frame.withColumn("s", split_blocks(F.col("text"), F.lit(lang))).select("text", "s.*").collect()
    for r in made:
        assert len(r.blocks.encode()) == len(r.rest.encode()) == len(r.text.encode())
        got = [(m.group(), len(r.blocks[: m.start()].encode())) for m in re.finditer(r"[^\W\d_]+", r.blocks)]
        assert got == words_inside(r.text, lang), r.text
        kept = [w for version in (r.blocks, r.rest) for w in re.findall(r"alpha|Beta|é", version)]
        lost = sorted(re.findall(r"alpha|Beta|é", r.text)) != sorted(kept)
        assert not lost or "\\" in r.text  # but for escape pairs nothing gets lost


CASES = {
    "a.rs": ("/* a /* inner */ outer */ code", ["inner", "outer"]),
    "b.c": ("/* aa /* inner */ code */", ["aa", "inner"]),
    "c.rs": ('let x = r##"raw "quoted"# text\nmore"##; code', ["raw", "quoted", "text", "more"]),
    "d.js": ("x = `one ${two}\nthree \\n four \\` five`; code", ["one", "two", "three", "four", "five"]),
    "e.go": ("x := `C:\\new\nline`; code", ["new", "line"]),
    "f.py": ('x = """doc\n"inside" \\"\\"\\" more"""\ncode', ["doc", "inside", "more"]),
    "g.py": ("x = '' 'one'\ny = '''two\nthree'''", ["one", "two", "three"]),
    "h.java": ('s = """\n  text "block" // no comment\n  """; // comment', ["text", "block", "no", "comment", "comment"]),
    "i.cpp": ('s = "/*"; code // real */\nmore /* block\nlast */', ["real", "block", "last"]),
    "j.rs": ("/* never /* closed */ text", ["never", "closed", "text"]),
    "k.py": ('x = "a"# it\'s\n"""doc"""', ["it", "doc"]),
    "l.py": ('"""one""""two"\ncode', ["one", "two"]),
}


def test_words_and_positions(docs):
    rows = tokens(docs({k: t for k, (t, _) in CASES.items()}), ["path"], path="path", block_comments=True)
    got = {}
    for r in rows.orderBy("path", "start").collect():
        text = CASES[r.path][0]
        assert text.encode()[r.start : r.end].decode() == r.word
        assert r.line == text.encode()[: r.start].count(b"\n") + 1
        got.setdefault(r.path, []).append(r.word)
    assert got == {k: [w for w in words if len(w) > 1] for k, (_, words) in CASES.items()}


def test_many_marks(docs):
    text = "/* one */ f('x', \"yy\"); // two\n" * 5000
    rows = tokens(docs({"a.c": text}), ["path"], path="path", block_comments=True)
    assert {r.word: r["count"] for r in rows.groupBy("word").count().collect()} == {
        "one": 5000,
        "yy": 5000,
        "two": 5000,
    }
