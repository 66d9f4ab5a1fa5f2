"""Markdown: only running text is looked at."""

from pyspark.sql import functions as F

from wordmend.operators.markdown import mask_markdown
from wordmend.operators.tokens import tokens


def found(docs, text):
    rows = tokens(docs({"a.md": text}), ["path"], path="path").orderBy("start").collect()
    for r in rows:
        assert text.encode()[r.start:r.end].decode() == r.word
    return [r.word for r in rows]


def test_words(docs):
    assert found(docs, "Seven grey owls, a fox? Yes.") == ["Seven", "grey", "owls", "a", "fox", "Yes"]
    assert found(docs, "oneOwl half-grey owl's -- FOX") == ["oneOwl", "half-grey", "owl's", "FOX"]


def test_code_is_skipped(docs):
    text = (
        "## Owls\n\nThey fly.\n\n```sql\nSELECT owl\n  FROM wood;\n```\n\n"
        "Call `fly_now()` or ``a ` b`` twice.\n"
    )
    assert found(docs, text) == ["Owls", "They", "fly", "Call", "or", "twice"]


def test_fences(docs):
    assert found(docs, "~~~\ncode\n```\nstill\n~~~\ntext") == ["text"]
    assert found(docs, "````\na\n```\nb\n````\ntext") == ["text"]
    assert found(docs, "text\n\n```\nnever closed\n") == ["text"]
    assert found(docs, "- item\n  ```sh\n  code\n  ```\n- two") == ["item", "two"]


def test_any_number_of_blanks_makes_a_blank_line(docs):
    for n in (0, 10, 100, 1000):
        assert found(docs, "text\n" + " " * n + "\n    code\n\nend") == ["text", "end"]
        assert found(docs, "text\n" + " " * n + "\n<b>\nhidden\n</b>\n\nend") == ["text", "end"]
    assert found(docs, "text\n\n<pre>\na\n\nb\n</pre>\nend") == ["text", "end"]


def test_indented_code(docs):
    assert found(docs, "text\n\n    code\n\n    more\n\nend") == ["text", "end"]
    assert found(docs, "text\n    goes on") == ["text", "goes", "on"]


def test_html(docs):
    assert found(docs, "some <b class='x'>bold</b> text <!-- gone --> end") == ["some", "bold", "text", "end"]
    assert found(docs, "<div>\nhidden\n</div>\n\nshown") == ["shown"]
    assert found(docs, "<script>\n\nhidden\n\n</script>\nshown") == ["shown"]
    assert found(docs, "a < b and c > d") == ["a", "b", "and", "c", "d"]


def test_openings_without_an_end(docs):
    assert found(docs, "one <!-- two `code` <i>three</i>\n\nfour --> five") == ["one", "two", "three", "four", "five"]
    assert found(docs, "one <!-- gone\ngone --> two <? gone ?> three <!X gone> four") == ["one", "two", "three", "four"]
    assert found(docs, "`<!--` one `-->` <![CDATA[ gone > ]]> two") == ["one", "two"]
    assert found(docs, "one `two\n\nthree` four") == ["one", "two", "three", "four"]


def test_links(docs):
    text = '[link text](http://host/path "title") ![alt](img.png) end'
    assert found(docs, text) == ["link", "text", "alt", "end"]
    text = 'see [this page][ref] now\n\n[ref]: http://host/page "Title"\n'
    assert found(docs, text) == ["see", "this", "page", "now"]
    assert found(docs, "[not][defined]") == ["not", "defined"]
    assert found(docs, "<http://host> end") == ["http", "host", "end"]


def test_entities_and_escapes(docs):
    assert found(docs, "a &amp; b &#233; c \\`code\\`") == ["a", "b", "c", "code"]


def test_context_marks_one_end(docs):
    line = "0123456789 0123456789 word 0123456789 0123456789"
    (row,) = tokens(docs({"a.md": "x1\n" + line}), ["path"], path="path").where("word = 'word'").collect()
    assert row.context == "...23456789 0123456789 word 0123456789 01234567"
    assert (row.line, row.column) == (2, 23)
    (row,) = tokens(docs({"a.md": "word " + "1" * 30}), ["path"], path="path").collect()
    assert row.context == "word " + "1" * 19 + "..."


def test_text_is_not_lost_around_masks(docs):
    text = "é `c` ü [x](y) é\n" * 400
    assert found(docs, text) == ["é", "ü", "x", "é"] * 400


# Block structure: what is text in nested lists and quotes.
BLOCKS = {
    # list items
    "- item one\n\n    Teh continuation": "item one Teh continuation",
    "- alpha\n\n    - nested Teh": "alpha nested Teh",
    "1.  item\n\n    second paragraph": "item second paragraph",
    "- a\n\n      code\n\n  text": "a text",
    "- a\n  - b\n    - c\n\n          code\n\n      text": "a b c text",
    "1. one\n2. two\n\n   three\n\n       code": "one two three",
    "10) ten\n\n    text\n\n        code": "ten text",
    "-     code\n\n  text": "text",
    "- \n  text": "text",
    "-\n\n      code": "",
    "-\n\n  not in the item": "not in the item",
    "-\tfoo\n\n\tbar": "foo bar",
    "-\tfoo\n\n\t\tcode": "foo",
    "- foo\n\n\tbar\n\n\t    code": "foo bar",
    "- a\n> quoted\n\n    code": "a quoted",
    "text\n- item\n\nend": "text item end",
    "text\n2. goes on\n\n    code": "text goes on",
    "text\n1. item\n\n   more\n\n    still more": "text item more still more",
    "* * *\n    code": "",
    "- * * *\n- text": "text",
    "* a\n\n  > quote\n  >\n  >     code\n\n      code\n\n  end": "a quote end",
    # quotes
    ">     codeword": "",
    "> quote\nlazy\n\n    code": "quote lazy",
    "> quote\n    lazy too": "quote lazy too",
    "> a\n>\n> b\n>\n>     code\n\nend": "a b end",
    "> > deep\n> back\n\nend": "deep back end",
    ">text\n>\tmore\n>\n>\t\tcode": "text more",
    "> ```\n> code\n\ntext": "text",
    "> - item\n>\n>   text\n>\n>       code\n>\n> end": "item text end",
    "> ```\ntext\n```\ncode": "text",
    "   > three\n\n    > code": "three",
    "- > lazy\ngoes on\n\nend": "lazy goes on end",
    # fences in containers
    "- a\n  ```\n  code\n  ```\n  text": "a text",
    "- a\n\n      ```\n      code\n\n- b": "a b",
    "1. a\n   ~~~\n   code\n\n   code\nend": "a end",
    "- ```\n  code\n- text": "text",
    "```\n- code\n    code\n```\ntext": "text",
    "   ```\n   code\n  ```\ntext": "text",
    "```\ncode\n    ```\ncode": "",
    "``` a`b\ntext": "a b text",
    # HTML in containers
    "- <div>\n  hidden\n\n  shown": "shown",
    "> <!-- gone\n> gone -->\n> shown": "shown",
    "> <pre>\nshown": "shown",
    "text\n<div>\nhidden\n\nshown": "text shown",
    "text\n<b>\nshown": "text shown",
    # headings, rules and what follows them
    "# Head\n    code\ntext": "Head text",
    "Head\n===\n    code": "Head",
    "Head\n---\n    code\n\nend": "Head end",
    "> Head\n---\n    code": "Head",
    "- Head\n  ---\n  text": "Head text",
    "#no head\n    goes on": "no head goes on",
    "***\n    code\n\n___\ntext": "text",
    # inline marks end with their block
    "- `a\n- b` c": "a b c",
    "# `a\nb` c": "a b c",
    "> `a\n> b` c": "c",
    "`a\nb` c": "c",
    "- [a](http://host\n  'title') b": "a b",
    # definitions
    "[a]: http://host\n[b]: <http://x y> 'title\nmore'\n[text][A] [none][C]": "text none C",
    "text\n[a]: http://host\n\n[t][a]": "text a http host t a",
    "- [a b]: http://host\n\n[t][A  B]": "t",
    "> [a]: /x\n\n[t][] [u][a]": "t u",
    # line ends
    "- a\r\n\r\n      code\r\n\r\n  text\r\n": "a text",
    "> a\r\n>\r\n>     code\r\n": "a",
}


def test_blocks(docs):
    names = {f"{i}.md": text for i, text in enumerate(BLOCKS)}
    rows = tokens(docs(names), ["path"], path="path").orderBy("path", "start").collect()
    got = {name: [] for name in names}
    for r in rows:
        assert names[r.path].encode()[r.start:r.end].decode() == r.word
        got[r.path].append(r.word)
    wrong = {
        names[n]: (" ".join(w), BLOCKS[names[n]]) for n, w in got.items() if " ".join(w) != BLOCKS[names[n]]
    }
    assert not wrong


def test_masked_text_keeps_bytes_and_lines(spark):
    texts = [(t,) for t in BLOCKS]
    frame = spark.createDataFrame(texts, "text string").withColumn("masked", mask_markdown(F.col("text")))
    for r in frame.collect():
        assert len(r.masked.encode()) == len(r.text.encode())
        assert [i for i, c in enumerate(r.masked.encode()) if c == 10] == [
            i for i, c in enumerate(r.text.encode()) if c == 10
        ]


def test_many_lines_and_deep_nesting(docs):
    deep = "".join(f"{'  ' * i}- w{chr(97 + i % 26)}x\n" for i in range(200))
    assert len(found(docs, deep)) == 200
    long = "- item\n\n      code\n\n  text\n" * 3000
    assert found(docs, long) == ["item", "text"] * 3000
    assert found(docs, "> " * 300 + "deep") == ["deep"]
