"""Texts and rows that the tests share."""

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return text.translate(_LOWER)


def words_of(text):
    return WORD.findall(low(text or ""))


def sentences(n, start=0, width=9):
    """Different sentences of made-up words."""
    return " ".join(
        "W" + " ".join(f"w{(i * 7919 + j * 104729) % 99991:x}z" for j in range(width)) + "."
        for i in range(start, start + n)
    )


LONG = sentences(3000, 10_000)  # about 200,000 characters
ODD = [
    (1, sentences(12), "en", "a"),
    (1, sentences(12), "en", "a"),  # a repeated row
    (2, sentences(12), "en", "a"),  # an exact copy
    (3, sentences(12).replace("w0z", "changed"), None, None),
    (4, "", "en", "a"),
    (5, "", "fr", ""),
    (6, None, "en", "b"),
    (None, "no key here at all", "en", "b"),
    (None, None, None, None),
    (7, LONG, "en", "b"),
    (8, "\t \n", "fr", "b"),
    (9, "12 34 !!", "fr", "b"),
    (10, "Ünïcödé 😀 text, mixed İ ſ and ß", "de", "c"),
    (10, "the same key with another text", "de", "c"),
]
CLASHING = (
    "key node bands rank bucket size copies taken target source_size rate lang_pred score length piece "
    "sequence_id offset removed removed_words stretch ahead _order _part _name word n version hash "
    "c0 c1 _null _rows _shown _node _nth _spans _key _version _text "
    "start end later n_words places blocks query_id vector list id asks"
).split()
